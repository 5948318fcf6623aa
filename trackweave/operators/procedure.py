"""Centroids of clusters, deviations and anomalies, procedure checks and quality, waypoints, and comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.functions.quantiles import quantiles, ranks

from . import geometry as g
from . import kernels

RNP, RF_NM, COURSE_LIMIT, COORDINATE, ANGLE = 607.612, 0.3 * 6076.12, 3.0, 60.0, 0.01

e = F.expr


def aligned(points: DataFrame, most: int = 100) -> DataFrame:
    """(cluster_id, track_id, step, x, y, z): tracks (with cluster_id) thinned to ``most`` points and brought to the cluster's
    median length.  Quantiles and the rounds of the model read them several times, so they are stored."""
    from .selection import even_sample

    keys = ("cluster_id", "track_id")
    thin = even_sample(points.select(*keys, "seq", "x", "y", "z"), most, keys)
    packed = thin.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    target = packed.groupBy("cluster_id").agg(F.median(F.size("p")).cast("int").alias("m"))
    return cut(g.interpolated(packed.join(target, "cluster_id"), keys))


def median_centroid(steps: DataFrame) -> DataFrame:
    """(cluster_id, step, x, y, z): the median of the aligned tracks at every step."""
    return quantiles(steps, ["cluster_id", "step"], {c: (F.col(c), 0.5) for c in "xyz"})


def smoothed(centroid: DataFrame, compat: bool = False) -> DataFrame:
    """Moving median over max(3, n // 20) steps (made odd); ends are padded with their own value, or with 0 if ``compat``."""
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    c = centroid.withColumn("n", n).withColumn("h", e("cast(greatest(3, floor(n / 20)) as int)")).withColumn("h", e("cast(floor((h + if(h % 2 = 0, 1, 0)) / 2) as int)"))
    packed = c.groupBy("cluster_id").agg(F.max("h").alias("h"), F.array_sort(F.collect_list(F.struct("step", "x", "y", "z"))).alias("p"))
    rows = packed.select("cluster_id", "h", "p", F.posexplode("p").alias("step", "q"))
    around = rows.select("cluster_id", "step", "p", F.explode(F.sequence(F.col("step") - F.col("h"), F.col("step") + F.col("h"))).alias("j"))
    inside = "j between 0 and size(p) - 1"
    values = {a: e(f"if({inside}, element_at(p, greatest(1, least(size(p), j + 1))).{a}, {'0D' if compat else f'element_at(p, greatest(1, least(size(p), j + 1))).{a}'})") for a in "xyz"}
    return around.select("cluster_id", "step", *(v.alias(a) for a, v in values.items())).groupBy("cluster_id", "step").agg(*(F.median(a).alias(a) for a in "xyz"))


def modelled(steps: DataFrame, sigma: float | None = None, least: int = 4, degree: int = 5, rounds: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """(cluster_id, step, x, y, z): the profile model of clusters of ``least`` tracks or more, then polynomial smoothing; smaller
    clusters keep their median.

    Each round weighs every track's point by a Gaussian of its distance to the latent line and takes weighted means by
    step; ``sigma`` defaults to the cluster's median distance (of bounded memory, at least 1), a step far from all tracks keeps
    its place, and a cluster stops when its line changes little.  Only lines of some hundred steps reach a task as a whole.
    """
    size = steps.groupBy("cluster_id").agg(F.countDistinct("track_id").alias("tracks"))
    latent = cut(median_centroid(steps).join(size, "cluster_id").select("cluster_id", "step", *(F.col(c).alias(f"l{c}") for c in "xyz"), (F.col("tracks") < least).alias("done"), "tracks"))
    for _ in range(rounds):
        open_ = latent.where("not done")
        if not open_.limit(1).count():
            break
        near = steps.select("cluster_id", "step", "x", "y", "z").join(open_, ["cluster_id", "step"]).withColumn("d2", e("pow(x - lx, 2) + pow(y - ly, 2) + pow(z - lz, 2)"))
        if sigma is None:
            scale = near.groupBy("cluster_id").agg(F.greatest(F.lit(1.0), F.percentile_approx(F.sqrt("d2"), 0.5, 10_000)).alias("s"))
            near = near.join(scale, "cluster_id")
        else:
            near = near.withColumn("s", F.lit(float(sigma)))
        near = near.withColumn("w", e("exp(-d2 / (2 * s * s))"))
        new = near.groupBy("cluster_id", "step").agg(F.sum("w").alias("total"), *(F.sum(F.col("w") * F.col(c)).alias(f"n{c}") for c in "xyz"), *(F.max(f"l{c}").alias(f"l{c}") for c in "xyz"), F.max("tracks").alias("tracks"))
        new = new.withColumns({f"n{c}": e(f"if(total < 1e-6D, l{c}, n{c} / greatest(total, 1e-12D))") for c in "xyz"})
        moved = new.groupBy("cluster_id").agg((F.sqrt(F.sum(e("pow(nx - lx, 2) + pow(ny - ly, 2) + pow(nz - lz, 2)"))) / (F.sqrt(F.sum(e("lx * lx + ly * ly + lz * lz"))) + 1e-8)).alias("change"))
        new = new.join(moved, "cluster_id").select("cluster_id", "step", *(F.col(f"n{c}").alias(f"l{c}") for c in "xyz"), (F.col("change") < tolerance).alias("done"), "tracks")
        latent = cut(latent.where("done").unionByName(new))
    line = latent.select("cluster_id", F.col("step").cast("int").alias("step"), *(F.col(f"l{c}").alias(c) for c in "xyz"), "tracks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        out, _ = kernels.smooth(pdf[["x", "y", "z"]].to_numpy(), degree)
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].to_numpy(), "step": pdf["step"].to_numpy(), "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    smooth = line.where(F.col("tracks") >= least).drop("tracks").groupBy("cluster_id").applyInPandas(run, "cluster_id int, step int, x double, y double, z double")
    return smooth.unionByName(line.where(F.col("tracks") < least).drop("tracks"))


def _matched(points: DataFrame, centroid: DataFrame) -> DataFrame:
    """Track and centroid at the shorter one's number of points: (cluster_id, track_id, step, x.., cx..)."""
    keys = ("cluster_id", "track_id")
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    line = centroid.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y", "z"))).alias("c"))
    both = packed.join(line, "cluster_id").withColumn("m", F.least(F.size("p"), F.size("c")))

    def at(arr: str, a: str) -> str:
        place = f"if(m <= 1, 0D, s * (size({arr}) - 1) / cast(m - 1 as double))"
        low = f"cast(least(floor({place}), size({arr}) - 1) as int)"
        return f"element_at({arr}, {low} + 1).{a} + ({place} - {low}) * (element_at({arr}, least({low} + 2, size({arr}))).{a} - element_at({arr}, {low} + 1).{a})"

    fields = ", ".join(f"{at(arr, a)} as {prefix}{a}" for arr, prefix in (("p", ""), ("c", "c")) for a in "xyz")
    return both.select(*keys, "m", e(f"inline(transform(sequence(0, m - 1), s -> struct(s as step, {fields})))"))


def _moves(matched: DataFrame) -> DataFrame:
    w = Window.partitionBy("cluster_id", "track_id").orderBy("step")
    return matched.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in ("x", "y", "z", "cx", "cy", "cz")})


def deviations(points: DataFrame, centroid: DataFrame, cosine: bool = True) -> DataFrame:
    """(cluster_id, track_id, cosine_distance, squared_sum): per-step cosine distances (or lengths of the difference) of the
    directions of a track (with cluster_id) and its centroid; 1 and infinity below two points."""
    s = _moves(_matched(points, centroid))
    dist = e("1 - (dx * dcx + dy * dcy + dz * dcz) / ((sqrt(dx * dx + dy * dy + dz * dz) + 1e-8D) * (sqrt(dcx * dcx + dcy * dcy + dcz * dcz) + 1e-8D))")
    if not cosine:
        dist = e("sqrt(pow(dx - dcx, 2) + pow(dy - dcy, 2) + pow(dz - dcz, 2))")
    agg = s.groupBy("cluster_id", "track_id").agg(F.max("m").alias("m"), F.avg(dist).alias("d"), F.sum(dist * dist).alias("q"))
    return agg.select("cluster_id", "track_id", e("if(m < 2, 1D, d)").alias("cosine_distance"), e("if(m < 2, double('inf'), q)").alias("squared_sum"))


def anomalies(deviation: DataFrame, percentile: float = 0.95) -> DataFrame:
    """Rank by cosine distance (ties by track), anomaly flag above the percentile, score against the first, level."""
    deviation = cut(deviation)
    thr = quantiles(deviation, ["cluster_id"], {"threshold": (F.col("cosine_distance"), percentile)})
    out = ranks(deviation, "cluster_id", [("cosine_distance", True), ("track_id", False)])
    top = deviation.groupBy("cluster_id").agg(F.min_by("squared_sum", F.struct(-F.col("cosine_distance"), "track_id")).alias("top"))
    out = out.join(thr, "cluster_id").join(top, "cluster_id")
    out = out.withColumns({"is_anomaly": F.col("cosine_distance") > F.col("threshold"), "score": e("squared_sum / (top + 1e-8D)")})
    return out.withColumn("level", e("case when rank = 1 or score > 0.7D then 'high' when score > 0.4D then 'medium' else 'low' end")).drop("threshold", "top")


def assessment(found: DataFrame) -> DataFrame:
    """cluster_id, track_id, finding, advice of every ranked track, by its level."""
    finding = e("case level when 'high' then 'CRITICAL' when 'medium' then 'SIGNIFICANT' else 'MINOR' end")
    advice = e("case level when 'high' then 'ANALYSE_NOW' when 'medium' then 'WATCH_CLOSELY' else 'MONITOR' end")
    return found.select("cluster_id", "track_id", finding.alias("finding"), advice.alias("advice"))


def anomaly_statistics(found: DataFrame) -> DataFrame:
    return found.groupBy("cluster_id").agg(F.count("*").alias("tracks"), F.sum(F.col("is_anomaly").cast("long")).alias("anomalies"), (F.avg(F.col("is_anomaly").cast("double")) * 100).alias("percent"), F.max("cosine_distance").alias("max_distance"), F.avg("cosine_distance").alias("mean_distance"), F.stddev_pop("cosine_distance").alias("std_distance"))


def overall_risk(found: DataFrame) -> DataFrame:
    g_ = found.groupBy("cluster_id").agg(F.least(F.lit(1.0), F.avg("score") * 0.6 + F.avg(F.col("is_anomaly").cast("double")) * 0.4).alias("risk"))
    return g_.withColumn("level", e("case when risk < 0.3D then 'LOW' when risk < 0.6D then 'MEDIUM' else 'HIGH' end"))


def quality(points: DataFrame, centroid: DataFrame) -> DataFrame:
    """Repeatability, share of tracks inside the corridors, consistency of radii, gradient and score by cluster."""
    s = _moves(_matched(points, centroid))
    dist = e("1 - greatest(-1D, least(1D, (dx * dcx + dy * dcy + dz * dcz) / (sqrt(dx * dx + dy * dy + dz * dz) * sqrt(dcx * dcx + dcy * dcy + dcz * dcz) + 1e-8D)))")
    per = s.groupBy("cluster_id", "track_id").agg(F.avg(dist).alias("d"), F.percentile(e("sqrt(pow(x - cx, 2) + pow(y - cy, 2))"), 0.95).alias("lateral"), F.percentile(e("abs(z - cz)"), 0.95).alias("vertical"))
    per = per.join(g.ends(points, ("cluster_id", "track_id")), ["cluster_id", "track_id"]).withColumn("gradient", e("(az - bz) / (sqrt(pow(bx - ax, 2) + pow(by - ay, 2)) + 1e-8D)"))
    agg = per.groupBy("cluster_id").agg((1 - F.avg("d")).alias("repeatability"), (F.least(F.sum(e(f"if(lateral <= {2 * RNP}, 1, 0)")), F.sum(e("if(vertical <= 300, 1, 0)"))) * 100 / F.count("*")).alias("stable_percent"), F.avg("gradient").alias("gradient"))
    out = agg.join(radius_consistency(centroid), "cluster_id")
    return out.withColumn("score", e("greatest(0D, least(100D, repeatability * 45 + stable_percent * 0.35D + consistency * 20 - if(gradient > 0.037D, 20, 0)))"))


def radius_consistency(centroid: DataFrame) -> DataFrame:
    """Share of turn radii within 0.1 NM of their median; 1 below two radii."""
    t = g.turns(centroid.select("cluster_id", F.col("step").alias("seq"), "x", "y", "z", F.lit(0.0).alias("v"), F.lit(0.0).alias("t")), ("cluster_id",)).where("radius > 0").select("cluster_id", "radius")
    med = t.groupBy("cluster_id").agg(F.median("radius").alias("med"), F.count("*").alias("n"))
    share = t.join(med, "cluster_id").groupBy("cluster_id").agg(F.max("n").alias("n"), F.avg(e("if(abs(radius - med) <= 607.612D, 1D, 0D)")).alias("c"))
    return centroid.select("cluster_id").distinct().join(share, "cluster_id", "left").select("cluster_id", e("if(coalesce(n, 0) < 2, 1D, c)").alias("consistency"))


def rf_segments(centroid: DataFrame) -> DataFrame:
    """Inner centroid points that are turns: a radius of 0.3 NM at most, or a course change of 3 degrees at least."""
    base = centroid.select("cluster_id", F.col("step").alias("seq"), "x", "y", "z", F.lit(0.0).alias("v"), F.lit(0.0).alias("t"))
    t = g.turns(base, ("cluster_id",)).where(f"radius > 0 and (radius <= {RF_NM}D or course_change >= {COURSE_LIMIT})")
    speed = e("greatest(80D, sqrt(pow(fx - px, 2) + pow(fy - py, 2)) / 2)")
    t = t.withColumn("speed", speed).withColumn("bank", e("degrees(atan(speed * speed / (32.174D * radius)))"))
    return t.select("cluster_id", F.col("seq").alias("step"), "x", "y", "z", "radius", "course_change", "bank", e("if(z > 400, 25D, 8D)").alias("bank_limit"))


def pbn_checks(centroid: DataFrame) -> DataFrame:
    """cluster_id, rf_segments, bank_issues, length_issues, max_bank, min_margin, precise, valid."""
    rf = rf_segments(centroid)
    w = Window.partitionBy("cluster_id").orderBy("step")
    line = centroid.join(rf.select("cluster_id", "step", e("radius * tan(radians(abs(course_change)) / 2)").alias("dta")), ["cluster_id", "step"], "left")
    line = line.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "nz": F.lead("z").over(w), "ndta": F.lead("dta").over(w), "last": F.max("step").over(Window.partitionBy("cluster_id"))})
    legs = line.where("step >= 1 and step < last - 1 and (dta is not null or ndta is not null)")
    legs = legs.groupBy("cluster_id").agg(F.min(e("sqrt(pow(nx - x, 2) + pow(ny - y, 2)) - coalesce(dta, 0D) - coalesce(ndta, 0D)")).alias("min_margin"), F.sum(e("if(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) - coalesce(dta, 0D) - coalesce(ndta, 0D) < 0, 1, 0)")).alias("length_issues"))
    banks = rf.groupBy("cluster_id").agg(F.count("*").alias("rf_segments"), F.sum(e("if(bank > bank_limit, 1, 0)")).alias("bank_issues"), F.max("bank").alias("max_bank"))
    off = lambda c: f"({c} - rint({c} / {COORDINATE}) * {COORDINATE})"
    angle = "degrees(atan2(nz - z, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) + 1e-8D))"
    precise = line.groupBy("cluster_id").agg((F.coalesce(F.max(e("sqrt(" + " + ".join(f"pow({off(c)}, 2)" for c in "xyz") + ")")), F.lit(0.0)) <= COORDINATE).alias("a"), (F.coalesce(F.max(e(f"abs({angle} - rint({angle} / {ANGLE}) * {ANGLE})")), F.lit(0.0)) <= ANGLE).alias("b"))
    out = precise.join(banks, "cluster_id", "left").join(legs, "cluster_id", "left").fillna(0, ["rf_segments", "bank_issues", "length_issues"]).fillna(0.0, ["max_bank", "min_margin"])
    return out.select("cluster_id", "rf_segments", "bank_issues", "length_issues", "max_bank", "min_margin", e("a and b").alias("precise"), e("bank_issues = 0").alias("valid"))


def waypoints(centroid: DataFrame, fixes: DataFrame, points: DataFrame, most: int = 5) -> DataFrame:
    """Entry fixes, ``most`` even centroid points and exit fixes in order, with positions, limits from the nearest point of every
    track of the cluster (heights: mean and three deviations; speed: 85th percentile), and turns.

    The few waypoints go to the tracks, each of which has its points in one row, so what is shuffled is the points once and sums."""
    from .selection import even_sample

    tf = even_sample(centroid, most, ("cluster_id",), ("step",)).select("cluster_id", F.lit(1).alias("part"), F.col("step").cast("string").alias("name"), F.col("step").cast("long").alias("k"), F.lit("TF").alias("kind"), "x", "y", "z")
    tf = tf.withColumn("name", F.format_string("C%d-%02d", "cluster_id", "k"))
    fx = fixes.select("cluster_id", e("if(kind = 'ENTRY', 0, 2)").alias("part"), "name", F.lit(0).cast("long").alias("k"), "kind", "x", "y", "z")
    order = Window.partitionBy("cluster_id").orderBy("part", "k", "name")
    w = tf.unionByName(fx).withColumn("seq", F.row_number().over(order).cast("long"))
    w = cut(w)
    turn = g.turns(w.withColumns({"v": F.lit(0.0), "t": F.lit(0.0)}), ("cluster_id",)).select("cluster_id", "seq", "radius", "course_change")
    lines = points.groupBy("cluster_id", "track_id").agg(F.collect_list(F.struct(F.col("seq").alias("ps"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("v").alias("pv"))).alias("p"))
    near = lines.join(F.broadcast(w.select("cluster_id", "seq", "x", "y")), "cluster_id")
    near = near.select("cluster_id", "seq", e("array_min(transform(p, q -> struct(pow(q.px - x, 2) + pow(q.py - y, 2) as d, q.ps as ps, q.pz as pz, q.pv as pv)))").alias("m"))
    limits = near.groupBy("cluster_id", "seq").agg(F.avg("m.pz").alias("mean"), F.stddev_pop("m.pz").alias("sd"), F.percentile("m.pv", 0.85).alias("speed_kt"))
    out = g.wgs84(w).join(turn, ["cluster_id", "seq"], "left").join(limits, ["cluster_id", "seq"], "left")
    return out.select("cluster_id", "seq", F.col("name").alias("waypoint_id"), e("if(coalesce(course_change, 0D) > 3 and coalesce(radius, 0D) > 0, 'RF', kind)").alias("path_type"), "lat", "lon", "z", e("coalesce(greatest(0D, mean - 3 * sd), z)").alias("alt_low_ft"), e("coalesce(mean + 3 * sd, z)").alias("alt_high_ft"), e("coalesce(speed_kt, 0D)").alias("speed_kt"), e("coalesce(radius, 0D)").alias("radius_ft"))


def geojson(waypoint: DataFrame) -> DataFrame:
    """cluster_id, feature: a LineString of the waypoints in order."""
    g_ = waypoint.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("lon", "lat", "z").alias("c")))).alias("p"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.concat(F.lit("PROC-"), "cluster_id").alias("procedure_id")).alias("properties"), F.struct(F.lit("LineString").alias("type"), e("transform(p, s -> s.c)").alias("coordinates")).alias("geometry"))
    return g_.select("cluster_id", F.to_json(feature).alias("feature"))


def what_if(workload: DataFrame, load: float = 0.9, conflict: float = 0.85, complexity: float = 1.05) -> DataFrame:
    """Baseline, simulated and delta of the largest index, the conflicts and the mean complexity."""
    agg = workload.agg(F.max("workload").alias("a"), F.sum("conflicts").alias("b"), F.avg("complexity").alias("c"), F.max(F.col("workload") * load).alias("d"), F.sum((F.col("conflicts") * conflict).cast("long")).alias("f"), F.avg(F.col("complexity") * complexity).alias("g"))
    rows = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(x).cast("double").alias("baseline"), F.col(y).cast("double").alias("simulated")) for n, x, y in (("max_workload", "a", "d"), ("conflicts", "b", "f"), ("mean_complexity", "c", "g"))))
    return agg.select(F.inline(rows)).withColumn("delta", F.col("simulated") - F.col("baseline"))
