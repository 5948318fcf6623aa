"""Filters, searches, samples and profiles of tracks and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = ("", "nan", "none", "null")
FACETS = ("airportid", "runwayname", "aircraft_category", "owner_name", "other_port")


def clean(column: Column | str) -> Column:
    """Trimmed text; empty for null and for words that mean missing."""
    c = F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
    return F.when(F.lower(c).isin(*MISSING), F.lit("")).otherwise(c)


def search_blob(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(clean(F.col(c).cast("string")) for c in columns)))


def filter_tracks(tracks: DataFrame, *, text: str = "", kinds: tuple[str, ...] = (), **wanted: tuple[str, ...]) -> DataFrame:
    """Tracks that match every non-empty selection; ``kinds`` match category or type; ``text`` is searched in the header."""
    out = tracks
    for column, values in wanted.items():
        if values:
            out = out.where(clean(column).isin(*values))
    if kinds:
        out = out.where(clean("aircraft_category").isin(*kinds) | clean("aircrafttype").isin(*kinds))
    if text:
        out = out.where(search_blob("track_id", "acid", "airportid", "runwayname", "aircraft_category", "aircrafttype", "owner_name", "other_port").contains(text.strip().lower()))
    return out


def facet_values(tracks: DataFrame) -> DataFrame:
    """facet, value: distinct cleaned header values; category and type are one facet."""
    pairs = [F.struct(F.lit(c).alias("facet"), clean(c).alias("value")) for c in FACETS if c != "aircraft_category"]
    pairs += [F.struct(F.lit("type").alias("facet"), clean(c).alias("value")) for c in ("aircraft_category", "aircrafttype")]
    return tracks.select(F.inline(F.array(*pairs))).where("value != ''").distinct()


def listing(tracks: DataFrame, limit: int = 1000) -> DataFrame:
    return tracks.orderBy("load_seq").limit(limit)


def at_least(points: DataFrame, least: int = 2) -> DataFrame:
    """Points of the tracks with ``least`` points or more."""
    return points.withColumn("__n", F.count("*").over(Window.partitionBy("track_id"))).where(F.col("__n") >= least).drop("__n")


def even_sample(points: DataFrame, most: int, keys: tuple[str, ...] = ("track_id",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``most`` evenly spaced rows of each group (all of smaller ones): the rows at the truncated places of a linear space."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    ranked = points.withColumns({"__i": F.row_number().over(rank) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    return _even(ranked, most)


def even_tracks(tracks: DataFrame, most: int) -> DataFrame:
    """``most`` evenly spaced tracks in load order.  Ranks come from counts by range of load_seq, so no task sees all rows."""
    return _ranked(tracks, "load_seq").transform(lambda t: _even(t, most))


def _ranked(rows: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``__i``, the rank by ``column`` (nulls first) from 0, and ``__n``: ranks inside ranges of about equal size plus the sizes of the
    ranges before."""
    bounds = sorted(set(rows.approxQuantile(column, [i / parts for i in range(1, parts)], 0.002)))
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    ranges = rows.withColumn("__part", F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda b: b < F.col(column)))))
    total, before = 0, []
    for r in sorted(ranges.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        before.append((r["__part"], total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(before or [(0, 0)], "__part int, __before long")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return ranges.withColumn("__local", local).join(F.broadcast(starts), "__part").withColumns({"__i": F.col("__local") + F.col("__before"), "__n": F.lit(total)}).drop("__part", "__local", "__before")


def _even(ranked: DataFrame, most: int) -> DataFrame:
    """Rows whose rank is floor(k * step) for a k below ``most``: k is the rank over the step, or one less by rounding."""
    step = F.expr(f"(__n - 1) / cast({max(1, most - 1)} as double)")
    nearest = F.ceil(F.col("__i") / step)
    hits = [(F.floor(k * step) == F.col("__i")) & (k < most) for k in (nearest, nearest - 1)]
    return ranked.where((F.col("__n") <= most) | hits[0] | hits[1]).drop("__i", "__n")


def stride_tracks(tracks: DataFrame, limit: int) -> DataFrame:
    """Every (n // limit)-th track in load order, ``limit`` at most."""
    ranked = _ranked(tracks, "load_seq").withColumn("__step", F.greatest(F.lit(1), F.floor(F.col("__n") / limit)))
    return ranked.where((F.col("__i") % F.col("__step") == 0) & (F.col("__i") / F.col("__step") < limit)).drop("__i", "__n", "__step")


def density_sample(points: DataFrame, tracks: DataFrame, *, track_share: int = 40, point_share: int = 8, most: int = 450) -> DataFrame:
    """Every (n // track_share)-th track, of it every (m // point_share)-th point, the first ``most`` in load order."""
    ranked = _ranked(tracks.select("track_id", "load_seq"), "load_seq")
    ranked = ranked.where(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / track_share)) == 0).drop("__i", "__n")
    p = points.join(ranked, "track_id").withColumn("__m", F.count("*").over(Window.partitionBy("track_id")))
    return p.where((F.col("seq") - 1) % F.greatest(F.lit(1), F.floor(F.col("__m") / point_share)) == 0).orderBy("load_seq", "seq").limit(most).drop("__m")


def modal_runway(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """cluster_id, runway: the most frequent non-empty runway; the one seen first wins ties; null without one."""
    m = members.join(tracks.select("track_id", "load_seq", clean("runwayname").alias("runway")), "track_id")
    counted = m.where("runway != ''").groupBy("cluster_id", "runway").agg(F.count("*").alias("n"), F.min("load_seq").alias("first"))
    best = counted.groupBy("cluster_id").agg(F.max_by("runway", F.struct("n", -F.col("first"))).alias("runway"))
    return m.select("cluster_id").distinct().join(best, "cluster_id", "left")


def visible_clusters(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clusters of two or more tracks with a runway."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.join(modal_runway(members, tracks), "cluster_id").where("size > 1 and runway is not null")


def visible_tracks(members: DataFrame, anomalies: DataFrame, most: int = 80) -> DataFrame:
    """The clusters' top anomalies first, then the other tracks by id, each once, ``most`` of them."""
    top = anomalies.where("rank = 1").select("track_id", F.lit(0).alias("turn"))
    every = top.unionByName(members.select("track_id", F.lit(1).alias("turn"))).groupBy("track_id").agg(F.min("turn").alias("turn"))
    return every.orderBy("turn", "track_id").limit(most)


def null_profile(tracks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, nulls, percent, over the cleaned header."""
    agg = tracks.agg(F.count("*").alias("n"), *(F.sum((clean(c) == "").cast("long")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit(0)).alias("nulls")) for c in columns))
    return agg.select("n", F.inline(rows)).select("field", "nulls", F.expr("if(n = 0, 0D, nulls * 100D / n)").alias("percent"))


def statistics(frame: DataFrame, column: str) -> DataFrame:
    """Mean, deviation (population), smallest and largest value; zeros for no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = F.col(column).cast("double")
    return frame.agg(F.count(column).alias("count"), zero(F.sum(c)).alias("sum"), zero(F.avg(c)).alias("mean"), zero(F.stddev_pop(c)).alias("std"), zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1f s", seconds)).when(seconds < 3600, F.format_string("%.1f min", seconds / 60)).otherwise(F.format_string("%.1f h", seconds / 3600))


def inside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (with cluster_id) inside their cluster's box, borders included; no box, no points."""
    return points.join(boxes, "cluster_id").where("x between min_x and max_x and y between min_y and max_y and z between min_z and max_z")


def overlap(a: str, b: str) -> Column:
    """Whether two boxes (column prefixes) touch; false if a bound is missing."""
    return F.coalesce(F.expr(" and ".join(f"{a}.min_{c} <= {b}.max_{c} and {b}.min_{c} <= {a}.max_{c}" for c in "xyz")), F.lit(False))
