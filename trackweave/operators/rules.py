"""Rule-based risks of single tracks: descent profile, speeds, bank and radar failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as g

#: Approach speed ranges in knots by category.
VAT = {"A": (0, 90), "B": (91, 120), "C": (121, 140), "D": (141, 165), "E": (166, 210)}
GRADIENT_AB, GRADIENT_CD, TOLERANCE, SURFACE, BELOW = 0.037, 0.035, 0.05, 0.052, 150.0
FINAL_MARGIN, MIDDLE_MARGIN, SPLIT, BANK_HIGH, BANK_LOW, ACCELERATION, RESIDUAL = 20, 30, 397.0, 25.0, 8.0, 96.5, 1500.0
SEVERITY = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}

e = F.expr


def category(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, category: the header's letter A-E (equal or last, in that order), else by the 20th speed percentile, else C."""
    text = F.upper(F.trim(F.coalesce("aircraft_category", F.lit(""))))
    named = F.coalesce(*(F.when(text.endswith(k), k) for k in VAT))
    speed = points.groupBy("track_id").agg(F.percentile("v", 0.2).alias("p20"))
    by_speed = F.coalesce(*(F.when(F.col("p20").between(lo, hi), k) for k, (lo, hi) in VAT.items()), F.lit("C"))
    return tracks.join(speed, "track_id").select("track_id", F.coalesce(named, by_speed).alias("category"))


def _limit(values: dict[str, float], column: str = "category") -> Column:
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(float(v))) for k, v in values.items()))


def descent(points: DataFrame, categories: DataFrame) -> DataFrame:
    """Steepest segment, its limit, the largest depth below the protection surface, and the number of risks (0-2)."""
    s = g.steps(points)
    last = Window.partitionBy("track_id")
    s = s.withColumns({f"l{c}": F.max_by(c, "seq").over(last) for c in "xyz"})
    agg = s.groupBy("track_id").agg(F.max(e("if(sqrt(dx * dx + dy * dy) > 1e-8D, -dz / sqrt(dx * dx + dy * dy), null)")).alias("g"), F.max(e(f"lz + {SURFACE}D * sqrt(pow(x - lx, 2) + pow(y - ly, 2)) - z")).alias("below"), F.max("n").alias("n"))
    out = agg.join(categories, "track_id").withColumn("allowed", F.when(F.col("category").isin("A", "B"), GRADIENT_AB * (1 + TOLERANCE)).otherwise(GRADIENT_CD * (1 + TOLERANCE)))
    return out.select("track_id", F.coalesce("g", F.lit(0.0)).alias("max_gradient"), "allowed", e("if(n < 2, 0D, below)").alias("below"), e("coalesce(g > allowed, false)").alias("steep"), e(f"n >= 2 and below > {BELOW}").alias("low"))


def speeds(points: DataFrame, categories: DataFrame) -> DataFrame:
    """Largest speeds of the last fifth and of the part from 30 to 70 percent (bounds truncated), with both risks."""
    p = points.withColumns({"n": F.count("*").over(Window.partitionBy("track_id")), "i": F.col("seq") - 1})
    agg = p.groupBy("track_id").agg(F.max(e("if(i >= cast(n * 0.8D as int), v, null)")).alias("final"), F.max(e("if(i >= cast(n * 0.3D as int) and i < greatest(cast(n * 0.7D as int), 1), v, null)")).alias("middle"))
    out = agg.join(categories, "track_id").withColumn("upper", _limit({k: hi for k, (_, hi) in VAT.items()})).withColumn("middle", F.coalesce("middle", "final"))
    return out.select("track_id", "final", "middle", e(f"final > upper + {FINAL_MARGIN}").alias("unstable"), e(f"middle > upper + {MIDDLE_MARGIN}").alias("fast"))


def banks(points: DataFrame) -> DataFrame:
    """Largest bank up to the first point above its limit, and that point's place, bank and severity (null without one)."""
    t = g.turns(points).where("radius > 0").withColumn("limit", e(f"if(z > {SPLIT}, {BANK_HIGH}D, {BANK_LOW}D)"))
    first = F.min(F.when(F.col("bank") > F.col("limit"), F.col("seq"))).over(Window.partitionBy("track_id"))
    t = t.withColumn("first", first).where("first is null or seq <= first")
    agg = t.groupBy("track_id").agg(F.max("bank").alias("max_bank"), F.max("first").alias("at"), F.max(e("if(seq = first, bank, null)")).alias("bank"), F.max(e("if(seq = first, bank > limit * 1.25D, null)")).alias("strong"))
    return points.select("track_id").distinct().join(agg, "track_id", "left").select("track_id", F.coalesce("max_bank", F.lit(0.0)).alias("max_bank"), "at", "bank", e("if(at is null, null, if(strong, 'HIGH', 'MEDIUM'))").alias("severity"))


def plane_residuals(points: DataFrame) -> DataFrame:
    """track_id, residual: the 95th percentile of the distances to the track's best plane; 0 below four points.

    The plane's normal is the eigenvector of the scatter matrix's smallest eigenvalue: the eigenvalue from the characteristic
    polynomial's angle, the vector from the adjugate of the shifted matrix, twice, the second time with the vector's own quotient.
    """
    w = Window.partitionBy("track_id")
    c = points.select("track_id", *((F.col(a) - F.avg(a).over(w)).alias(a) for a in "xyz"), F.count("*").over(w).alias("n"))
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    c = c.withColumns({p: F.sum(F.col(p[0]) * F.col(p[1])).over(w) for p in pairs}).withColumn("trace", e("xx + yy + zz"))
    c = c.withColumns({p: e(f"if(trace > 0, {p} / trace, 0D)") for p in pairs})
    c = c.withColumn("spread", e("sqrt((pow(xx - 1 / 3D, 2) + pow(yy - 1 / 3D, 2) + pow(zz - 1 / 3D, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)"))
    det = "((xx - 1 / 3D) * ((yy - 1 / 3D) * (zz - 1 / 3D) - yz * yz) - xy * (xy * (zz - 1 / 3D) - yz * xz) + xz * (xy * yz - (yy - 1 / 3D) * xz))"
    c = c.withColumn("least", e(f"1 / 3D + 2 * spread * cos(acos(greatest(-1D, least(1D, if(spread > 0, {det} / (2 * pow(spread, 3)), 0D)))) / 3 + 2 * pi() / 3)"))
    start = "case when abs(c0) >= abs(c1) and abs(c0) >= abs(c2) then {0} when abs(c1) >= abs(c2) then {1} else {2} end"
    for vector in ((("c0", "d01", "d02"), ("d01", "c1", "d12"), ("d02", "d12", "c2")), None):
        c = c.withColumns({"c0": e("(yy - least) * (zz - least) - yz * yz"), "c1": e("(xx - least) * (zz - least) - xz * xz"), "c2": e("(xx - least) * (yy - least) - xy * xy"), "d01": e("xz * yz - xy * (zz - least)"), "d02": e("xy * yz - xz * (yy - least)"), "d12": e("xy * xz - yz * (xx - least)")})
        if vector:
            c = c.withColumns({f"v{i}": e(start.format(*row)) for i, row in enumerate(vector)})
        else:
            c = c.withColumns({"w0": e("c0 * v0 + d01 * v1 + d02 * v2"), "w1": e("d01 * v0 + c1 * v1 + d12 * v2"), "w2": e("d02 * v0 + d12 * v1 + c2 * v2")}).withColumns({"v0": F.col("w0"), "v1": F.col("w1"), "v2": F.col("w2")})
        c = c.withColumn("norm", e("sqrt(v0 * v0 + v1 * v1 + v2 * v2)")).withColumns({f"v{i}": e(f"if(norm > 0, v{i} / norm, 0D)") for i in range(3)})
        c = c.withColumn("least", e("xx * v0 * v0 + yy * v1 * v1 + zz * v2 * v2 + 2 * (xy * v0 * v1 + xz * v0 * v2 + yz * v1 * v2)"))
    return c.groupBy("track_id").agg(F.percentile(e("abs(x * v0 + y * v1 + z * v2)"), 0.95).alias("residual"), F.max("n").alias("n")).select("track_id", e("if(n < 4, 0D, residual)").alias("residual"))


def radar(points: DataFrame) -> DataFrame:
    out = g.acceleration_max(points).join(plane_residuals(points), "track_id")
    return out.withColumns({"jump": F.col("max_acceleration") > ACCELERATION, "scatter": F.col("residual") > RESIDUAL})


def risks(points: DataFrame, tracks: DataFrame, *, with_plane: bool = True) -> DataFrame:
    """(track_id, check, type, severity, detail): one row for each rule that a track breaks, with the values that break it."""
    c = category(points, tracks)
    row = lambda check, kind, severity, text, *values: F.struct(F.lit(check).alias("check"), F.lit(kind).alias("type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.format_string(text, *values).alias("detail"))
    found = descent(points, c).join(speeds(points, c), "track_id").join(banks(points), "track_id")
    found = found.join(radar(points) if with_plane else g.acceleration_max(points).withColumns({"jump": F.col("max_acceleration") > ACCELERATION, "residual": F.lit(0.0), "scatter": F.lit(False)}), "track_id")
    rows = [
        F.when(F.col("steep"), row("profile", "PROFILE", "HIGH", "gradient %.3f over %.3f", F.col("max_gradient"), F.col("allowed"))),
        F.when(F.col("low"), row("profile", "PROFILE", "HIGH", "%.0f ft below the protection surface", F.col("below"))),
        F.when(F.col("unstable"), row("speed", "UNSTABLE_APPROACH", "MEDIUM", "final speed %.0f kt", F.col("final"))),
        F.when(F.col("fast"), row("speed", "INTERMEDIATE_SPEED", "MEDIUM", "intermediate speed %.0f kt", F.col("middle"))),
        F.when(F.col("severity").isNotNull(), row("bank", "DANGEROUS_MANEUVER", F.col("severity"), "bank %.1f degrees at point %d", F.col("bank"), F.col("at"))),
        F.when(F.col("jump"), row("radar", "TECH_FAILURE", "HIGH", "acceleration %.1f ft/s2", F.col("max_acceleration"))),
        F.when(F.col("scatter"), row("radar", "TECH_FAILURE", "MEDIUM", "%.0f ft off the plane", F.col("residual"))),
    ]
    return found.select("track_id", F.inline(F.array_compact(F.array(*rows))))


def rollup(risk: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, risk_count, max_severity for every track; NONE without a risk."""
    rank = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in SEVERITY.items()))
    agg = risk.groupBy("track_id").agg(F.count("*").alias("risk_count"), F.max_by("severity", rank).alias("max_severity"))
    return tracks.select("track_id").join(agg, "track_id", "left").select("track_id", F.coalesce("risk_count", F.lit(0)).alias("risk_count"), F.coalesce("max_severity", F.lit("NONE")).alias("max_severity"))


def totals(risk: DataFrame, members: DataFrame) -> DataFrame:
    """Counts by cluster and type with totals: a rollup (null cluster or type: all)."""
    return risk.join(members, "track_id").rollup("cluster_id", "type").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))
