"""Geometry and kinematics of single tracks: windows over point order, then one aggregation by track.

All functions take points (track_id, seq, x, y, z, v, t).  ``steps`` adds the neighbours' values in one window, so every
operator costs one shuffle by track.  Angles are radians unless the name says degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KT_TO_FT_S, GRAVITY = 1.68781, 32.174
#: The origin of the local frame and feet in a degree of latitude.
ORIGIN_LAT, ORIGIN_LON, FT_PER_DEG = 37.6188056, -122.3754167, 364000.0

e = F.expr


def steps(points: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Points with differences to the previous (d*) and next (e*) point, the number of points, and flags at the ends."""
    order = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys)
    out = points.withColumn("n", F.count("*").over(whole))
    out = out.withColumns({f"p{c}": F.lag(c).over(order) for c in "xyzvt"} | {f"f{c}": F.lead(c).over(order) for c in "xyzvt"})
    out = out.withColumns({f"d{c}": F.col(c) - F.col(f"p{c}") for c in "xyzvt"} | {f"e{c}": F.col(f"f{c}") - F.col(c) for c in "xyzvt"})
    return out


def norm(*parts: str) -> Column:
    return e("sqrt(" + " + ".join(f"{p} * {p}" for p in parts) + ")")


TURN_3D = "acos(greatest(-1D, least(1D, (dx * ex + dy * ey + dz * ez) / (sqrt(dx * dx + dy * dy + dz * dz) * sqrt(ex * ex + ey * ey + ez * ez) + 1e-8D))))"
COURSE = "degrees(acos(greatest(-1D, least(1D, (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) + 1e-8D)))))"
_AREA = "(abs(dx * (dy + ey) - dy * (dx + ex)) / 2)"
RADIUS = f"if({_AREA} < 1e-8D, 0D, sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) * sqrt((dx + ex) * (dx + ex) + (dy + ey) * (dy + ey)) / (4 * {_AREA}))"
BANK = "degrees(atan(v * 1.68781D * v * 1.68781D / (32.174D * radius)))"
INNER = "px is not null and fx is not null"


def path_length(points: DataFrame) -> DataFrame:
    """3-D length, and the 2-D length of whole feet per segment; 0 for a single point."""
    return steps(points).groupBy("track_id").agg(F.coalesce(F.sum(norm("dx", "dy", "dz")), F.lit(0.0)).alias("length_3d"), F.coalesce(F.sum(norm("dx", "dy").cast("long")), F.lit(0)).alias("length_int"))


def glide_angle(points: DataFrame) -> DataFrame:
    """Degrees of the drop from the mean of the first five heights to that of the last five over the 3-D length; 0 below ten points."""
    s = steps(points)
    agg = s.groupBy("track_id").agg(F.max("n").alias("n"), F.avg(e("if(seq <= 5, z, null)")).alias("a"), F.avg(e("if(seq > n - 5, z, null)")).alias("b"), F.sum(norm("dx", "dy", "dz")).alias("len"))
    return agg.select("track_id", e("if(n < 10 or coalesce(len, 0D) <= 0, 0D, degrees(atan2(a - b, len)))").alias("glide_deg"))


def whole_number_profile(points: DataFrame, reference_speed: int = 70) -> DataFrame:
    """Glide angle, vertical speed and energy in whole numbers from a track's ends."""
    g = points.groupBy("track_id").agg(*(F.min_by(c, "seq").alias(f"a{c}") for c in "xyzt"), *(F.max_by(c, "seq").alias(f"b{c}") for c in "xyztv"))
    far = "sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))"
    return g.select(
        "track_id",
        e(f"if({far} = 0, 0, cast(degrees(atan2(az - bz, {far})) as bigint))").alias("glide_int"),
        e("if(bt = at, 0, cast((bz - az) / (bt - at) as bigint))").alias("vertical_speed"),
        e(f"cast(floor(bv * bv / ({reference_speed} * {reference_speed})) + floor(bz / 1000) as bigint)").alias("energy"),
    )


def curvature_radius(points: DataFrame) -> DataFrame:
    """Mean of step / (2 sin(angle / 2)) over turns above 0.01; 0 without one."""
    s = steps(points).withColumn("angle", F.when(e(INNER), e(TURN_3D)))
    radius = e("if(angle > 0.01D, sqrt(dx * dx + dy * dy + dz * dz) / (2 * sin(angle / 2)), null)")
    return s.groupBy("track_id").agg(F.coalesce(F.avg(radius), F.lit(0.0)).alias("curvature_radius"))


def kinematics(points: DataFrame) -> DataFrame:
    """Speeds, vertical speed, acceleration, and the deviation of x from a straight line over the index (above ten points)."""
    s = steps(points).withColumn("i", (F.col("seq") - 1).cast("double"))
    agg = s.groupBy("track_id").agg(
        F.avg("v").alias("mean_speed"),
        F.max("v").alias("max_speed"),
        F.coalesce(F.avg(e("abs(dz / (dt + 1e-8D))")), F.lit(0.0)).alias("mean_vertical_speed"),
        F.coalesce(F.max(e("abs(dv / (dt + 1e-8D))")), F.lit(0.0)).alias("max_acceleration"),
        F.count("*").alias("n"),
        F.var_pop("x").alias("vx"),
        F.covar_pop("x", "i").alias("cxi"),
        F.var_pop("i").alias("vi"),
    )
    return agg.select("track_id", "mean_speed", "max_speed", "mean_vertical_speed", "max_acceleration", e("if(n > 10, sqrt(greatest(0D, vx - cxi * cxi / vi)), 0D)").alias("std_deviation"))


def bounds(points: DataFrame) -> DataFrame:
    """One row with the smallest and largest coordinates; zeros for no points."""
    return points.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def turns(points: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Inner points with circumradius in the plane, course change and bank at the point's speed (0 where the radius is 0)."""
    s = steps(points, keys).where(INNER).withColumns({"radius": e(RADIUS), "course_change": e(COURSE)})
    return s.withColumn("bank", F.when(F.col("radius") > 0, e(BANK)).otherwise(F.lit(0.0)))


def turn_bank_profile(points: DataFrame) -> DataFrame:
    t = turns(points).where("radius > 0")
    return t.groupBy("track_id").agg(F.count("*").alias("turns"), F.min("radius").alias("min_radius"), F.max("radius").alias("max_radius"), F.max("bank").alias("max_bank"), F.percentile("bank", 0.95).alias("p95_bank"))


def course_change(points: DataFrame) -> DataFrame:
    return turns(points).groupBy("track_id").agg(F.max("course_change").alias("max_change"), F.avg("course_change").alias("mean_change"))


def mean_curvature(points: DataFrame) -> DataFrame:
    """Mean 3-D turn; 0 below three points."""
    return steps(points).groupBy("track_id").agg(F.coalesce(F.avg(F.when(e(INNER), e(TURN_3D))), F.lit(0.0)).alias("mean_curvature"))


def ends(points: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(*(F.min_by(c, "seq").alias(f"a{c}") for c in "xyzt"), *(F.max_by(c, "seq").alias(f"b{c}") for c in "xyzt"))


def descent_gradient(points: DataFrame) -> DataFrame:
    """Drop over the distance of the ends in the plane."""
    return ends(points).select("track_id", e("(az - bz) / (sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) + 1e-8D)").alias("gradient"))


def segment_gradients(points: DataFrame) -> DataFrame:
    s = steps(points).where("sqrt(dx * dx + dy * dy) > 1e-8")
    return s.select("track_id", "seq", e("-dz / sqrt(dx * dx + dy * dy)").alias("gradient"))


def angle_series(points: DataFrame) -> DataFrame:
    """Vertical angle and heading (degrees) and speed of every segment."""
    s = steps(points).where("px is not null")
    return s.select("track_id", "seq", e("degrees(atan2(dz, sqrt(dx * dx + dy * dy) + 1e-8D))").alias("vertical_deg"), e("degrees(atan2(dy, dx))").alias("heading_deg"), "v")


def velocities(points: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Points with vx, vy, vz; equal times count as 1e-8 s apart; the first point has the first segment's velocity."""
    s = steps(points, keys)
    v = {f"v{c}": e(f"coalesce(d{c} / if(dt = 0, 1e-8D, dt), e{c} / if(et = 0, 1e-8D, et), 0D)") for c in "xyz"}
    return s.withColumns(v).select(*points.columns, "vx", "vy", "vz")


def acceleration_max(points: DataFrame, least_dt: float = 1.0) -> DataFrame:
    """Largest norm of velocity change over time, with times floored; 0 below three points."""
    s = steps(points)
    a, b = f"greatest(dt, {least_dt}D)", f"greatest(et, {least_dt}D)"
    norm_ = "sqrt(" + " + ".join(f"pow((e{c} / {b} - d{c} / {a}) / {b}, 2)" for c in "xyz") + ")"
    return s.groupBy("track_id").agg(F.coalesce(F.max(F.when(e(INNER), e(norm_))), F.lit(0.0)).alias("max_acceleration"))


def radar_jump(points: DataFrame, limit: float = 96.5) -> DataFrame:
    """The point after the largest velocity change (not divided by time) if it exceeds ``limit``, else null."""
    s = steps(points).where(INNER)
    jump = "sqrt(" + " + ".join(f"pow(e{c} / if(et = 0, 1e-8D, et) - d{c} / if(dt = 0, 1e-8D, dt), 2)" for c in "xyz") + ")"
    best = s.select("track_id", "seq", e(jump).alias("jump")).groupBy("track_id").agg(F.max("jump").alias("jump"), F.max_by("seq", F.struct("jump", -F.col("seq"))).alias("seq"))
    return best.select("track_id", F.when(F.col("jump") > limit, F.col("seq")).alias("jump_seq"))


def duration(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg((F.max("t") - F.min("t")).alias("duration"))


def mean_duration(points: DataFrame) -> DataFrame:
    return duration(points).where("duration > 0").agg(F.coalesce(F.avg("duration"), F.lit(0.0)).alias("mean_duration"))


def direction(points: DataFrame) -> DataFrame:
    """Unit vector from the first to the last point; zero where they are closer than 1e-8."""
    d = ends(points).select("track_id", *(e(f"b{c} - a{c}").alias(c) for c in "xyz")).withColumn("len", norm("x", "y", "z"))
    return d.select("track_id", *(e(f"if(len < 1e-8, 0D, {c} / len)").alias(f"u{c}") for c in "xyz"))


def curvature_signature(points: DataFrame) -> DataFrame:
    """3-D turn at every inner point."""
    return steps(points).where(INNER).select("track_id", "seq", e(TURN_3D).alias("turn"))


def resample(points: DataFrame, target: int, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(keys, step, x, y, z): linear interpolation on the normalised index to ``target`` points."""
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    return interpolated(packed.withColumn("m", F.lit(target)), keys)


def interpolated(packed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points of the arrays ``p`` at ``m`` even places."""
    rows = packed.withColumn("n", F.size("p")).select(*keys, "p", "n", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("step"))
    rows = rows.withColumn("at", e("if(m <= 1, 0D, step * (n - 1) / cast(m - 1 as double))")).withColumn("lo", e("cast(least(floor(at), n - 1) as int)"))
    rows = rows.withColumns({"a": e("element_at(p, lo + 1)"), "b": e("element_at(p, least(lo + 2, n))"), "w": e("at - lo")})
    return rows.select(*keys, "step", *(e(f"a.{c} + w * (b.{c} - a.{c})").alias(c) for c in "xyz"))


def seconds_of_day(text: Column) -> Column:
    """Seconds of ``HH:MM:SS`` or ``HHMMSS``; 0 for anything else."""
    t = F.trim(F.coalesce(text, F.lit("")))
    part = lambda i: F.coalesce(F.try_element_at(F.split(t, ":"), F.lit(i)).try_cast("double"), F.lit(0.0))
    plain = F.substring(t, 1, 2).try_cast("double") * 3600 + F.substring(t, 3, 2).try_cast("double") * 60 + F.substring(t, 5, 2).try_cast("double")
    return F.when(t.rlike(r"^\d+:\d+(:\d+(\.\d+)?)?$"), part(1) * 3600 + part(2) * 60 + part(3)).when(t.rlike(r"^\d{6}$"), plain).otherwise(F.lit(0.0))


def wgs84(points: DataFrame) -> DataFrame:
    scale = f"({FT_PER_DEG}D * cos(radians({ORIGIN_LAT}D)) + 1e-8D)"
    return points.withColumns({"lat": e(f"{ORIGIN_LAT}D + y / {FT_PER_DEG}D"), "lon": e(f"{ORIGIN_LON}D + x / {scale}")})


def segment_distance(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> Column:
    """Distance of a point to a segment in the plane."""
    length = f"(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))"
    u = f"if({length} = 0, 0D, greatest(0D, least(1D, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {length})))"
    return e(f"sqrt(pow({px} - ({ax} + {u} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {u} * ({by} - {ay})), 2))")


def chord_distance(points: DataFrame) -> DataFrame:
    """Largest distance of a track's points to the segment between its ends."""
    p = points.join(ends(points).select("track_id", "ax", "ay", "bx", "by"), "track_id")
    return p.groupBy("track_id").agg(F.max(segment_distance("x", "y", "ax", "ay", "bx", "by")).alias("max_offset"))


def map_points(points: DataFrame, width: float = 800.0, height: float = 600.0) -> DataFrame:
    """Places on a map of the given size: each axis scaled to the extent of all points, y upwards."""
    unit = lambda c: f"if(max_{c} = min_{c}, 0.5D, ({c} - min_{c}) / (max_{c} - min_{c}))"
    p = points.crossJoin(F.broadcast(bounds(points)))
    return p.select("track_id", "seq", e(f"{unit('x')} * {width}D").alias("px"), e(f"(1 - {unit('y')}) * {height}D").alias("py"))


def minimum_jerk(points: DataFrame, least: float = 60.0) -> DataFrame:
    """Rest-to-rest quintic coefficients from the first to the last point, one row for each axis."""
    g = ends(points).withColumn("d", e(f"greatest({least}D, bt - at)"))
    axes = [F.struct(F.lit(c).alias("axis"), F.col(f"a{c}").alias("a0"), e(f"10 * (b{c} - a{c}) / pow(d, 3)").alias("a3"), e(f"-15 * (b{c} - a{c}) / pow(d, 4)").alias("a4"), e(f"6 * (b{c} - a{c}) / pow(d, 5)").alias("a5")) for c in "xyz"]
    return g.select("track_id", "d", F.inline(F.array(*axes)))


def protection_line(points: DataFrame, gradient: float = 0.052) -> DataFrame:
    """Height of the protection surface above the last point's at the first point's distance, along x."""
    return ends(points).select("track_id", e(f"bz + abs(ax - bx) * {gradient}D").alias("surface_z"))
