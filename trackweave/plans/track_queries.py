"""Queries of the single-track operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import geometry as g
from trackweave.sources.adapters import flights, trackpoints

from .registry import register

TURN = "acos(greatest(-1, least(1, (dx*ex + dy*ey + dz*ez) / (sqrt(dx*dx + dy*dy + dz*dz) * sqrt(ex*ex + ey*ey + ez*ez) + 1e-8))))"
AREA = "(abs(dx * (dy + ey) - dy * (dx + ex)) / 2)"
RADIUS = f"case when {AREA} < 1e-8 then 0 else sqrt(dx*dx + dy*dy) * sqrt(ex*ex + ey*ey) * sqrt((dx+ex)*(dx+ex) + (dy+ey)*(dy+ey)) / (4 * {AREA}) end"
COURSE = "degrees(acos(greatest(-1, least(1, (dx*ex + dy*ey) / (sqrt(dx*dx + dy*dy) * sqrt(ex*ex + ey*ey) + 1e-8)))))"
INNER = "px is not null and fx is not null"


def r(expr: str, name: str) -> str:
    return f"round(cast({expr} as double), 6) as {name}"


@register("turn_bank_profile", f"""
with turn as (select track_id, v, {RADIUS} as radius from st where {INNER}),
bank as (select track_id, radius, degrees(atan(power(v * 1.68781, 2) / (32.174 * radius))) as bank from turn where radius > 0)
select track_id, count(*) as turns, {r('min(radius)', 'min_radius')}, {r('max(radius)', 'max_radius')}, {r('max(bank)', 'max_bank')}, {r('quantile_cont(bank, 0.95)', 'p95_bank')}
from bank group by track_id""")
def turn_bank_profile(spark: SparkSession, d: str) -> DataFrame:
    return g.turn_bank_profile(trackpoints(spark, d))


@register("path_length", f"""
select track_id, {r('coalesce(sum(sqrt(dx*dx + dy*dy + dz*dz)), 0)', 'length_3d')}, cast(coalesce(sum(trunc(sqrt(dx*dx + dy*dy))), 0) as bigint) as length_int
from st group by track_id""")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    return g.path_length(trackpoints(spark, d))


@register("glide_angle", f"""
select track_id, {r('case when max(n) < 10 then 0 else degrees(atan2(avg(z) filter (seq <= 5) - avg(z) filter (seq > n - 5), sum(sqrt(dx*dx + dy*dy + dz*dz)))) end', 'glide_deg')}
from st group by track_id""")
def glide_angle(spark: SparkSession, d: str) -> DataFrame:
    return g.glide_angle(trackpoints(spark, d))


@register("whole_number_profile", """
with far as (select *, sqrt(power(qx - ax, 2) + power(qy - ay, 2)) as h from ends),
last as (select track_id, arg_max(v, seq) as bv from tp group by track_id)
select track_id, cast(case when h = 0 then 0 else trunc(degrees(atan2(az - qz, h))) end as bigint) as glide_int,
       cast(case when t1 = t0 then 0 else trunc((qz - az) / (t1 - t0)) end as bigint) as vertical_speed,
       cast(floor(bv * bv / 4900) + floor(qz / 1000) as bigint) as energy
from far join last using (track_id)""")
def whole_number_profile(spark: SparkSession, d: str) -> DataFrame:
    return g.whole_number_profile(trackpoints(spark, d))


@register("curvature_radius", f"""
with a as (select track_id, case when {INNER} then {TURN} end as angle, sqrt(dx*dx + dy*dy + dz*dz) as len from st)
select track_id, {r('coalesce(avg(len / (2 * sin(angle / 2))) filter (angle > 0.01), 0)', 'curvature_radius')} from a group by track_id""")
def curvature_radius(spark: SparkSession, d: str) -> DataFrame:
    return g.curvature_radius(trackpoints(spark, d))


@register("kinematics", f"""
with line as (select track_id, regr_slope(x, seq) as b, regr_intercept(x, seq) as a, count(*) as n from tp group by track_id),
dev as (select tp.track_id, case when max(n) > 10 then stddev_pop(x - (a + b * seq)) else 0 end as sd from tp join line using (track_id) group by tp.track_id)
select track_id, {r('avg(v)', 'mean_speed')}, {r('max(v)', 'max_speed')}, {r('coalesce(avg(abs(dz / (dt + 1e-8))), 0)', 'mean_vertical_speed')},
       {r('coalesce(max(abs(dv / (dt + 1e-8))), 0)', 'max_acceleration')}, round(any_value(sd), 3) as std_deviation
from st join dev using (track_id) group by track_id""")
def kinematics(spark: SparkSession, d: str) -> DataFrame:
    return g.kinematics(trackpoints(spark, d)).withColumn("std_deviation", F.round("std_deviation", 3))


@register("bounds", "select " + ", ".join(r(f"{f}({c})", f"{f}_{c}") for c in "xyz" for f in ("min", "max")) + " from tp")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return g.bounds(trackpoints(spark, d))


@register("course_change", f"select track_id, {r(f'max({COURSE})', 'max_change')}, {r(f'avg({COURSE})', 'mean_change')} from st where {INNER} group by track_id")
def course_change(spark: SparkSession, d: str) -> DataFrame:
    return g.course_change(trackpoints(spark, d))


@register("mean_curvature", f"select track_id, {r(f'coalesce(avg(case when {INNER} then {TURN} end), 0)', 'mean_curvature')} from st group by track_id")
def mean_curvature(spark: SparkSession, d: str) -> DataFrame:
    return g.mean_curvature(trackpoints(spark, d))


@register("descent_gradient", f"select track_id, {r('(az - qz) / (sqrt(power(qx - ax, 2) + power(qy - ay, 2)) + 1e-8)', 'gradient')} from ends")
def descent_gradient(spark: SparkSession, d: str) -> DataFrame:
    return g.descent_gradient(trackpoints(spark, d))


@register("segment_gradients", f"select track_id, seq, {r('-dz / sqrt(dx*dx + dy*dy)', 'gradient')} from st where sqrt(dx*dx + dy*dy) > 1e-8")
def segment_gradients(spark: SparkSession, d: str) -> DataFrame:
    return g.segment_gradients(trackpoints(spark, d))


@register("angle_series", f"select track_id, seq, {r('degrees(atan2(dz, sqrt(dx*dx + dy*dy) + 1e-8))', 'vertical_deg')}, {r('degrees(atan2(dy, dx))', 'heading_deg')}, v from st where px is not null")
def angle_series(spark: SparkSession, d: str) -> DataFrame:
    return g.angle_series(trackpoints(spark, d))


_V = {c: f"coalesce(d{c} / case when dt = 0 then 1e-8 else dt end, e{c} / case when et = 0 then 1e-8 else et end, 0)" for c in "xyz"}


@register("velocity_vectors", "select track_id, seq, " + ", ".join(r(_V[c], f"v{c}") for c in "xyz") + " from st")
def velocity_vectors(spark: SparkSession, d: str) -> DataFrame:
    return g.velocities(trackpoints(spark, d)).select("track_id", "seq", "vx", "vy", "vz")


_A = " + ".join(f"power((e{c} / greatest(et, 1) - d{c} / greatest(dt, 1)) / greatest(et, 1), 2)" for c in "xyz")


@register("acceleration_max", f"select track_id, {r(f'coalesce(max(case when {INNER} then sqrt({_A}) end), 0)', 'max_acceleration')} from st group by track_id")
def acceleration_max(spark: SparkSession, d: str) -> DataFrame:
    return g.acceleration_max(trackpoints(spark, d))


_J = " + ".join(f"power(e{c} / case when et = 0 then 1e-8 else et end - d{c} / case when dt = 0 then 1e-8 else dt end, 2)" for c in "xyz")


@register("radar_jump", f"""
with j as (select track_id, seq, sqrt({_J}) as jump from st where {INNER})
select track_id, case when jump > 0.5 then seq end as jump_seq from (select *, row_number() over (partition by track_id order by jump desc, seq) as rn from j) where rn = 1""")
def radar_jump(spark: SparkSession, d: str) -> DataFrame:
    return g.radar_jump(trackpoints(spark, d), limit=0.5)


@register("track_duration", f"select track_id, {r('max(t) - min(t)', 'duration')} from tp group by track_id")
def track_duration(spark: SparkSession, d: str) -> DataFrame:
    return g.duration(trackpoints(spark, d))


@register("mean_duration", f"select {r('avg(d)', 'mean_duration')} from (select max(t) - min(t) as d from tp group by track_id) where d > 0")
def mean_duration(spark: SparkSession, d: str) -> DataFrame:
    return g.mean_duration(trackpoints(spark, d))


_LEN = "sqrt(power(qx - ax, 2) + power(qy - ay, 2) + power(qz - az, 2))"


@register("trajectory_vector", "select track_id, " + ", ".join(r(f"case when {_LEN} < 1e-8 then 0 else (q{c} - a{c}) / {_LEN} end", f"u{c}") for c in "xyz") + " from ends")
def trajectory_vector(spark: SparkSession, d: str) -> DataFrame:
    return g.direction(trackpoints(spark, d))


@register("curvature_signature", f"select track_id, seq, {r(TURN, 'turn')} from st where {INNER}")
def curvature_signature(spark: SparkSession, d: str) -> DataFrame:
    return g.curvature_signature(trackpoints(spark, d))


@register("resample", """
with spots as (select track_id, step, step * (n - 1) / 19.0 as p, n from (select track_id, count(*) as n from tp group by track_id), (select unnest(range(0, 20)) as step)),
lo as (select *, least(floor(p), n - 1) as l from spots)
select lo.track_id, step, """ + ", ".join(r(f"a.{c} + (p - l) * (b.{c} - a.{c})", c) for c in "xyz") + """
from lo join tp a on a.track_id = lo.track_id and a.seq = l + 1 join tp b on b.track_id = lo.track_id and b.seq = least(l + 2, n)""", "tp")
def resample(spark: SparkSession, d: str) -> DataFrame:
    return g.resample(trackpoints(spark, d), 20)


@register("parse_time", """
select track_id, cast(split_part(trackstart_time, ':', 1) as double) * 3600 + cast(split_part(trackstart_time, ':', 2) as double) * 60 + cast(split_part(trackstart_time, ':', 3) as double) as start_tod
from flights""", "flights")
def parse_time(spark: SparkSession, d: str) -> DataFrame:
    return flights(spark, d).select("track_id", g.seconds_of_day(F.col("trackstart_time")).alias("start_tod"))


@register("chord_distance", f"""
with p as (
  select tp.*, ax, ay, qx, qy, power(qx - ax, 2) + power(qy - ay, 2) as l2 from tp join ends using (track_id)),
q as (select *, case when l2 = 0 then 0 else greatest(0, least(1, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / l2)) end as u from p)
select track_id, {r('max(sqrt(power(x - (ax + u * (qx - ax)), 2) + power(y - (ay + u * (qy - ay)), 2)))', 'max_offset')} from q group by track_id""")
def chord_distance(spark: SparkSession, d: str) -> DataFrame:
    return g.chord_distance(trackpoints(spark, d))


@register("wgs84_points", f"select track_id, seq, {r('37.6188056 + y / 364000', 'lat')}, {r('-122.3754167 + x / (364000 * cos(radians(37.6188056)) + 1e-8)', 'lon')} from tp", "tp")
def wgs84_points(spark: SparkSession, d: str) -> DataFrame:
    return g.wgs84(trackpoints(spark, d)).select("track_id", "seq", "lat", "lon")


@register("map_points", f"""
with b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from tp)
select track_id, seq, {r('(x - x0) / (x1 - x0) * 800', 'px')}, {r('(1 - (y - y0) / (y1 - y0)) * 600', 'py')} from tp, b""", "tp")
def map_points(spark: SparkSession, d: str) -> DataFrame:
    return g.map_points(trackpoints(spark, d))


@register("min_jerk", "with e as (select *, greatest(60, t1 - t0) as d from ends) " + " union all ".join(
    f"select track_id, round(d, 6) as d, '{c}' as axis, {r(f'a{c}', 'a0')}, {r(f'10 * (q{c} - a{c}) / power(d, 3)', 'a3')}, {r(f'-15 * (q{c} - a{c}) / power(d, 4)', 'a4')}, {r(f'6 * (q{c} - a{c}) / power(d, 5)', 'a5')} from e" for c in "xyz"))
def min_jerk(spark: SparkSession, d: str) -> DataFrame:
    return g.minimum_jerk(trackpoints(spark, d))


@register("protection_line", f"select track_id, {r('qz + abs(ax - qx) * 0.052', 'surface_z')} from ends")
def protection_line(spark: SparkSession, d: str) -> DataFrame:
    return g.protection_line(trackpoints(spark, d))
