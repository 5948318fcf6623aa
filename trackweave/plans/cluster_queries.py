"""Queries of sectors, workload and runways over a fixed cluster assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.operators import runway as rw
from trackweave.operators import sector as sc
from trackweave.operators import workload as wl
from trackweave.sources.adapters import flights, members, trackpoints

from .registry import register
from .track_queries import INNER, TURN, r

BOX = """
cp as (select m.cluster_id, tp.* replace (tp.t_abs % 7200 as t_abs) from tp join member m using (track_id)),
box as (
  select cluster_id, min(x) - 1215.2 as min_x, max(x) + 1215.2 as max_x, min(y) - 1215.2 as min_y, max(y) + 1215.2 as max_y,
         min(z) - 300 as min_z, max(z) + 300 as max_z, greatest(0, quantile_cont(z, 0.02) - 300) as floor_ft, quantile_cont(z, 0.98) + 300 as ceiling_ft
  from cp group by cluster_id having count(*) >= 4)"""
#: A smaller box and two faces of a hull across it, so that points lie inside and outside of either.
CORE = BOX + """,
core as (select cluster_id, min_x + (max_x - min_x) * 0.2 as min_x, max_x, min_y, max_y, min_z + 1000 as min_z, max_z from box)"""
FACES = """,
face as (
  select cluster_id, sqrt(0.5) as nx, sqrt(0.5) as ny, -(min(x + y) + 0.8 * (max(x + y) - min(x + y))) * sqrt(0.5) as d from cp group by cluster_id
  union all select cluster_id, -sqrt(0.5), sqrt(0.5), -(min(y - x) + 0.9 * (max(y - x) - min(y - x))) * sqrt(0.5) from cp group by cluster_id)"""
SAMPLES = CORE + FACES + """,
vel as (
  select track_id, seq, coalesce(dx / case when dt = 0 then 1e-8 else dt end, ex / case when et = 0 then 1e-8 else et end, 0) as vx,
         coalesce(dy / case when dt = 0 then 1e-8 else dt end, ey / case when et = 0 then 1e-8 else et end, 0) as vy,
         coalesce(dz / case when dt = 0 then 1e-8 else dt end, ez / case when et = 0 then 1e-8 else et end, 0) as vz from st),
ins as (
  select cp.*, vx, vy, vz from cp join core c using (cluster_id) join vel using (track_id, seq)
  where x between c.min_x and c.max_x and y between c.min_y and c.max_y and z between c.min_z and c.max_z
    and not exists (select 1 from face f where f.cluster_id = cp.cluster_id and f.nx * x + f.ny * y + f.d > 1215.2))"""
METRICS = SAMPLES + f""",
ist as (
  select *, x - px as dx, y - py as dy, z - pz as dz, fx - x as ex, fy - y as ey, fz - z as ez from (
    select *, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz, lead(x) over w as fx, lead(y) over w as fy, lead(z) over w as fz
    from ins window w as (partition by cluster_id, track_id order by seq))),
met0 as (
  select cluster_id, track_id, greatest(0, arg_max(t, seq) - arg_min(t, seq)) as dwell, coalesce(avg(case when {INNER} then {TURN} end), 0) as curvature,
         (arg_min(z, seq) - arg_max(z, seq)) / (sqrt(power(arg_max(x, seq) - arg_min(x, seq), 2) + power(arg_max(y, seq) - arg_min(y, seq), 2)) + 1e-8) as gradient,
         arg_min(t_abs, seq) as entry_time, arg_max(t_abs, seq) as exit_time from ist group by cluster_id, track_id),
met as (
  select m.*, 1 + 0.7 * least(1, curvature / 0.25) + 0.5 * least(1, abs(gradient) / 0.12)
         + case when regexp_matches(lower(aircrafttype || ' ' || aircraft_category), 'heavy|b747|b777|a340|a380|mil|military') then 0.2 else 0 end as complexity
  from met0 m join flights using (track_id))"""
OCC = """,
occ as (select cluster_id, cast(floor(t_abs / 300) as bigint) as bin, count(distinct track_id) as aircraft from ins group by all),
wocc as (
  select cluster_id, sum(w) as weighted from (
    select p.cluster_id, bin, count(*) * avg(coalesce(complexity, 1)) as w
    from (select distinct cluster_id, cast(floor(t_abs / 300) as bigint) as bin, track_id from ins) p left join met using (cluster_id, track_id) group by all) group by cluster_id)"""
CONF = """,
pairs as (
  select a.cluster_id, cast(floor(a.t_abs / 60) as bigint) as bin, a.track_id as track_a, b.track_id as track_b, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as h,
         abs(a.z - b.z) as v, (a.t_abs + b.t_abs) / 2 as tm,
         -((b.x - a.x) * (b.vx - a.vx) + (b.y - a.y) * (b.vy - a.vy) + (b.z - a.z) * (b.vz - a.vz)) as closing,
         (a.vx * b.vx + a.vy * b.vy + a.vz * b.vz) / (sqrt(a.vx * a.vx + a.vy * a.vy + a.vz * a.vz) * sqrt(b.vx * b.vx + b.vy * b.vy + b.vz * b.vz) + 1e-8) as cosine
  from ins a join ins b on a.cluster_id = b.cluster_id and floor(a.t_abs / 60) = floor(b.t_abs / 60) and a.track_id < b.track_id
  where abs(a.z - b.z) <= 1000 and power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 18228.0 * 18228.0),
conv as (select *, case when closing <= 0 then 0 else least(1, closing / 10000) * (0.5 + 0.5 * greatest(0, -cosine)) end as c from pairs),
conf as (
  select cluster_id, bin, track_a, track_b, h as horizontal_ft, tm as time, v as vertical_ft, c as convergence,
         case when h / 18228 < 0.5 and v / 1000 < 0.5 and c > 0.6 then 'HIGH' when h / 18228 < 0.8 and v / 1000 < 0.8 then 'MEDIUM' else 'LOW' end as severity
  from (select *, row_number() over (partition by cluster_id, bin, track_a, track_b order by h, tm, v, c) as rn from conv where c > 0) where rn = 1)"""
#: Events are weeks apart; the queries of sectors take their times within two hours, so tracks meet.
SPAN = 7200


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    points, tracks = trackpoints(spark, d), flights(spark, d)
    clustered = sc.cluster_points(points, members(tracks)).withColumn("t_abs", F.col("t_abs") % SPAN)
    boxes = sc.sector_bounds(clustered)
    core = boxes.withColumns({"min_x": F.expr("min_x + (max_x - min_x) * 0.2D"), "min_z": F.col("min_z") + 1000})
    return clustered, tracks, boxes, core


def _faces(clustered: DataFrame) -> DataFrame:
    """Two faces for each cluster: (cluster_id, equations)."""
    g = clustered.groupBy("cluster_id").agg(F.min(F.expr("x + y")).alias("a"), F.max(F.expr("x + y")).alias("b"), F.min(F.expr("y - x")).alias("c"), F.max(F.expr("y - x")).alias("d"))
    return g.select("cluster_id", F.expr("array(array(sqrt(0.5D), sqrt(0.5D), 0D, -(a + 0.8D * (b - a)) * sqrt(0.5D)), array(-sqrt(0.5D), sqrt(0.5D), 0D, -(c + 0.9D * (d - c)) * sqrt(0.5D)))").alias("equations"))


def _inside(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    clustered, tracks, _, core = _parts(spark, d)
    return wl.samples(clustered, core, _faces(clustered)), tracks, core


@register("sector_bounds", f"with {BOX} select cluster_id, " + ", ".join(r(c, c) for c in ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "floor_ft", "ceiling_ft")) + ", round((max_x - min_x) * (max_y - min_y) * (max_z - min_z), 0) as volume from box", "tp member")
def sector_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[2].withColumn("volume", F.round("volume", 0))


BOUND = CORE + """,
inb as (select cp.* from cp join core c using (cluster_id) where x between c.min_x and c.max_x and y between c.min_y and c.max_y and z between c.min_z and c.max_z),
bp as (
  select cluster_id, track_id, 'ENTRY' as kind, arg_min(x, seq) as x, arg_min(y, seq) as y, arg_min(z, seq) as z from inb group by all
  union all select cluster_id, track_id, 'EXIT', arg_max(x, seq), arg_max(y, seq), arg_max(z, seq) from inb group by all)"""


@register("entry_exit", f"with {BOUND} select * from bp", "tp member")
def entry_exit(spark: SparkSession, d: str) -> DataFrame:
    clustered, _, _, core = _parts(spark, d)
    return sc.boundary_points(clustered, core)


FIXES = BOUND + """,
link as (select a.cluster_id, a.kind, a.track_id as a, b.track_id as b from bp a join bp b on a.cluster_id = b.cluster_id and a.kind = b.kind where power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 2500.0 * 2500.0),
reach as (select cluster_id, kind, a as track_id, a as root from link union select r.cluster_id, r.kind, l.b, r.root from reach r join link l on l.cluster_id = r.cluster_id and l.kind = r.kind and l.a = r.track_id),
comp as (select cluster_id, kind, track_id, min(cast(root as varchar)) as comp from reach group by all),
sized as (select bp.*, comp, count(*) over (partition by cluster_id, kind, comp) as n from bp join comp using (cluster_id, kind, track_id)),
grp as (select *, case when max(n) over (partition by cluster_id, kind) > 1 then comp else '' end as g, max(n) over (partition by cluster_id, kind) as mx from sized),
kept as (select * from grp where n > 1 or mx = 1),
ctr as (select cluster_id, kind, g, avg(x) as cx, avg(y) as cy, avg(z) as cz, count(distinct track_id) as track_count from kept group by all)"""


@register("sector_fixes", f"""
with recursive {FIXES}
select cluster_id, kind, round(cx, 4) as x, round(cy, 4) as y, round(cz, 4) as z, cast(any_value(track_count) as bigint) as track_count, round(max(sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2))), 4) as radius_ft
from kept join ctr using (cluster_id, kind, g) group by cluster_id, kind, g, cx, cy, cz""", "tp member")
def sector_fixes(spark: SparkSession, d: str) -> DataFrame:
    clustered, _, _, core = _parts(spark, d)
    return sc.fixes(sc.boundary_points(clustered, core)).select("cluster_id", "kind", *(F.round(c, 4).alias(c) for c in ("x", "y", "z", "radius_ft")), "track_count")


_ZONES = [("Z1", 1e5, 2e5, -1e4, 5e4, 0.0, 9000.0), ("Z2", 0.0, 5e4, -5e4, 1e4, 3000.0, 20000.0), ("Z3", 3e5, None, 0.0, 1.0, 0.0, 1.0), ("Z4", -1e9, -1e8, 0.0, 1.0, 0.0, 1.0)]
_ZSQL = "zones(id, min_x, max_x, min_y, max_y, min_z, max_z) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"cast({v} as double)" for v in z) + ")" for z in _ZONES) + ")"


def _zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ZONES, "id string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")


@register("zone_conflicts", f"with {BOX},{_ZSQL} select cluster_id, id as zone from box b join zones z on " + " and ".join(f"b.min_{c} <= z.max_{c} and z.min_{c} <= b.max_{c}" for c in "xyz"), "tp member")
def zone_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return sc.zone_conflicts(_parts(spark, d)[2], _zones(spark))


def _trim_sql() -> str:
    text, prev = f"with {BOX},{_ZSQL}", "box"
    for k, z in enumerate(z for z in _ZONES if None not in z):
        lim = {f"{m}_{c}": z[1 + 2 * i + j] for i, c in enumerate("xyz") for j, m in enumerate(("min", "max"))}
        touch = " and ".join(f"min_{c} <= {lim[f'max_{c}']} and {lim[f'min_{c}']} <= max_{c}" for c in "xyz")
        over = {c: f"(least(max_{c}, {lim[f'max_{c}']}) - greatest(min_{c}, {lim[f'min_{c}']}))" for c in "xyz"}
        axis = "case " + " ".join(f"when {over[c]} > 0 and {over[c]} = list_min(list_filter([{', '.join(over.values())}], lambda v: v > 0)) then '{c}'" for c in "xyz") + " end"
        text += f", o{k} as (select *, case when {touch} then {axis} end as axis from {prev})"
        cols = []
        for c in "xyz":
            below = f"(min_{c} + max_{c}) / 2 <= ({lim[f'min_{c}']} + {lim[f'max_{c}']}) / 2"
            cols.append(f"case when axis = '{c}' and not {below} and greatest(min_{c}, {lim[f'max_{c}']}) < max_{c} then greatest(min_{c}, {lim[f'max_{c}']}) else min_{c} end as min_{c}")
            cols.append(f"case when axis = '{c}' and {below} and min_{c} < least(max_{c}, {lim[f'min_{c}']}) then least(max_{c}, {lim[f'min_{c}']}) else max_{c} end as max_{c}")
        text += f", b{k} as (select cluster_id, {', '.join(cols)} from o{k})"
        prev = f"b{k}"
    return text + " select cluster_id, " + ", ".join(r(f"{m}_{c}", f"{m}_{c}") for c in "xyz" for m in ("min", "max")) + f" from {prev}"


@register("trimmed_sectors", _trim_sql(), "tp member")
def trimmed_sectors(spark: SparkSession, d: str) -> DataFrame:
    return sc.trimmed(_parts(spark, d)[2], _zones(spark).dropna())


@register("sector_membership", f"with {SAMPLES} select cluster_id, track_id, count(*) as n from ins group by all", "tp st member")
def sector_membership(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, d)[0].groupBy("cluster_id", "track_id").agg(F.count("*").alias("n"))


@register("occupancy", f"with {METRICS}{OCC} select * from occ", "tp st member flights")
def occupancy(spark: SparkSession, d: str) -> DataFrame:
    return wl.occupancy(_inside(spark, d)[0])


@register("track_metrics", f"with {METRICS} select cluster_id, track_id, " + ", ".join(r(c, c) for c in ("dwell", "curvature", "gradient", "complexity", "entry_time", "exit_time")) + " from met", "tp st member flights")
def track_metrics(spark: SparkSession, d: str) -> DataFrame:
    return wl.track_metrics(*_inside(spark, d)[:2])


@register("weighted_occupancy", f"with {METRICS}{OCC} select cluster_id, {r('weighted', 'weighted')} from wocc", "tp st member flights")
def weighted_occupancy(spark: SparkSession, d: str) -> DataFrame:
    inside, tracks, _ = _inside(spark, d)
    return wl.weighted_occupancy(inside, wl.track_metrics(inside, tracks))


@register("conflicts", f"with {SAMPLES}{CONF} select cluster_id, bin, track_a, track_b, round(horizontal_ft, 6) as horizontal_ft, round(time, 3) as time, round(vertical_ft, 6) as vertical_ft, round(convergence, 6) as convergence, severity from conf", "tp st member")
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return wl.conflicts(_inside(spark, d)[0]).withColumn("time", F.round("time", 3))


@register("workload_index", f"""
with {METRICS}{OCC}{CONF},
pk as (select cluster_id, max(aircraft) as peak from occ group by 1), nc as (select cluster_id, count(*) as conflicts from conf group by 1),
mm as (select cluster_id, avg(complexity) as complexity, avg(dwell) as dwell from met group by 1)
select cluster_id, round(coalesce(weighted, 0), 6) as weighted, coalesce(peak, 0) as peak, coalesce(conflicts, 0) as conflicts, round(coalesce(complexity, 0), 6) as complexity,
       round(coalesce(dwell, 0), 6) as dwell, round(coalesce(weighted, 0) + 5 * coalesce(conflicts, 0) + 1.5 * coalesce(peak, 0), 6) as workload
from core left join wocc using (cluster_id) left join pk using (cluster_id) left join nc using (cluster_id) left join mm using (cluster_id)""", "tp st member flights")
def workload_index(spark: SparkSession, d: str) -> DataFrame:
    inside, tracks, core = _inside(spark, d)
    inside = cut(inside)
    return wl.index(core, inside, wl.track_metrics(inside, tracks), wl.conflicts(inside))


ARR = """
arr as (
  select l.track_id, m.cluster_id, load_seq, runway, start, start + last_t as eta, start + case when n < 2 then last_t else len / (greatest(120, speed) * 1.68781) end as optimal_eta, wake
  from (select track_id, arg_max(t, seq) as last_t, coalesce(sum(sqrt(dx*dx + dy*dy + dz*dz)), 0) as len, median(v) as speed, max(n) as n from st group by track_id) l
  join (select track_id, load_seq, case when regexp_full_match(upper(trim(runwayname)), '\\d{1,2}[LRC]?') then upper(trim(runwayname)) else 'NOT_SPECIFIED' end as runway,
          cast(split_part(trackstart_time, ':', 1) as int) * 3600 + cast(split_part(trackstart_time, ':', 2) as int) * 60 + cast(split_part(trackstart_time, ':', 3) as int) as start,
          case when regexp_matches(upper(aircraft_category || ' ' || aircrafttype), 'B744|B747|B748|B763|B764|B777|B787|A330|A340|A350|A380|HEAVY') then 'heavy' else 'medium' end as wake from flights) f using (track_id)
  join member m using (track_id)),
seq as (
  select *, greatest(0, eta - optimal_eta) as delay, row_number() over w as number, lag(eta) over w as le, lag(optimal_eta) over w as lo,
         case when lag(wake) over w = 'heavy' and wake != 'heavy' then 180 else 120 end as required from arr where runway != 'NOT_SPECIFIED' window w as (partition by runway order by eta, load_seq))"""
SCHED = """,
sched as (select runway, track_id, number, eta as s from seq where number = 1
  union all select q.runway, q.track_id, q.number, greatest(q.eta, s.s + q.required) from sched s join seq q on q.runway = s.runway and q.number = s.number + 1)"""


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    tracks = flights(spark, d)
    return rw.arrivals(trackpoints(spark, d), tracks, members(tracks))


@register("arrivals", f"with {ARR} select track_id, cluster_id, load_seq, runway, cast(start as double) as start, {r('eta', 'eta')}, {r('optimal_eta', 'optimal_eta')}, {r('greatest(0, eta - optimal_eta)', 'delay')}, wake from arr", "tp st flights member")
def arrivals(spark: SparkSession, d: str) -> DataFrame:
    return _arrivals(spark, d)


@register("runway_sequence", f"""
with recursive {ARR}{SCHED} select track_id, runway, q.number, q.required, {r('eta - le', 'spacing')}, coalesce(eta - le < required, false) as violation, coalesce(optimal_eta < lo and eta > le, false) as overtaking,
       {r('s', 'scheduled')}, {r('greatest(0, s - eta)', 'sequence_delay')} from seq q join sched using (runway, track_id)""", "tp st flights member")
def runway_sequence(spark: SparkSession, d: str) -> DataFrame:
    return rw.sequence(_arrivals(spark, d)).select("track_id", "runway", "number", "required", "spacing", "violation", "overtaking", "scheduled", "sequence_delay")


@register("runway_summary", f"""
with {ARR}, h as (select runway, floor(eta / 3600) as hour, count(*) as n from arr group by all), b as (select runway, sum(n) as arrivals, max(n) as busiest from h group by runway),
s as (select runway, count(*) filter (coalesce(eta - le < required, false)) as violations, sum(delay) as total_delay, avg(delay) as mean_delay from seq group by runway),
j as (select b.*, coalesce(violations, 0) as violations, coalesce(total_delay, 0) as total_delay, coalesce(mean_delay, 0) as mean_delay, case when b.runway = 'NOT_SPECIFIED' then 0 else busiest end as landings_per_hour from b left join s using (runway))
select runway, cast(arrivals as bigint) as arrivals, violations, {r('total_delay', 'total_delay')}, {r('mean_delay', 'mean_delay')}, landings_per_hour, {r('least(1.5, landings_per_hour / 36.0)', 'utilization')},
       runway != 'NOT_SPECIFIED' and least(1.5, landings_per_hour / 36.0) >= 0.85 as overloaded from j""", "tp st flights member")
def runway_summary(spark: SparkSession, d: str) -> DataFrame:
    a = _arrivals(spark, d)
    return rw.summary(a, rw.sequence(a))


@register("parallel_runways", f"""
with {ARR}, p as (select distinct runway, runway[:-2] as no, runway[-1] as side from arr where regexp_full_match(runway, '\\d{{1,2}}[LRC]'))
select a.runway, arg_min(b.runway, case when a.side || b.side in ('LR', 'RL', 'CL') then 1 else 2 end) as parallel from p a join p b on a.no = b.no and a.side != b.side group by a.runway""", "tp st flights member")
def parallel_runways(spark: SparkSession, d: str) -> DataFrame:
    return rw.parallels(_arrivals(spark, d))


@register("runway_reassignment")
def runway_reassignment(spark: SparkSession, d: str) -> DataFrame:
    crowded = _arrivals(spark, d).withColumn("eta", F.col("eta") % 3600)
    return rw.reassignment(crowded, overload=0.5)


_JERK = " union all ".join(f"select track_id, runway, '{c}' as axis, {r(f'a{c}', 'a0')}, {r(f'10 * (q{c} - a{c}) / power(d, 3)', 'a3')}, {r(f'-15 * (q{c} - a{c}) / power(d, 4)', 'a4')}, {r(f'6 * (q{c} - a{c}) / power(d, 5)', 'a5')} from e" for c in "xyz")


@register("tbo_routes", f"with {ARR}, late as (select track_id, runway from seq where coalesce(eta - le < required, false) order by cluster_id, load_seq limit 20), e as (select e.*, runway, greatest(60, t1 - t0) as d from ends e join late using (track_id)) {_JERK}", "tp st flights member")
def tbo_routes(spark: SparkSession, d: str) -> DataFrame:
    a = _arrivals(spark, d)
    return rw.recovery_routes(trackpoints(spark, d), a, rw.sequence(a)).select("track_id", "runway", "axis", "a0", "a3", "a4", "a5")


@register("sector_hulls")
def sector_hulls(spark: SparkSession, d: str) -> DataFrame:
    return sc.hulls(_parts(spark, d)[0]).select("cluster_id", "volume", F.size("vertices").alias("vertices"), F.size("equations").alias("facets"), *(F.size(f"footprint_{p}").alias(f"corners_{p}") for p in ("xy", "xz", "yz")), "area_xy", "area_xz", "area_yz", "degenerate")
