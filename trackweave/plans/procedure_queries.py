"""Queries of rules, centroids, anomalies, procedure checks and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.operators import procedure as pr
from trackweave.operators import rules as ru
from trackweave.operators import sector as sc
from trackweave.operators import workload as wl
from trackweave.sources.adapters import flights, members, trackpoints

from .cluster_queries import BOUND, CONF, FIXES, METRICS, OCC, _inside, _parts
from .registry import register
from .track_queries import COURSE, INNER, RADIUS, r

CAT = """
cat as (
  select f.track_id, case when u like '%A' then 'A' when u like '%B' then 'B' when u like '%C' then 'C' when u like '%D' then 'D' when u like '%E' then 'E'
         when p20 between 0 and 90 then 'A' when p20 between 91 and 120 then 'B' when p20 between 121 and 140 then 'C' when p20 between 141 and 165 then 'D' when p20 between 166 and 210 then 'E' else 'C' end as category
  from (select track_id, upper(trim(aircraft_category)) as u from flights) f join (select track_id, quantile_cont(v, 0.2) as p20 from tp group by track_id) using (track_id))"""
DESC = CAT + """,
d0 as (
  select track_id, coalesce(max(case when sqrt(dx*dx + dy*dy) > 1e-8 then -dz / sqrt(dx*dx + dy*dy) end), 0) as g, max(qz + 0.052 * sqrt(power(x - qx, 2) + power(y - qy, 2)) - z) as below
  from st join ends using (track_id) group by track_id),
de as (select d0.*, case when category in ('A', 'B') then 0.037 * 1.05 else 0.035 * 1.05 end as allowed from d0 join cat using (track_id))"""
SPEED = CAT + """,
sp0 as (
  select track_id, max(v) filter (seq - 1 >= trunc(n * 0.8::double)) as final, max(v) filter (seq - 1 >= trunc(n * 0.3::double) and seq - 1 < greatest(trunc(n * 0.7::double), 1)) as middle from st group by track_id),
sp as (select track_id, final, coalesce(middle, final) as middle, case category when 'A' then 90 when 'B' then 120 when 'C' then 140 when 'D' then 165 else 210 end as up from sp0 join cat using (track_id))"""
BANK = f"""
bk0 as (select track_id, seq, z, v, {RADIUS} as radius from st where {INNER}),
bk1 as (select *, degrees(atan(power(v * 1.68781, 2) / (32.174 * radius))) as bank, case when z > 397 then 25 else 8 end as lim from bk0 where radius > 0),
bk2 as (select *, min(seq) filter (bank > lim) over (partition by track_id) as first from bk1),
bk as (
  select track_id, max(bank) as max_bank, max(first) as at_seq, max(bank) filter (seq = first) as bank, bool_or(bank > lim * 1.25) filter (seq = first) as strong
  from bk2 where first is null or seq <= first group by track_id)"""
ACC = " + ".join(f"power((e{c} / greatest(et, 1) - d{c} / greatest(dt, 1)) / greatest(et, 1), 2)" for c in "xyz")
#: Distance to the best plane: the smallest eigenvalue by Newton's method on the characteristic polynomial from below, the
#: normal as the longest column of the adjugate.
PLANE = """
pm as (select track_id, avg(x) as mx, avg(y) as my, avg(z) as mz, count(*) as n from tp group by 1),
pc as (select track_id, n, x - mx as x, y - my as y, z - mz as z from tp join pm using (track_id)),
p0 as (select track_id, max(n) as n, sum(x*x) as a, sum(y*y) as b, sum(z*z) as c, sum(x*y) as u, sum(x*z) as v, sum(y*z) as w, sum(x*x + y*y + z*z) as t from pc group by 1),
p1 as (select track_id, n, a / t as a, b / t as b, c / t as c, u / t as u, v / t as v, w / t as w from p0 where t > 0),
p2 as (select *, a*b + a*c + b*c - u*u - v*v - w*w as s, a*b*c + 2*u*v*w - a*w*w - b*v*v - c*u*u as d from p1),
p3 as (select *, list_reduce([0.0] || list_transform(range(1, 60), lambda i: 0.0), lambda l, k: l - (((l - 1) * l + s) * l - d) / greatest((3 * l - 2) * l + s, 1e-300)) as l from p2),
p4 as (select *, (b-l)*(c-l) - w*w as c0, (a-l)*(c-l) - v*v as c1, (a-l)*(b-l) - u*u as c2, v*w - u*(c-l) as d01, u*w - v*(b-l) as d02, u*v - w*(a-l) as d12 from p3),
p5 as (
  select track_id, n, case when abs(c0) >= abs(c1) and abs(c0) >= abs(c2) then [c0, d01, d02] when abs(c1) >= abs(c2) then [d01, c1, d12] else [d02, d12, c2] end as m from p4),
plane as (
  select t.track_id, case when max(p5.n) >= 4 then quantile_cont(abs(x*m[1] + y*m[2] + z*m[3]) / sqrt(m[1]*m[1] + m[2]*m[2] + m[3]*m[3]), 0.95) else 0 end as residual
  from pc t join p5 using (track_id) group by 1)"""
RISK = f"{DESC},{SPEED[len(CAT) + 2:]},{BANK}" + f""",
acc as (select track_id, coalesce(max(case when {INNER} then sqrt({ACC}) end), 0) as a from st group by track_id),
{PLANE},
risk as (
  select track_id, 'profile' as "check", 'PROFILE' as type, 'HIGH' as severity from de where g > allowed
  union all select track_id, 'profile', 'PROFILE', 'HIGH' from de where below > 150
  union all select track_id, 'speed', 'UNSTABLE_APPROACH', 'MEDIUM' from sp where final > up + 20
  union all select track_id, 'speed', 'INTERMEDIATE_SPEED', 'MEDIUM' from sp where middle > up + 30
  union all select track_id, 'bank', 'DANGEROUS_MANEUVER', case when strong then 'HIGH' else 'MEDIUM' end from bk where at_seq is not null
  union all select track_id, 'radar', 'TECH_FAILURE', 'HIGH' from acc where a > 96.5
  union all select track_id, 'radar', 'TECH_FAILURE', 'MEDIUM' from plane where residual > 1500)"""


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return trackpoints(spark, d), flights(spark, d)


@register("aircraft_category", f"with {CAT} select * from cat", "tp flights")
def aircraft_category(spark: SparkSession, d: str) -> DataFrame:
    return ru.category(*_tracks(spark, d))


@register("descent_rule", f"with {DESC} select track_id, {r('g', 'max_gradient')}, {r('allowed', 'allowed')}, {r('below', 'below')}, g > allowed as steep, below > 150 as low from de", "tp st flights")
def descent_rule(spark: SparkSession, d: str) -> DataFrame:
    p, t = _tracks(spark, d)
    return ru.descent(p, ru.category(p, t))


@register("speed_rule", f"with {SPEED} select track_id, final, middle, final > up + 20 as unstable, middle > up + 30 as fast from sp", "tp st flights")
def speed_rule(spark: SparkSession, d: str) -> DataFrame:
    p, t = _tracks(spark, d)
    return ru.speeds(p, ru.category(p, t))


@register("bank_rule", f"with {BANK} select t.track_id, {r('coalesce(max_bank, 0)', 'max_bank')}, at_seq as at, {r('bank', 'bank')}, case when at_seq is null then null when strong then 'HIGH' else 'MEDIUM' end as severity from (select distinct track_id from tp) t left join bk using (track_id)")
def bank_rule(spark: SparkSession, d: str) -> DataFrame:
    return ru.banks(trackpoints(spark, d))


@register("radar_rule", f"with acc as (select track_id, coalesce(max(case when {INNER} then sqrt({ACC}) end), 0) as a from st group by track_id),{PLANE} select track_id, {r('a', 'max_acceleration')}, round(residual, 2) as residual, a > 96.5 as jump, residual > 1500 as scatter from acc join plane using (track_id)", "tp st")
def radar_rule(spark: SparkSession, d: str) -> DataFrame:
    return ru.radar(trackpoints(spark, d)).withColumn("residual", F.round("residual", 2))


@register("rule_risks", f'with {RISK} select track_id, "check", type, severity from risk', "tp st flights")
def rule_risks(spark: SparkSession, d: str) -> DataFrame:
    return ru.risks(*_tracks(spark, d)).drop("detail")


@register("risk_rollup", f"with {RISK} select f.track_id, count(type) as risk_count, case when bool_or(severity = 'HIGH') then 'HIGH' when bool_or(severity = 'MEDIUM') then 'MEDIUM' else 'NONE' end as max_severity from flights f left join risk using (track_id) group by f.track_id", "tp st flights")
def risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    p, t = _tracks(spark, d)
    return ru.rollup(ru.risks(p, t), t)


@register("risk_totals", f"with {RISK} select cluster_id, type, count(*) as n, count(distinct track_id) as tracks from risk join member using (track_id) group by rollup (cluster_id, type)", "tp st flights member")
def risk_totals(spark: SparkSession, d: str) -> DataFrame:
    p, t = _tracks(spark, d)
    return ru.totals(ru.risks(p, t), members(t))


@register("svd_residual", f"with {PLANE} select track_id, round(residual, 2) as residual from plane", "tp")
def svd_residual(spark: SparkSession, d: str) -> DataFrame:
    return ru.plane_residuals(trackpoints(spark, d)).withColumn("residual", F.round("residual", 2))


def _lerp(source: str, at: str, cols: str = "xyz", prefix: str = "") -> str:
    return ", ".join(f"{source}a.{c} + ({at} - l) * ({source}b.{c} - {source}a.{c}) as {prefix}{c}" for c in cols)


CENTROID = f"""
cp as (select m.cluster_id, tp.* from tp join member m using (track_id)),
lens as (select cluster_id, track_id, count(*) as n from cp group by all),
even as (select distinct cluster_id, track_id, cast(floor(i * ((n - 1) / 99::double)) as bigint) + 1 as seq from lens, (select unnest(range(0, 100)) as i) where n > 100),
thin as (
  select cp.cluster_id, cp.track_id, row_number() over (partition by cp.cluster_id, cp.track_id order by cp.seq) as seq, x, y, z
  from cp join lens using (cluster_id, track_id) left join even e on e.cluster_id = cp.cluster_id and e.track_id = cp.track_id and e.seq = cp.seq where n <= 100 or e.seq is not null),
tlen as (select cluster_id, track_id, count(*) as n from thin group by all),
target as (select cluster_id, cast(trunc(median(n)) as bigint) as m from tlen group by 1),
spots as (select cluster_id, track_id, n, m, unnest(range(0, m)) as step from tlen join target using (cluster_id)),
lows as (select *, step * (n - 1) / (m - 1)::double as p, least(floor(step * (n - 1) / (m - 1)::double), n - 1) as l from spots),
al as (
  select s.cluster_id, s.track_id, step, {_lerp('', 'p')} from lows s join thin a on a.cluster_id = s.cluster_id and a.track_id = s.track_id and a.seq = l + 1
  join thin b on b.cluster_id = s.cluster_id and b.track_id = s.track_id and b.seq = least(l + 2, n)),
cen as (select cluster_id, step, median(x) as x, median(y) as y, median(z) as z from al group by all)"""
DEV = CENTROID + f""",
cn as (select cluster_id, count(*) as k from cen group by 1),
sp2 as (select l.cluster_id, track_id, n, k, least(n, k) as m, unnest(range(0, least(n, k))) as step from lens l join cn using (cluster_id)),
tl as (select s.*, step * (n - 1) / (m - 1)::double as p, least(floor(step * (n - 1) / (m - 1)::double), n - 1) as l from sp2 s),
tk as (select s.cluster_id, s.track_id, step, {_lerp('', 'p')} from tl s join tp a on a.track_id = s.track_id and a.seq = l + 1 join tp b on b.track_id = s.track_id and b.seq = least(l + 2, n)),
kl as (select s.*, step * (k - 1) / (m - 1)::double as p, least(floor(step * (k - 1) / (m - 1)::double), k - 1) as l from sp2 s),
ck as (select s.cluster_id, s.track_id, s.step, {_lerp('', 'p', 'xyz', 'c')} from kl s join cen a on a.cluster_id = s.cluster_id and a.step = l join cen b on b.cluster_id = s.cluster_id and b.step = least(l + 1, k - 1)),
mt as (select * from tk join ck using (cluster_id, track_id, step)),
mv as (
  select *, x - lag(x) over w as dx, y - lag(y) over w as dy, z - lag(z) over w as dz, cx - lag(cx) over w as dcx, cy - lag(cy) over w as dcy, cz - lag(cz) over w as dcz
  from mt window w as (partition by cluster_id, track_id order by step)),
dist as (select cluster_id, track_id, step, 1 - (dx*dcx + dy*dcy + dz*dcz) / ((sqrt(dx*dx + dy*dy + dz*dz) + 1e-8) * (sqrt(dcx*dcx + dcy*dcy + dcz*dcz) + 1e-8)) as d from mv where dx is not null),
dev as (select cluster_id, track_id, sum(d order by step) / count(d) as cosine_distance, sum(d * d order by step) as squared_sum from dist group by all)"""
ANOM = DEV + """,
thr as (select cluster_id, quantile_cont(cosine_distance, 0.95) as th from dev group by 1),
an as (
  select d.*, row_number() over w as rank, cosine_distance > th as is_anomaly, squared_sum / (first_value(squared_sum) over w + 1e-8) as score
  from dev d join thr using (cluster_id) window w as (partition by cluster_id order by cosine_distance desc, track_id))"""


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    points, tracks = _tracks(spark, d)
    return sc.cluster_points(points, members(tracks))


def _centroid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = cut(_clustered(spark, d))
    return points, pr.median_centroid(pr.aligned(points))


_XYZ = ", ".join(r(c, c) for c in "xyz")


@register("aligned_tracks", f"with {CENTROID} select cluster_id, track_id, cast(step as integer) as step, {_XYZ} from al", "tp member")
def aligned_tracks(spark: SparkSession, d: str) -> DataFrame:
    return pr.aligned(_clustered(spark, d))


@register("centroid_median", f"with {CENTROID} select cluster_id, cast(step as integer) as step, {_XYZ} from cen", "tp member")
def centroid_median(spark: SparkSession, d: str) -> DataFrame:
    return _centroid(spark, d)[1]


@register("centroid_smooth", f"""
with {CENTROID}, sz as (select cluster_id, count(*) as n from cen group by 1),
hw as (select cluster_id, n, cast(floor((greatest(3, floor(n / 20)) + case when greatest(3, floor(n / 20)) % 2 = 0 then 1 else 0 end) / 2) as bigint) as h from sz),
ar as (select c.cluster_id, c.step, greatest(0, least(n - 1, c.step + o)) as j from cen c join hw using (cluster_id), lateral (select unnest(range(-h, h + 1)) as o))
select ar.cluster_id, cast(ar.step as integer) as step, {', '.join(r(f'median(c.{c})', c) for c in 'xyz')} from ar join cen c on c.cluster_id = ar.cluster_id and c.step = j group by ar.cluster_id, ar.step""", "tp member")
def centroid_smooth(spark: SparkSession, d: str) -> DataFrame:
    return pr.smoothed(_centroid(spark, d)[1])


@register("centroid_profile")
def centroid_profile(spark: SparkSession, d: str) -> DataFrame:
    return pr.modelled(pr.aligned(_clustered(spark, d)))


@register("track_deviation", f"with {DEV} select cluster_id, track_id, {r('cosine_distance', 'cosine_distance')}, {r('squared_sum', 'squared_sum')} from dev", "tp member")
def track_deviation(spark: SparkSession, d: str) -> DataFrame:
    return pr.deviations(*_centroid(spark, d))


@register("anomaly_rank", f"with {ANOM} select cluster_id, track_id, cast(rank as integer) as rank, {r('cosine_distance', 'cosine_distance')}, {r('squared_sum', 'squared_sum')}, is_anomaly, {r('score', 'score')}, case when rank = 1 or score > 0.7 then 'high' when score > 0.4 then 'medium' else 'low' end as level from an", "tp member")
def anomaly_rank(spark: SparkSession, d: str) -> DataFrame:
    return pr.anomalies(pr.deviations(*_centroid(spark, d)))


@register("anomaly_statistics", f"with {ANOM} select cluster_id, count(*) as tracks, count(*) filter (is_anomaly) as anomalies, {r('avg(case when is_anomaly then 100 else 0 end)', 'percent')}, {r('max(cosine_distance)', 'max_distance')}, {r('avg(cosine_distance)', 'mean_distance')}, {r('stddev_pop(cosine_distance)', 'std_distance')} from an group by cluster_id", "tp member")
def anomaly_statistics(spark: SparkSession, d: str) -> DataFrame:
    return pr.anomaly_statistics(pr.anomalies(pr.deviations(*_centroid(spark, d))))


@register("overall_risk", f"with {ANOM}, x as (select cluster_id, least(1, avg(score) * 0.6 + avg(case when is_anomaly then 1.0 else 0 end) * 0.4) as risk from an group by 1) select cluster_id, {r('risk', 'risk')}, case when risk < 0.3 then 'LOW' when risk < 0.6 then 'MEDIUM' else 'HIGH' end as level from x", "tp member")
def overall_risk(spark: SparkSession, d: str) -> DataFrame:
    return pr.overall_risk(pr.anomalies(pr.deviations(*_centroid(spark, d))))


@register("top_anomalies", f"with {ANOM} select track_id, cluster_id, {r('score', 'score')} from an order by round(score, 6) desc, track_id limit 10", "tp member")
def top_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return pr.anomalies(pr.deviations(*_centroid(spark, d))).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "track_id").limit(10).select("track_id", "cluster_id", "score")


@register("anomaly_risks", f"with {ANOM},{RISK}, n as (select track_id, count(*) as n from risk group by 1) select a.track_id, cast(rank as integer) as rank, coalesce(n, 0) as rule_risks from an a left join n using (track_id)", "tp st flights member")
def anomaly_risks(spark: SparkSession, d: str) -> DataFrame:
    p, t = _tracks(spark, d)
    counts = ru.risks(p, t).groupBy("track_id").agg(F.count("*").alias("rule_risks"))
    return pr.anomalies(pr.deviations(*_centroid(spark, d))).join(counts, "track_id", "left").select("track_id", "rank", F.coalesce("rule_risks", F.lit(0)).alias("rule_risks"))


CTURN = CENTROID + f""",
cs0 as (
  select cluster_id, step, x, y, z, px, py, fx, fy, x - px as dx, y - py as dy, fx - x as ex, fy - y as ey from (
    select *, lag(x) over w as px, lag(y) over w as py, lead(x) over w as fx, lead(y) over w as fy from cen window w as (partition by cluster_id order by step)) where px is not null and fx is not null),
cs1 as (select *, {RADIUS} as radius, {COURSE} as course from cs0),
rf as (
  select *, degrees(atan(power(greatest(80, sqrt(power(fx - px, 2) + power(fy - py, 2)) / 2), 2) / (32.174 * radius))) as bank, case when z > 400 then 25 else 8 end as lim
  from cs1 where radius > 0 and (radius <= 1822.836 or course >= 3))"""


@register("rf_segments", f"with {CTURN} select cluster_id, cast(step as integer) as step, round(radius, 4) as radius, round(course, 4) as course_change, round(bank, 4) as bank from rf", "tp member")
def rf_segments(spark: SparkSession, d: str) -> DataFrame:
    return pr.rf_segments(_centroid(spark, d)[1]).select("cluster_id", "step", *(F.round(c, 4).alias(c) for c in ("radius", "course_change", "bank")))


@register("pbn_issues", f"""
with {CTURN}, ln as (
  select c.cluster_id, c.step, c.x, c.y, radius * tan(radians(course) / 2) as dta, max(c.step) over (partition by c.cluster_id) as last_, lead(c.x) over w as nx, lead(c.y) over w as ny,
         lead(radius * tan(radians(course) / 2)) over w as ndta
  from cen c left join rf on rf.cluster_id = c.cluster_id and rf.step = c.step window w as (partition by c.cluster_id order by c.step)),
lg as (select cluster_id, sqrt(power(nx - x, 2) + power(ny - y, 2)) - coalesce(dta, 0) - coalesce(ndta, 0) as margin from ln where step >= 1 and step < last_ - 1 and (dta is not null or ndta is not null)),
la as (select cluster_id, min(margin) as mm, count(*) filter (margin < 0) as li from lg group by 1),
ba as (select cluster_id, count(*) as rn, count(*) filter (bank > lim) as bi, max(bank) as mb from rf group by 1)
select c.cluster_id, coalesce(rn, 0) as rf_segments, coalesce(bi, 0) as bank_issues, coalesce(li, 0) as length_issues, round(coalesce(mb, 0), 4) as max_bank, round(coalesce(mm, 0), 3) as min_margin, true as precise, coalesce(bi, 0) = 0 as valid
from (select distinct cluster_id from cen) c left join la using (cluster_id) left join ba using (cluster_id)""", "tp member")
def pbn_issues(spark: SparkSession, d: str) -> DataFrame:
    return pr.pbn_checks(_centroid(spark, d)[1]).withColumns({"max_bank": F.round("max_bank", 4), "min_margin": F.round("min_margin", 3)})


QUAL = DEV + """,
qd as (
  select cluster_id, track_id, avg(1 - greatest(-1, least(1, (dx*dcx + dy*dcy + dz*dcz) / (sqrt(dx*dx + dy*dy + dz*dz) * sqrt(dcx*dcx + dcy*dcy + dcz*dcz) + 1e-8)))) as d,
         quantile_cont(sqrt(power(x - cx, 2) + power(y - cy, 2)), 0.95) as lat, quantile_cont(abs(z - cz), 0.95) as ver from mv group by all),
qe as (select qd.*, (az - qz) / (sqrt(power(qx - ax, 2) + power(qy - ay, 2)) + 1e-8) as gr from qd join ends using (track_id)),
qa as (select cluster_id, 1 - avg(d) as repeatability, least(count(*) filter (lat <= 1215.224), count(*) filter (ver <= 300)) * 100.0 / count(*) as stable_percent, avg(gr) as gradient from qe group by 1)"""


@register("procedure_quality", f"""
with {QUAL},{CTURN[len(CENTROID) + 2:]}, rr as (select cluster_id, radius from cs1 where radius > 0), md as (select cluster_id, median(radius) as m, count(*) as n from rr group by 1),
cons as (select cluster_id, case when max(n) < 2 then 1 else avg(case when abs(radius - m) <= 607.612 then 1.0 else 0 end) end as consistency from rr join md using (cluster_id) group by 1)
select cluster_id, {r('repeatability', 'repeatability')}, {r('stable_percent', 'stable_percent')}, {r('gradient', 'gradient')}, {r('coalesce(consistency, 1)', 'consistency')},
       {r('greatest(0, least(100, repeatability * 45 + stable_percent * 0.35 + coalesce(consistency, 1) * 20 - case when gradient > 0.037 then 20 else 0 end))', 'score')} from qa left join cons using (cluster_id)""", "tp st member")
def procedure_quality(spark: SparkSession, d: str) -> DataFrame:
    return pr.quality(*_centroid(spark, d))


def _waypoints(spark: SparkSession, d: str) -> DataFrame:
    points, centroid = _centroid(spark, d)
    core = _parts(spark, d)[3]
    return pr.waypoints(centroid, sc.fixes(sc.boundary_points(points, core)), points)


WAYPOINTS = FIXES + ",lens as" + CENTROID.split("lens as", 1)[1] + f""",
cnt as (select cluster_id, count(*) as k from cen group by 1),
stops as (
  select c.cluster_id, 1 as part, c.step as k, printf('C%d-%02d', c.cluster_id, c.step) as name, 'TF' as kind, x, y, z from cen c join cnt n using (cluster_id)
  where c.step in (select cast(floor(i * (n.k - 1) / 4.0) as bigint) from (select unnest(range(0, 5)) as i))
  union all
  select cluster_id, case when kind = 'ENTRY' then 0 else 2 end, 0, kind || '-' || cluster_id || '-' || row_number() over (partition by cluster_id, kind order by track_count desc, g), kind, cx, cy, cz from ctr),
wp as (select *, row_number() over (partition by cluster_id order by part, k, name) as seq from stops),
legs as (
  select cluster_id, seq, x - px as dx, y - py as dy, fx - x as ex, fy - y as ey from (
    select *, lag(x) over w as px, lag(y) over w as py, lead(x) over w as fx, lead(y) over w as fy from wp window w as (partition by cluster_id order by seq)) where px is not null and fx is not null),
bends as (select cluster_id, seq, {RADIUS} as radius, {COURSE} as course from legs),
near as (select w.cluster_id, w.seq, p.track_id, arg_min(p.z, power(p.x - w.x, 2) + power(p.y - w.y, 2)) as pz, arg_min(p.v, power(p.x - w.x, 2) + power(p.y - w.y, 2)) as pv from wp w join cp p on p.cluster_id = w.cluster_id group by all),
lim as (select cluster_id, seq, avg(pz) as mean, stddev_pop(pz) as sd, quantile_cont(pv, 0.85) as speed from near group by all),
way as (
  select cluster_id, seq, name as waypoint_id, case when coalesce(course, 0) > 3 and coalesce(radius, 0) > 0 then 'RF' else kind end as path_type, round(37.6188056 + y / 364000, 6) as lat,
         round(-122.3754167 + x / (364000 * cos(radians(37.6188056)) + 1e-8), 6) as lon, {r('z', 'z')}, {r('greatest(0, mean - 3 * sd)', 'alt_low_ft')}, {r('mean + 3 * sd', 'alt_high_ft')}, {r('speed', 'speed_kt')}, round(coalesce(radius, 0), 3) as radius_ft
  from wp join lim using (cluster_id, seq) left join bends using (cluster_id, seq))"""


@register("centroid_waypoints", f"with recursive {WAYPOINTS} select * from way", "tp member")
def centroid_waypoints(spark: SparkSession, d: str) -> DataFrame:
    """Entry fixes, five points of the centroid and exit fixes of every cluster, with limits and turns."""
    return _waypoints(spark, d).withColumn("radius_ft", F.round("radius_ft", 3))


@register("arinc", f"with recursive {WAYPOINTS} select 'PROC-' || cluster_id as procedure_id, * exclude (cluster_id) from way", "tp member")
def arinc(spark: SparkSession, d: str) -> DataFrame:
    return _waypoints(spark, d).withColumns({"procedure_id": F.concat(F.lit("PROC-"), "cluster_id"), "radius_ft": F.round("radius_ft", 3)}).drop("cluster_id")


@register("geojson")
def geojson(spark: SparkSession, d: str) -> DataFrame:
    return pr.geojson(_waypoints(spark, d))


def _workload(spark: SparkSession, d: str) -> DataFrame:
    inside, tracks, core = _inside(spark, d)
    inside = cut(inside)
    return wl.index(core, inside, wl.track_metrics(inside, tracks), wl.conflicts(inside))


IDX = METRICS + OCC + CONF + """,
idx as (
  select core.cluster_id, coalesce(weighted, 0) + 5 * coalesce(conflicts, 0) + 1.5 * coalesce(peak, 0) as workload, coalesce(conflicts, 0) as conflicts, coalesce(complexity, 0) as complexity
  from core left join wocc using (cluster_id) left join (select cluster_id, max(aircraft) as peak from occ group by 1) using (cluster_id)
  left join (select cluster_id, count(*) as conflicts from conf group by 1) using (cluster_id) left join (select cluster_id, avg(complexity) as complexity from met group by 1) using (cluster_id))"""


@register("what_if", f"""
with {IDX}, a as (select max(workload) as a, sum(conflicts) as b, avg(complexity) as c, max(workload * 0.9) as d, sum(trunc(conflicts * 0.85)) as f, avg(complexity * 1.05) as g from idx)
select 'max_workload' as measure, {r('a', 'baseline')}, {r('d', 'simulated')}, {r('d - a', 'delta')} from a union all select 'conflicts', {r('b', 'baseline')}, {r('f', 'simulated')}, {r('f - b', 'delta')} from a
union all select 'mean_complexity', {r('c', 'baseline')}, {r('g', 'simulated')}, {r('g - c', 'delta')} from a""", "tp st flights member")
def what_if(spark: SparkSession, d: str) -> DataFrame:
    return pr.what_if(_workload(spark, d))


@register("workload_classes", f"with {IDX} select cluster_id, case when workload >= 80 then 'HIGH' when workload >= 40 then 'MEDIUM' else 'LOW' end as class from idx", "tp st flights member")
def workload_classes(spark: SparkSession, d: str) -> DataFrame:
    return _workload(spark, d).select("cluster_id", F.expr("case when workload >= 80 then 'HIGH' when workload >= 40 then 'MEDIUM' else 'LOW' end").alias("class"))


@register("top_clusters", f"""
with {IDX},{RISK},{ANOM.replace(CENTROID, 'lens as' + CENTROID.split('lens as', 1)[1], 1)},
rk as (select cluster_id, count(*) as n from risk join member using (track_id) group by 1), ac as (select cluster_id, count(*) filter (is_anomaly) as n from an group by 1)
select cluster_id, round(workload + 5 * coalesce(rk.n, 0) + 100 * coalesce(ac.n, 0), 6) as priority from idx left join rk using (cluster_id) left join ac using (cluster_id) order by priority desc, cluster_id limit 5""", "tp st flights member")
def top_clusters(spark: SparkSession, d: str) -> DataFrame:
    p, t = _tracks(spark, d)
    p, m = cut(p), members(t)
    rk = ru.risks(p, t).join(m, "track_id").groupBy("cluster_id").agg(F.count("*").alias("risks"))
    ac = pr.anomaly_statistics(pr.anomalies(pr.deviations(*_centroid(spark, d)))).select("cluster_id", "anomalies")
    out = _workload(spark, d).join(rk, "cluster_id", "left").join(ac, "cluster_id", "left").fillna(0, ["risks", "anomalies"])
    return out.select("cluster_id", F.expr("workload + 5 * risks + 100 * anomalies").alias("priority")).orderBy(F.desc("priority"), "cluster_id").limit(5)


@register("global_statistics", f"""
with {IDX} select count(*) as clusters, (select count(*) from member) as tracks, cast(sum(conflicts) as bigint) as conflicts, {r('max(workload)', 'max_workload')} from idx""", "tp st flights member")
def global_statistics(spark: SparkSession, d: str) -> DataFrame:
    tracks = members(flights(spark, d)).agg(F.count("*").alias("tracks"))
    return _workload(spark, d).agg(F.count("*").alias("clusters"), F.sum("conflicts").alias("conflicts"), F.max("workload").alias("max_workload")).crossJoin(tracks)


@register("track_deviation_euclid", f"""
with {DEV} select cluster_id, track_id, round(avg(sqrt(power(dx - dcx, 2) + power(dy - dcy, 2) + power(dz - dcz, 2))), 4) as cosine_distance,
       round(sum(power(dx - dcx, 2) + power(dy - dcy, 2) + power(dz - dcz, 2)) / 1e6, 4) as squared_sum from mv where dx is not null group by cluster_id, track_id""", "tp member")
def track_deviation_euclid(spark: SparkSession, d: str) -> DataFrame:
    out = pr.deviations(*_centroid(spark, d), cosine=False)
    return out.select("cluster_id", "track_id", F.round("cosine_distance", 4).alias("cosine_distance"), F.round(F.col("squared_sum") / 1e6, 4).alias("squared_sum"))


@register("anomaly_assessment", f"""
with {ANOM}, lv as (select cluster_id, track_id, case when rank = 1 or score > 0.7 then 1 when score > 0.4 then 2 else 3 end as k from an)
select cluster_id, track_id, ['CRITICAL', 'SIGNIFICANT', 'MINOR'][k] as finding, ['ANALYSE_NOW', 'WATCH_CLOSELY', 'MONITOR'][k] as advice from lv""", "tp member")
def anomaly_assessment(spark: SparkSession, d: str) -> DataFrame:
    return pr.assessment(pr.anomalies(pr.deviations(*_centroid(spark, d))))
