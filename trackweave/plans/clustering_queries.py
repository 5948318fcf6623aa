"""Queries of the clustering algorithms; groups are airports, the comparisons take one sample of all tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.operators import clustering as cl
from trackweave.operators import near_tracks as nt
from trackweave.operators import sector as sc
from trackweave.operators.selection import even_tracks
from trackweave.sources.adapters import flights, members, trackpoints

from .registry import register
from .track_queries import r

#: Tracks of a comparison, the reference's default limit.
COMPARED = 300


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """All points with their airport as the group."""
    return trackpoints(spark, d).join(flights(spark, d).select("track_id", F.col("airportid").alias("grp")), "track_id")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """All algorithms on one group: at most ``COMPARED`` evenly spaced tracks of all, whose points are
    stored, so that not every algorithm reads and sorts all events anew."""
    own = even_tracks(flights(spark, d), COMPARED).select("track_id", F.lit("all").alias("grp"))
    return cl.compare(cut(trackpoints(spark, d).join(own, "track_id")))


def _one(name: str):
    return lambda spark, d: cl.cluster(_grouped(spark, d), name)


for _query, _name in (("ransac_clusters", "RANSAC"), ("mlesac_clusters", "MLESAC"), ("spectral_clusters", "SCC"), ("laplacian_clusters", "LSCC"), ("mean_shift_clusters", "MeanShift")):
    register(_query)(_one(_name))


@register("feature_kmeans")
def feature_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cl.features_kmeans(trackpoints(spark, d))


@register("algorithm_comparison")
def algorithm_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


CENTRES = "cen2 as (select cluster_id, avg(x) as x, avg(y) as y, avg(z) as z from (select cluster_id, track_id, avg(x) as x, avg(y) as y, avg(z) as z from tp join member using (track_id) group by all) group by cluster_id)"


@register("cluster_centres", f"with {CENTRES} select cluster_id, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from cen2", "tp member")
def cluster_centres(spark: SparkSession, d: str) -> DataFrame:
    p = trackpoints(spark, d)
    return cl.centres(sc.cluster_points(p, members(flights(spark, d))))


@register("merged_clusters", f"""
with recursive {CENTRES}, sz as (select cluster_id, count(*) as size from member group by 1),
own as (select *, row_number() over (order by size desc, cluster_id) as i from sz join cen2 using (cluster_id)),
fold as (
  select cast(4 as bigint) as i, (select list({{'kept': cluster_id, 'n': size, 'x': x, 'y': y, 'z': z}} order by i) from own where i <= 4) as st, -1 as cluster_id, -1 as merged_id, cast(0 as bigint) as size
  union all
  select r.i, list_transform(st, lambda s: case when s.kept = k then {{'kept': s.kept, 'n': s.n + r.size, 'x': (s.x * s.n + r.x * r.size) / (s.n + r.size), 'y': (s.y * s.n + r.y * r.size) / (s.n + r.size), 'z': (s.z * s.n + r.z * r.size) / (s.n + r.size)}} else s end), r.cluster_id, k, r.size
  from (select f.st, r.*, list_sort(list_transform(st, lambda s: {{'d': power(s.x - r.x, 2) + power(s.y - r.y, 2) + power(s.z - r.z, 2), 'k': s.kept}}))[1].k as k from fold f join own r on r.i = f.i + 1) r)
select cluster_id, merged_id, size from fold where cluster_id >= 0 union all select cluster_id, cluster_id, size from own where i <= 4""", "tp member")
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = members(flights(spark, d))
    return cl.merge_small(m, cl.centres(sc.cluster_points(trackpoints(spark, d), m)), 4)


@register("track_similarities")
def track_similarities(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different tracks of an airport, equal tracks under their smallest id, with a row for each of its copies."""
    return cl.similarity_classes(_grouped(spark, d))


@register("adaptive_mean_shift")
def adaptive_mean_shift(spark: SparkSession, d: str) -> DataFrame:
    return cl.adaptive_mean_shift(_grouped(spark, d))


@register("best_algorithm")
def best_algorithm(spark: SparkSession, d: str) -> DataFrame:
    return cl.best_algorithm(_compared(spark, d))


@register("representative_lines", """
with l0 as (select cluster_id, track_id, count(*) as n from tp join member using (track_id) group by all),
l as (select *, row_number() over (partition by cluster_id order by track_id) as k from l0),
s as (select cluster_id, track_id, n, unnest(range(0, 60)) as step from l where k <= 30),
p as (select *, step * (n - 1) / 59.0 as p, least(floor(step * (n - 1) / 59.0), n - 1) as l from s)
select cluster_id, step, """ + ", ".join(r(f"avg(a.{c} + (p - l) * (b.{c} - a.{c}))", c) for c in "xyz") + """
from p join tp a on a.track_id = p.track_id and a.seq = l + 1 join tp b on b.track_id = p.track_id and b.seq = least(l + 2, n) group by cluster_id, step""", "tp member")
def representative_lines(spark: SparkSession, d: str) -> DataFrame:
    return cl.representative_lines(sc.cluster_points(trackpoints(spark, d), members(flights(spark, d))))


@register("cluster_zones", f"""
with {CENTRES}, box as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from cen2),
g as (select gx, gy, x0 + (x1 - x0) * (gx + 0.5) / 20 as px, y0 + (y1 - y0) * (gy + 0.5) / 20 as py from box, (select unnest(range(0, 20)) as gx), (select unnest(range(0, 20)) as gy))
select gx, gy, arg_min(cluster_id, power(x - px, 2) + power(y - py, 2)) as cluster_id from g, cen2 group by gx, gy""", "tp member")
def cluster_zones(spark: SparkSession, d: str) -> DataFrame:
    return cl.zones_of(cl.centres(sc.cluster_points(trackpoints(spark, d), members(flights(spark, d)))))


@register("near_tracks", """
with cp as (select m.cluster_id, tp.* from tp join member m using (track_id)), lens as (select cluster_id, track_id, count(*) as n from cp group by all),
pr as (select a.cluster_id, a.track_id as i, b.track_id as j, a.n as ni, b.n as nj, least(a.n, b.n) as m from lens a join lens b on a.cluster_id = b.cluster_id and a.track_id < b.track_id),
sp as (select *, unnest(range(0, m)) as v from pr),
ix as (select *, case when m = 1 then 0 when v = m - 1 then ni - 1 else floor(v * ((ni - 1)::double / (m - 1))) end as li, case when m = 1 then 0 when v = m - 1 then nj - 1 else floor(v * ((nj - 1)::double / (m - 1))) end as lj from sp),
far as (
  select ix.cluster_id, i, j, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) as distance
  from ix join tp a on a.track_id = i and a.seq = li + 1 join tp b on b.track_id = j and b.seq = lj + 1 group by all)
select cluster_id, i, j, round(distance, 6) as distance from far where distance <= 40000""", "tp member")
def near_tracks(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of tracks of a cluster within 40,000 ft on average."""
    own = trackpoints(spark, d).join(members(flights(spark, d)), "track_id")
    return nt.near_tracks(own, 40_000.0).drop("spatial")
