"""Queries of the vector operators over the labelled embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import neighbours as nb
from trackweave.operators import similarity as s
from trackweave.sources.adapters import trackpoints, vectors

from .registry import register

UNIT = """
x as (select vec_id, label, i, vector[i] as x from (select *, unnest(range(1, len(vector) + 1)) as i from vec)),
len_ as (select vec_id, sqrt(sum(x * x)) as l from x group by vec_id),
u as (select x.vec_id, label, i, x, x / (l + 1e-8) as u from x join len_ using (vec_id))"""
REF = """
mean_ as (select label, i, avg(u) as m from u group by label, i),
ref as (select label, i, m / (sqrt(sum(m * m) over (partition by label)) + 1e-8) as r from mean_)"""
PAIRS = """
cos_ as (
  select a.label, a.vec_id as i, b.vec_id as j, sum(a.x * b.x) / ((any_value(la.l) + 1e-8) * (any_value(lb.l) + 1e-8)) as sim
  from x a join x b on a.label = b.label and a.i = b.i and a.vec_id < b.vec_id join len_ la on la.vec_id = a.vec_id join len_ lb on lb.vec_id = b.vec_id
  group by a.label, a.vec_id, b.vec_id)"""
MATRIX = """
cut as (select i, j, case when sim < 0.1 then 0 else sim end as sim from cos_),
both_ as (select i, j, sim from cut union all select j, i, sim from cut),
m as (select * from both_ union all select distinct i, i, 1.0 from both_)"""


@register("reference_direction", f"with {UNIT},{REF} select label, i - 1 as i, round(r, 6) as r from ref", "vec")
def reference_direction(spark: SparkSession, d: str) -> DataFrame:
    return s.reference_direction(vectors(spark, d)).select("label", F.posexplode("reference").alias("i", "r")).withColumn("i", F.col("i").cast("long"))


@register("robust_reference", f"""
with {UNIT}, med as (select label, i, median(u) as md from u group by label, i),
w as (select u.label, vec_id, abs(sum(u * md)) as w from u join med using (label, i) group by u.label, vec_id),
sums as (select u.label, i, sum(u * w) as m from u join w using (label, vec_id) group by u.label, i)
select label, i - 1 as i, round(m / (sqrt(sum(m * m) over (partition by label)) + 1e-8), 6) as r from sums""", "vec")
def robust_reference(spark: SparkSession, d: str) -> DataFrame:
    return s.robust_reference(vectors(spark, d)).select("label", F.posexplode("reference").alias("i", "r")).withColumn("i", F.col("i").cast("long"))


_SIM = "sims as (select u.label, vec_id, sum(u * r) / 1.0 as dotp, sqrt(sum(r * r)) as rl from u join ref using (label, i) group by u.label, vec_id)"


@register("cluster_quality", f"with {UNIT},{REF},{_SIM} select label, round(avg(dotp / (rl + 1e-8)), 6) as quality from sims group by label", "vec")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return s.quality(v, s.reference_direction(v))


@register("direction_inliers", f"with {UNIT},{REF},{_SIM} select vec_id, label from sims where 1 - dotp / (rl + 1e-8) < 0.8", "vec")
def direction_inliers(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return s.inliers(v, s.reference_direction(v), 0.8).select("vec_id", "label")


@register("cosine_pairs", f"with {UNIT},{PAIRS} select i, j, round(sim, 6) as sim from cos_", "vec")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return s.cosine_pairs(vectors(spark, d))


@register("guarded_cosine_distance", f"with {UNIT},{REF},lens as (select label, sqrt(sum(r * r)) as rl from ref group by label) select vec_id, round(1 - sum(x * r) / (any_value(l) * any_value(rl)), 6) as distance from u join ref using (label, i) join len_ using (vec_id) join lens using (label) group by vec_id", "vec")
def guarded_cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.join(s.reference_direction(v), "label").select("vec_id", s.cosine_distance_guarded("vector", "reference").alias("distance"))


@register("rbf_affinity", f"with {UNIT},{PAIRS} select i, j, round(exp(-power(1 - sim, 2) / 0.5), 6) as sim from cos_", "vec")
def rbf_affinity(spark: SparkSession, d: str) -> DataFrame:
    return s.rbf_affinity(vectors(spark, d), 0.5)


@register("thresholded_affinity", f"with {UNIT},{PAIRS},{MATRIX} select i, j, round(sim, 6) as sim from m", "vec")
def thresholded_affinity(spark: SparkSession, d: str) -> DataFrame:
    return s.thresholded(vectors(spark, d), 0.1)


@register("mutual_nearest", f"""
with {UNIT},{PAIRS}, two as (select i, j, round(sim, 9) as sim from cos_ union all select j, i, round(sim, 9) from cos_),
near as (select *, row_number() over (partition by i order by sim desc, j) as r from two)
select a.i, a.j, round(a.sim, 6) as sim from near a join near b on a.i = b.j and a.j = b.i where a.i < a.j and a.r <= 10 and b.r <= 10""", "vec")
def mutual_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nb.mutual(nb.nearest(vectors(spark, d), 10))


@register("neighbour_graph", f"""
with {UNIT},{PAIRS}, two as (select label, i, j, round(sim, 9) as sim from cos_ union all select label, j, i, round(sim, 9) from cos_)
select label, i, j, round(sim, 6) as sim, cast(row_number() over (partition by i order by sim desc, j) as integer) as rank from two
qualify row_number() over (partition by i order by sim desc, j) <= 15""", "vec")
def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """The 15 nearest of every vector in its label."""
    return nb.nearest(vectors(spark, d), 15)


@register("laplacian", f"with {UNIT},{PAIRS},{MATRIX}, deg as (select i, sum(sim) as d from m group by i) select m.i, m.j, round(case when m.i = m.j then 1 else 0 end - sim / sqrt(a.d * b.d), 6) as value from m join deg a on a.i = m.i join deg b on b.i = m.j", "vec")
def laplacian(spark: SparkSession, d: str) -> DataFrame:
    return s.laplacian(vectors(spark, d), 0.1)


@register("laplacian_plain", f"with {UNIT},{PAIRS},{MATRIX}, deg as (select i, sum(sim) as d from m group by i) select m.i, m.j, round(case when m.i = m.j then d else 0 end - sim, 6) as value from m join deg on deg.i = m.i", "vec")
def laplacian_plain(spark: SparkSession, d: str) -> DataFrame:
    return s.laplacian(vectors(spark, d), 0.1, normalised=False)


@register("intra_inter_quality", f"""
with {UNIT},{PAIRS},{MATRIX}, l as (select vec_id as node, vec_id % 3 as label from vec),
g as (select a.label, avg(sim) filter (a.label = b.label) as p, coalesce(avg(sim) filter (a.label != b.label), 0) as q from m join l a on a.node = m.i join l b on b.node = m.j group by a.label)
select label, round(p / (p + q + 1e-8), 6) as quality from g""", "vec")
def intra_inter_quality(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    labels = v.select(F.col("vec_id").alias("node"), (F.col("vec_id") % 3).alias("label"))
    return s.intra_inter(v, labels, 0.1)


@register("bandwidth_estimate", f"""
with {UNIT}, dist as (
  select a.label, a.vec_id as i, b.vec_id as j, sqrt(sum((a.x - b.x) * (a.x - b.x))) as d from x a join x b on a.label = b.label and a.i = b.i and a.vec_id != b.vec_id group by all),
size as (select label, greatest(1, floor(count(*) * 0.2)) as k from vec group by label),
r as (select *, row_number() over (partition by label, i order by d, j) as r from dist join size using (label))
select label, round(greatest(0.05, avg(d)), 6) as bandwidth from r where r = greatest(1, k - 1) group by label""", "vec")
def bandwidth_estimate(spark: SparkSession, d: str) -> DataFrame:
    return s.bandwidth(vectors(spark, d))


_F = ["ux", "uy", "uz", "mx", "my", "mz", "turn_mean"]


@register("standard_features", """
with d as (select *, sqrt(power(qx - ax, 2) + power(qy - ay, 2) + power(qz - az, 2)) as l from ends),
u as (select track_id, (qx - ax) / l as ux, (qy - ay) / l as uy, (qz - az) / l as uz from d),
m as (select track_id, avg(x) as mx, avg(y) as my, avg(z) as mz from tp group by track_id),
t as (select track_id, avg(acos(greatest(-1, least(1, (dx*ex + dy*ey + dz*ez) / (sqrt(dx*dx + dy*dy + dz*dz) * sqrt(ex*ex + ey*ey + ez*ez) + 1e-8))))) as turn_mean from st where px is not null and fx is not null group by track_id)
select track_id, """ + ", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 5) as {c}" for c in _F) + " from u join m using (track_id) join t using (track_id)")
def standard_features(spark: SparkSession, d: str) -> DataFrame:
    out = s.standardised(s.track_features(trackpoints(spark, d)).select("track_id", *_F), _F)
    return out.select("track_id", *(F.round(c, 5).alias(c) for c in _F))


@register("direction_hypothesis")
def direction_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    """The reference direction of two vectors drawn from each label's."""
    return s.hypothesis(vectors(spark, d), 2).select("label", F.size("sample").alias("drawn"), F.posexplode("reference").alias("i", "r"))
