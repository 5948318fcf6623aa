"""Queries of filters, samples and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import geometry as g
from trackweave.operators import selection as s
from trackweave.sources.adapters import flights, members, trackpoints

from .registry import register

CLEAN = "case when lower(trim({0})) in ('', 'nan', 'none', 'null') then '' else trim({0}) end".format


@register("track_filter", f"select track_id from flights where {CLEAN('airportid')} in ('SJC', 'SFO') and ({CLEAN('aircraft_category')} in ('A', 'A320') or {CLEAN('aircrafttype')} in ('A', 'A320'))", "flights")
def track_filter(spark: SparkSession, d: str) -> DataFrame:
    return s.filter_tracks(flights(spark, d), kinds=("A", "A320"), airportid=("SJC", "SFO")).select("track_id")


_BLOB = " || ' ' || ".join(CLEAN(c) for c in ("cast(track_id as varchar)", "acid", "airportid", "runwayname", "aircraft_category", "aircrafttype", "owner_name", "other_port"))


@register("track_search", f"select track_id from flights where contains(lower({_BLOB}), 'beta')", "flights")
def track_search(spark: SparkSession, d: str) -> DataFrame:
    return s.filter_tracks(flights(spark, d), text=" Beta ").select("track_id")


@register("facet_values", "select distinct facet, value from (" + " union all ".join(f"select '{f}' as facet, {CLEAN(c)} as value from flights" for f, c in (("airportid", "airportid"), ("runwayname", "runwayname"), ("owner_name", "owner_name"), ("other_port", "other_port"), ("type", "aircraft_category"), ("type", "aircrafttype"))) + ") where value != ''", "flights")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return s.facet_values(flights(spark, d))


@register("clean_header", f"select track_id, {CLEAN('runwayname')} as runway, {CLEAN('other_port')} as port from flights", "flights")
def clean_header(spark: SparkSession, d: str) -> DataFrame:
    return flights(spark, d).select("track_id", s.clean("runwayname").alias("runway"), s.clean("other_port").alias("port"))


@register("track_listing", "select track_id, acid from flights order by load_seq limit 1000", "flights")
def track_listing(spark: SparkSession, d: str) -> DataFrame:
    return s.listing(flights(spark, d)).select("track_id", "acid")


@register("min_points_filter", "select track_id, count(*) as n from tp group by track_id having count(*) >= 60", "tp")
def min_points_filter(spark: SparkSession, d: str) -> DataFrame:
    return s.at_least(trackpoints(spark, d), 60).groupBy("track_id").agg(F.count("*").alias("n"))


@register("nonzero_vectors", "select track_id from ends where sqrt(power(qx - ax, 2) + power(qy - ay, 2) + power(qz - az, 2)) >= 1e-8")
def nonzero_vectors(spark: SparkSession, d: str) -> DataFrame:
    return g.direction(trackpoints(spark, d)).where("ux * ux + uy * uy + uz * uz > 0").select("track_id")


_EVEN = "select unnest(range(0, {k})) as i"


@register("even_point_sample", """
with c as (select track_id, count(*) as n from tp group by track_id),
want as (select distinct track_id, cast(floor(i * ((n - 1) / 29.0)) as bigint) + 1 as seq from c, (select unnest(range(0, 30)) as i) where n > 30)
select tp.track_id, tp.seq from tp join c using (track_id) left join want w on w.track_id = tp.track_id and w.seq = tp.seq where n <= 30 or w.seq is not null""", "tp")
def even_point_sample(spark: SparkSession, d: str) -> DataFrame:
    return s.even_sample(trackpoints(spark, d), 30).select("track_id", "seq")


@register("even_track_sample", """
with r as (select track_id, row_number() over (order by load_seq) - 1 as i, count(*) over () as n from flights)
select track_id from r where n <= 40 or i in (select cast(floor(k * ((n - 1) / 39.0)) as bigint) from (select unnest(range(0, 40)) as k), (select count(*) as n from flights))""", "flights")
def even_track_sample(spark: SparkSession, d: str) -> DataFrame:
    return s.even_tracks(flights(spark, d), 40).select("track_id")


@register("stride_sample", """
with r as (select track_id, row_number() over (order by load_seq) - 1 as i, count(*) over () as n from flights)
select track_id from r where i % greatest(1, n // 40) = 0 and i // greatest(1, n // 40) < 40""", "flights")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return s.stride_tracks(flights(spark, d), 40).select("track_id")


@register("density_sample", """
with r as (select track_id, load_seq, row_number() over (order by load_seq) - 1 as i, count(*) over () as n from flights),
p as (select tp.track_id, seq, load_seq, count(*) over (partition by tp.track_id) as m from tp join r using (track_id) where i % greatest(1, n // 40) = 0)
select track_id, seq from p where (seq - 1) % greatest(1, m // 8) = 0 order by load_seq, seq limit 450""", "tp flights")
def density_sample(spark: SparkSession, d: str) -> DataFrame:
    return s.density_sample(trackpoints(spark, d), flights(spark, d)).select("track_id", "seq")


_MODAL = f"""
modal as (
  select cluster_id, runway, row_number() over (partition by cluster_id order by count(*) desc, min(load_seq)) as rn
  from (select cluster_id, load_seq, {CLEAN('runwayname')} as runway from member join flights using (track_id)) where runway != '' group by cluster_id, runway)"""


@register("modal_runway", f"with {_MODAL} select c.cluster_id, runway from (select distinct cluster_id from member) c left join modal m on m.cluster_id = c.cluster_id and rn = 1", "flights member")
def modal_runway(spark: SparkSession, d: str) -> DataFrame:
    f = flights(spark, d)
    return s.modal_runway(members(f), f)


@register("visible_clusters", f"with {_MODAL} select cluster_id, count(*) as size, any_value(runway) as runway from member join (select cluster_id, runway from modal where rn = 1) using (cluster_id) group by cluster_id having count(*) > 1", "flights member")
def visible_clusters(spark: SparkSession, d: str) -> DataFrame:
    f = flights(spark, d)
    return s.visible_clusters(members(f), f)


_FIELDS = ("acid", "runwayname", "aircraft_category", "owner_name", "other_port")


@register("null_profile", " union all ".join(f"select '{c}' as field, cast(count(*) filter ({CLEAN(c)} = '') as bigint) as nulls, round(count(*) filter ({CLEAN(c)} = '') * 100.0 / count(*), 6) as percent from flights" for c in _FIELDS), "flights")
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return s.null_profile(flights(spark, d), _FIELDS)


@register("cluster_statistics", "select count(size) as count, cast(sum(size) as double) as sum, round(avg(size), 6) as mean, round(stddev_pop(size), 6) as std, cast(min(size) as double) as min, cast(max(size) as double) as max from (select count(*) as size from member group by cluster_id)", "member")
def cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    return s.statistics(members(flights(spark, d)).groupBy("cluster_id").agg(F.count("*").alias("size")), "size")


@register("duration_text", "select track_id, case when d < 60 then printf('%.1f s', d) when d < 3600 then printf('%.1f min', d / 60) else printf('%.1f h', d / 3600) end as text from (select track_id, max(t) - min(t) as d from tp group by track_id)", "tp")
def duration_text(spark: SparkSession, d: str) -> DataFrame:
    return g.duration(trackpoints(spark, d)).select("track_id", s.duration_text(F.col("duration")).alias("text"))
