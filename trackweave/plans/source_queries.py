"""Queries of readers and writers: tables written in a file format and read again."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.lineage import shared_folder
from trackweave.sources import radar, sinks
from trackweave.sources.adapters import flights, trackpoints

from .registry import register
from .track_queries import r


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Track files in the short layout: every third track stands twice, first with another call sign, and every tenth point line lacks
    a field."""
    t = flights(spark, d).withColumns({"eventid": F.lit("0"), "trackend_time": F.lit(None).cast("string"), "min_alt": F.col("track_id") * 10, "max_alt": F.lit("-5"), "trackstart_date": F.lit("2006-01-02").cast("date")})
    p = trackpoints(spark, d).withColumn("t", F.when(F.col("seq") % 10 != 0, F.col("t")))
    old = t.where("track_id % 3 = 0").withColumn("acid", F.lit("OLD"))
    path = _folder(spark, "lt6")
    for k, part in enumerate((old, t)):
        radar.lt6_blocks(part, p).write.text(f"{path}/{k}")
    first, last = (radar.read_files(spark, f"{path}/{k}", "part-*").withColumn("source_file", F.concat(F.lit(f"{k}/"), "source_file")) for k in (0, 1))
    return first.unionByName(last)


@register("lt6_tracks", "select track_id || '_0' as track_id, track_id as opnum, acid, case when trim(runwayname) = '' then null else trim(runwayname) end as runwayname, airportid, track_id * 10 as min_alt, cast(null as bigint) as max_alt, trackstart_time, date '2006-01-02' as trackstart_date, cast(null as varchar) as owner_name, case when track_id % 3 = 0 then 2 else 1 end as copies from flights", "flights")
def lt6_tracks(spark: SparkSession, d: str) -> DataFrame:
    return radar.tracks(_raw(spark, d)).select("track_id", "opnum", "acid", "runwayname", "airportid", "min_alt", "max_alt", "trackstart_time", "trackstart_date", "owner_name", "copies")


@register("lt6_points", f"select track_id || '_0' as track_id, row_number() over (partition by track_id order by seq) as seq, x, y, z, v, {r('t', 't')} from tp where seq % 10 != 0", "tp")
def lt6_points(spark: SparkSession, d: str) -> DataFrame:
    return radar.trackpoints(radar.tracks(_raw(spark, d)))


@register("track_csv", f"select track_id, x, y, z, v, {r('t', 't')}, track_id as track_opnum, track_id as track_idx from tp", "tp")
def track_csv(spark: SparkSession, d: str) -> DataFrame:
    """All points as CSV with their track's number and place, read again."""
    path = _folder(spark, "csv")
    tracks = flights(spark, d).withColumn("opnum", F.col("track_id"))
    sinks.write_csv(tracks, trackpoints(spark, d), path)
    read = spark.read.csv(f"{path}/all_track_points", header=True)
    return read.select(*(F.col(c).cast("long").alias(c) for c in ("track_id", "track_opnum", "track_idx")), *(F.col(c).cast("double").alias(c) for c in "xyzvt"))


@register("track_header_csv", "select track_id::varchar as track_id, acid, airportid, case when owner_name = '' then null else owner_name end as owner_name, trackstart_time from flights", "flights")
def track_header_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    sinks.write_csv(flights(spark, d).withColumn("opnum", F.col("track_id")), trackpoints(spark, d), path)
    return spark.read.csv(f"{path}/all_tracks_info", header=True).select("track_id", "acid", "airportid", "owner_name", "trackstart_time")


@register("stored_tracks", "select track_id, acid from flights order by track_id limit 20", "flights")
def stored_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The table mode with its limit: tracks stored as Parquet."""
    path = _folder(spark, "table")
    flights(spark, d).write.parquet(path)
    return radar.read_tracks(spark, "table", path, limit=20).select("track_id", "acid")


@register("zone_file", "select airportid as id, 'restricted zone' as name, min(x) as min_x, max(x) as max_x, null::double as min_y from tp join flights using (track_id) group by 1", "tp flights")
def zone_file(spark: SparkSession, d: str) -> DataFrame:
    """Zones of a JSON file, the airports' extents, without names and with missing bounds."""
    path = _folder(spark, "zones")
    extent = trackpoints(spark, d).join(flights(spark, d).select("track_id", "airportid"), "track_id").groupBy(F.col("airportid").alias("id")).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    extent.agg(F.collect_list(F.struct("id", F.struct("min_x", "max_x").alias("bounds"))).alias("restricted_zones")).write.json(path)
    return radar.zones(spark, path).select("id", "name", "min_x", "max_x", "min_y")


def _archives(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    """(path, content): two ZIP archives of all tracks, a member for each of nine days; the second one torn, if ``broken``.  An archive
    comes as a file of its name for each day, so that no task packs half of all tracks; torn ones are whole."""
    t = flights(spark, d).withColumns({"eventid": F.lit("0"), "trackend_time": F.lit(None).cast("string"), "trackstart_date": F.lit("2006-01-02").cast("date")})
    text = radar.lt6_blocks(t, trackpoints(spark, d)).withColumn("id", F.regexp_extract("value", "^TRACK ([0-9]+)", 1).cast("long"))
    day = text.groupBy((F.col("id") % 2).alias("a"), (1 + F.col("id") % 9).alias("day")).agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("text"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, number = io.BytesIO(), int(pdf["a"].iloc[0])
        with zipfile.ZipFile(out, "w") as z:
            for day, text in sorted(zip(pdf["day"], pdf["text"], strict=True)):
                z.writestr(f"2006010{day}.lt6", text, zipfile.ZIP_STORED if day % 4 == 0 else zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [f"{pdf['day'].iloc[0]}/days{number}.zip"], "content": [out.getvalue()[: -30 if broken and number else None]]})

    return day.groupBy("a", *([] if broken else ["day"])).applyInPandas(pack, "path string, content binary")


_ZIPPED = "select track_id || '_0' as track_id, acid, 'days' || track_id % 2 || '.zip/2006010' || (1 + track_id % 9) || '.lt6' as source_file from flights"


@register("archive_tracks", _ZIPPED, "flights")
def archive_tracks(spark: SparkSession, d: str) -> DataFrame:
    return radar.tracks(radar.archive_blocks(_archives(spark, d))).select("track_id", "acid", "source_file")


@register("archive_range", f"{_ZIPPED} where 1 + track_id % 9 between 3 and 6", "flights")
def archive_range(spark: SparkSession, d: str) -> DataFrame:
    """The days from the third to the sixth."""
    return radar.tracks(radar.archive_blocks(_archives(spark, d), radar.range_members(3, 6))).select("track_id", "acid", "source_file")


@register("archive_points", "select track_id || '_0' as track_id, count(*) as points, round(sum(x), 3) as x from tp where track_id % 2 = 1 and track_id % 9 = 0 group by 1", "tp")
def archive_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of one member of one archive."""
    track = radar.tracks(radar.archive_blocks(_archives(spark, d), ["days1.zip/20060101.lt6"]))
    return radar.trackpoints(track).groupBy("track_id").agg(F.count("*").alias("points"), F.round(F.sum("x"), 3).alias("x"))


@register("torn_archive", "select case when track_id % 2 = 0 then 'days0.zip/2006010' || (1 + track_id % 9) || '.lt6' else 'days1.zip' end as source_file, track_id % 2 = 1 as corrupt, case when track_id % 2 = 0 then count(*) else 1 end as blocks from flights group by 1, 2, track_id % 2", "flights")
def torn_archive(spark: SparkSession, d: str) -> DataFrame:
    """One archive of two can't be read and is one corrupt block."""
    raw = radar.archive_blocks(_archives(spark, d, broken=True))
    return raw.groupBy("source_file", F.col("corrupt").isNotNull().alias("corrupt")).agg(F.count("*").alias("blocks"))


@register("archive_contents", "select archive, count(*) as members from (select distinct 'days' || track_id % 2 || '.zip' as archive, track_id % 9 as d from flights) group by rollup(archive)", "flights")
def archive_contents(spark: SparkSession, d: str) -> DataFrame:
    return radar.archive_totals(radar.archive_members(_archives(spark, d))).select("archive", "members")
