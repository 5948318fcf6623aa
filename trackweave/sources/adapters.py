"""Event and vector tables as the track model: ``trackpoints``, ``flights``, ``members`` and ``vectors``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trackpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, seq, x, y, z, v, t, t_abs: a user's events as a track.  One shuffle, by track."""
    order = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.expr("ts - timestamp_ntz'1970-01-01 00:00:00'")
    seconds = F.expr("extract(day from d) * 86400D + extract(hour from d) * 3600D + extract(minute from d) * 60D + cast(extract(second from d) as double)")
    events = parquet(spark, sf_dir, "events").withColumnRenamed("user_id", "track_id")
    base = events.select(
        "track_id",
        F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("c"),
        since.alias("d"),
    )
    base = base.withColumn("t_abs", seconds)
    return base.select(
        "track_id",
        "seq",
        F.sum("c").over(order).cast("double").alias("x"),
        F.sum((F.col("k") - 50) * 100).over(order).cast("double").alias("y"),
        (F.greatest(F.lit(0), 12000 - 150 * F.col("seq")) + F.col("k")).cast("double").alias("z"),
        (100 + F.col("k")).cast("double").alias("v"),
        (F.col("t_abs") - F.first("t_abs").over(order)).alias("t"),
        "t_abs",
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track with header fields derived from its number."""
    ids = parquet(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct()
    pick = lambda values, column: F.element_at(F.array(*(F.lit(v) for v in values)), (column + 1).cast("int"))
    t = F.col("track_id")
    return ids.select(
        t,
        t.alias("load_seq"),
        F.concat(F.lit("FL"), t.cast("string")).alias("acid"),
        pick(["30L", "30R", "12L", " nan", "09", "XX"], t % 6).alias("runwayname"),
        pick(["A", "B", "C", "D", "HEAVY", "none"], t % 6).alias("aircraft_category"),
        pick(["B747", "A320", "C172", "B777", "HELO"], t % 5).alias("aircrafttype"),
        pick(["SJC", "SFO", "OAK"], t % 3).alias("airportid"),
        pick(["Alpha Air", "Beta", ""], t % 3).alias("owner_name"),
        pick(["LAX", "null", "SEA", "DEN"], t % 4).alias("other_port"),
        F.format_string("%02d:%02d:%02d", (t * 7) % 24, (t * 13) % 60, (t * 29) % 60).alias("trackstart_time"),
    )


def members(tracks: DataFrame, clusters: int = 10) -> DataFrame:
    """cluster_id, track_id: a fixed assignment for operators that need clusters."""
    return tracks.select((F.col("track_id") % clusters).cast("int").alias("cluster_id"), "track_id").distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding as array<double>."""
    return parquet(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


#: The same views as DuckDB common table expressions.
SQL_TP = """
tp0 as (
  select user_id as track_id, row_number() over (partition by user_id order by ts, event_id) as seq,
         cast(json_extract_string(props, '$.k') as bigint) as k, cast(round(value * 100) as bigint) as c, epoch_us(ts) / 1e6 as t_abs
  from events),
tp as (
  select track_id, seq, cast(sum(c) over w as double) as x, cast(sum((k - 50) * 100) over w as double) as y,
         cast(greatest(0, 12000 - 150 * seq) + k as double) as z, cast(100 + k as double) as v,
         t_abs - first_value(t_abs) over w as t, t_abs
  from tp0 window w as (partition by track_id order by seq rows between unbounded preceding and current row))
"""
SQL_FLIGHTS = """
flights as (
  select track_id, track_id as load_seq, 'FL' || track_id as acid,
         ['30L', '30R', '12L', ' nan', '09', 'XX'][track_id % 6 + 1] as runwayname,
         ['A', 'B', 'C', 'D', 'HEAVY', 'none'][track_id % 6 + 1] as aircraft_category,
         ['B747', 'A320', 'C172', 'B777', 'HELO'][track_id % 5 + 1] as aircrafttype,
         ['SJC', 'SFO', 'OAK'][track_id % 3 + 1] as airportid, ['Alpha Air', 'Beta', ''][track_id % 3 + 1] as owner_name,
         ['LAX', 'null', 'SEA', 'DEN'][track_id % 4 + 1] as other_port,
         printf('%02d:%02d:%02d', (track_id * 7) % 24, (track_id * 13) % 60, (track_id * 29) % 60) as trackstart_time
  from (select distinct user_id as track_id from events))
"""
SQL_MEMBER = "member as (select distinct cast(user_id % 10 as integer) as cluster_id, user_id as track_id from events)"
SQL_VEC = "vec as (select vec_id, label, cast(embedding as double[]) as vector from embeddings)"
