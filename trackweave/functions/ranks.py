"""Places of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``__place``, from 0 in each group by ``order`` (nulls first).

    The rows are dealt by even ranges of (group, order), sorted and stored with running numbers; a row's place is its number in its
    range plus the group's rows in the ranges before, so a hot group spreads over all tasks.
    """
    by = [group, *order]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(F.col(group).alias("__g"), part.alias("__p")).agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__g", "__p", (before - F.col("first")).alias("__shift"))
    joined = ranged.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (part == F.col("__p")))
    return joined.withColumn("__place", F.col("__at") + F.col("__shift")).drop("__g", "__p", "__shift", "__at")
