"""Exact quantiles and ranks of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranks import placed

#: Rows of a group that one task may hold, and ranges into which a pass cuts each group's open stretch.
HELD, BINS = 1_000_000, 256
_LARGEST = 1.7976931348623157e308


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]], held: int = HELD) -> DataFrame:
    """``keys`` and for each name the exact, linearly interpolated quantile of a column, as ``percentile`` gives it.

    Groups of at most ``held`` rows are one aggregation.  If there are larger ones, all groups are narrowed together: a pass counts
    the values by ``BINS`` ranges of every group's open stretch, with partial counts in all tasks, and keeps the range in which the
    wanted place falls, until that range holds one value; a task never has a group's values.  Nulls and NaN aren't counted, a group
    without values gets null, infinite values count as the largest doubles when narrowing.
    """
    keys = list(keys)
    if largest_group(df, keys) <= held:
        return df.groupBy(*keys).agg(*(F.percentile(F.when(~F.isnan(c), c), q).alias(name) for name, (c, q) in wanted.items()))
    names = list(wanted)
    ids = [f"__k{i}" for i in range(len(keys))]
    values = df.select(*(F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)), *(c.alias(f"__v{i}") for i, (c, _) in enumerate(wanted.values())))
    items = F.array(*(F.struct(F.lit(i).alias("item"), F.col(f"__v{i}").cast("double").alias("v")) for i in range(len(names))))
    values = values.select(*ids, F.inline(items)).where("v is not null and not isnan(v)").withColumn("v", F.least(F.greatest("v", F.lit(-_LARGEST)), F.lit(_LARGEST)))
    share = F.element_at(F.array(*(F.lit(float(q)) for _, q in wanted.values())), F.col("item") + 1)
    first = values.groupBy(*ids, "item").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("at", share * (F.col("n") - 1))
    ends = F.array(*(F.struct(F.lit(s).alias("side"), f("at").cast("long").alias("rank")) for s, f in ((0, F.floor), (1, F.ceil))))
    targets = cut(first.select(*ids, "item", "at", "low", "high", F.inline(ends)))
    while not targets.where("low < high").isEmpty():
        open_ = targets.where("low < high").select(*(F.col(i).alias(f"{i}t") for i in ids), F.col("item").alias("it"), "side", "rank", "at", "low", "high")
        same = F.col("item") == F.col("it")
        for i in ids:
            same &= F.col(i).eqNullSafe(F.col(f"{i}t"))
        inside = values.join(open_, same & F.col("v").between(F.col("low"), F.col("high")))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS))
        group = [*ids, "item", "side"]
        counted = inside.groupBy(*group, "rank", "at", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bin")))
        found = upto.where("upto > rank and upto - n <= rank").select(*ids, "item", "at", "low", "high", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        targets = cut(targets.where("low = high").unionByName(found))
    part = F.col("at") - F.floor("at")
    pick = lambda i, s: F.max(F.when((F.col("item") == i) & (F.col("side") == s), F.col("low")))
    lean = lambda i: F.max(F.when(F.col("item") == i, part))
    found = targets.groupBy(*ids).agg(*(((1 - lean(i)) * pick(i, 0) + lean(i) * pick(i, 1)).alias(name) for i, name in enumerate(names)))
    every = df.select(*(F.col(k).alias(i) for k, i in zip(keys, ids, strict=True))).distinct()
    both = every.join(found.select(*(F.col(i).alias(f"{i}t") for i in ids), *names), [F.col(i).eqNullSafe(F.col(f"{i}t")) for i in ids], "left")
    return both.select(*(F.col(i).alias(k) for k, i in zip(keys, ids, strict=True)), *names)


def ranks(df: DataFrame, key: str, order: Sequence[tuple[str, bool]], name: str = "rank", held: int = HELD) -> DataFrame:
    """``df`` with the row's rank from 1 in its group, by columns and whether they fall.  Groups larger than ``held`` get their ranks
    from even ranges of all rows instead of one window."""
    if largest_group(df, [key]) <= held:
        by = [F.desc(c) if falls else F.asc(c) for c, falls in order]
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    turned = {f"__o{i}": -F.col(c) if falls else F.col(c) for i, (c, falls) in enumerate(order)}
    out = placed(df.withColumns(turned), key, *turned)
    return out.withColumn(name, (F.col("__place") + 1).cast("int")).drop("__place", *turned)
