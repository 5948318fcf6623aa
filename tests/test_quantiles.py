"""Quantiles and ranks of large groups against numpy and windows."""

import numpy as np
from pyspark.sql import functions as F

from trackweave.functions.quantiles import quantiles, ranks
from trackweave.functions.ranks import placed


def rows():
    rng = np.random.default_rng(2)
    hot = [("hot", float(v), float(w)) for v, w in zip(np.exp(rng.normal(0, 6, 3000)), rng.integers(0, 4, 3000), strict=True)]
    cold = [(g, float(v), None) for g in ("a", "b", None) for v in rng.normal(0, 1, 7)]
    odd = [("one", -0.0, 5.0), ("same", 2.5, 1.0), ("same", 2.5, 1.0), ("none", None, None), ("huge", 1e308, 1.0), ("huge", -1e308, 2.0), ("huge", 3.0, float("nan")), ("inf", float("inf"), 1.0)]
    return hot + cold + odd


def test_narrowing_equals_percentiles(spark):
    df = spark.createDataFrame(rows(), "g string, v double, w double").repartition(9)
    wanted = {"low": (F.col("v"), 0.02), "mid": (F.col("v"), 0.5), "high": (F.col("v") * 1, 0.98), "w": (F.col("w"), 0.95)}
    whole, narrowed = ({r.g: tuple(r)[1:] for r in quantiles(df, ["g"], wanted, held).collect()} for held in (10**6, 10))
    assert whole.keys() == narrowed.keys() and whole["none"] == (None, None, None, None)
    for g in whole.keys() - {"inf"}:
        for a, b in zip(whole[g], narrowed[g], strict=True):
            assert a == b or abs(a - b) <= 1e-12 * abs(a), (g, a, b)
    v = np.array([r[1] for r in rows() if r[0] == "hot"])
    assert np.allclose(narrowed["hot"][:3], np.percentile(v, [2, 50, 98]), rtol=1e-12)
    assert quantiles(df.where("false"), ["g"], wanted, 0).count() == 0


def test_two_keys_and_no_task_with_a_whole_group(spark):
    df = spark.range(20_000).selectExpr("cast(if(id % 10 = 0, id % 3, 7) as int) as a", "if(id % 2 = 0, 'x', null) as b", "cast(xxhash64(id) % 1000 as double) as v")
    whole, narrowed = (sorted(map(str, quantiles(df, ["a", "b"], {"m": (F.col("v"), 0.5)}, held).collect())) for held in (10**6, 100))
    assert whole == narrowed


def test_ranks_from_ranges_equal_a_window(spark):
    df = spark.createDataFrame([(g, i, float(i * 7 % 5)) for g in ("a", "b") for i in range(300 if g == "a" else 4)] + [(None, 1, 2.0)], "g string, i long, v double").repartition(6)
    whole, ranged = (sorted(map(str, ranks(df, "g", [("v", True), ("i", False)], held=held).collect())) for held in (10**6, 10))
    assert whole == ranged
    assert sorted((r.g or "", r.i, r["__place"]) for r in placed(df, "g", "i").collect() if r.g == "b") == [("b", i, i) for i in range(4)]
