"""Mean shift on groups too large for one task: rounds of jobs over pairs of blocks of feature vectors, all groups and widths together.

Equal vectors are one with their number, and modes that meet are one; a mode that stays where it is isn't moved again.  A task holds two
blocks of up to ``HELD`` vectors and compares small pieces of them; what comes to the driver are a round's largest steps, one for each
group and width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.functions.ranks import placed

from . import cluster_kernels as k
from .lines import packed

#: Feature vectors from which a group is dealt into more blocks, up to ``FEW``, and those of a block at most; each vector goes to all
#: blocks of its group in every round, so blocks are large.
BLOCK, FEW, HELD = 1000, 4, 40_000
#: Modes and vectors that are compared at once, and meetings of blocks in partitions of their own at most.
AT_ONCE, ACROSS, MEETINGS = 256, 4096, 4096
#: Decimals to which modes are rounded, so that those of the same vectors are equal, and the step below which a mode stays.
PLACES, STILL = 12, 1e-11
e = F.expr


def _pairs(x: DataFrame) -> int:
    return x.groupBy("g").agg(F.max("parts").alias("p")).agg(F.sum(F.col("p") * F.col("p")).alias("n")).first().n or 1


def _meet(left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, pairs: int | None = None) -> DataFrame:
    """``run`` on every block of ``left`` with every block of ``right`` of the same group g: two pandas frames in, rows out.  ``pairs`` is
    the number of these, if known."""
    pairs = pairs or _pairs(right)
    # A pair of blocks is small to store and long to compare, so the number of parts goes by pairs, not by bytes; several parts a pair, so
    # that few share one.
    parts = int(min(MEETINGS, max(left.sparkSession.sparkContext.defaultParallelism, 2 * pairs)))
    every: Column = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = left.withColumn("other", every).repartition(parts, "g", "block", "other")
    b = right.withColumnRenamed("block", "other").withColumn("block", every).repartition(parts, "g", "block", "other")
    names = [c.split()[0] for c in schema.split(", ")]

    def both(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = run(p, q)[names] if len(p) and len(q) else ()
        # A frame without rows has numbers where Arrow expects lists, so it isn't passed on.
        return found if len(found) else pd.DataFrame(columns=names)

    return a.groupBy("g", "block", "other").cogroup(b.groupBy("g", "block", "other")).applyInPandas(both, schema)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices, added up dimension by dimension."""
    out = np.zeros((len(p), len(q)))
    for i in range(p.shape[1]):
        step = p[:, [i]] - q[:, i]
        step *= step
        out += step
    return np.sqrt(out, out=out)


def _near(a: np.ndarray, b: np.ndarray, width: float, strict: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, matrix of those within ``width``) in pieces of both: vectors too far along one axis are left out, products of
    matrices decide the rest, and distances that are close to ``width`` are worked out in full."""
    axis = int(b.var(axis=0).argmax())
    rows, order = np.argsort(a[:, axis], kind="stable"), np.argsort(b[:, axis], kind="stable")
    along, reach = b[order, axis], width * (1 + 1e-9) + 1e-9
    for first in range(0, len(rows), AT_ONCE):
        own = rows[first : first + AT_ONCE]
        other = order[np.searchsorted(along, a[own[0], axis] - reach) : np.searchsorted(along, a[own[-1], axis] + reach, side="right")]
        p = a[own]
        other = other[((b[other] >= p.min(axis=0) - reach) & (b[other] <= p.max(axis=0) + reach)).all(axis=1)]
        pp = (p * p).sum(axis=1)
        for start in range(0, len(other), ACROSS):
            part = other[start : start + ACROSS]
            q = b[part]
            qq = (q * q).sum(axis=1)
            d = pp[:, None] + qq - 2 * (p @ q.T)
            hit = d <= width * width
            i, j = np.nonzero(np.abs(d - width * width) <= 1e-12 * (pp.max() + qq.max() + width * width))
            exact = np.sqrt(((p[i] - q[j]) ** 2).sum(axis=1))
            hit[i, j] = exact < width if strict else exact <= width
            yield own, part, hit


def vectors(points: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(g, track_id, block, f, c, parts): the different standardised features of each group g with their number of tracks and their
    first track; and (g, track_id, first) of every track."""
    kind = dict(points.dtypes)["track_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"g": pdf["g"], "track_id": pdf["track_id"], "f": [k.features(np.column_stack(t)) for t in zip(pdf["xs"], pdf["ys"], pdf["zs"], strict=True)]})

    raw = cut(packed(points, "g").select("g", "track_id", "xs", "ys", "zs").mapInPandas(run, f"g int, track_id {kind}, f array<double>"))
    stats = raw.select("g", F.posexplode("f").alias("i", "v")).groupBy("g", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = stats.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("st"))
    z = cut(raw.join(F.broadcast(stats), "g").select("g", "track_id", e("transform(f, (v, i) -> (v - st[i].m) / if(st[i].s > 0, st[i].s, 1D))").alias("f")))
    one = cut(z.groupBy("g", "f").agg(F.min("track_id").alias("first"), F.count("*").alias("c")))
    n = F.count("*")
    parts = one.groupBy("g").agg(F.greatest(F.ceil(n / HELD), F.least(F.ceil(n / block), F.lit(FEW).cast("long"))).cast("int").alias("parts"))
    x = one.join(F.broadcast(parts), "g").withColumnRenamed("first", "track_id").withColumn("block", _block("track_id"))
    return cut(x.select("g", "track_id", "block", "f", "c", "parts")), cut(z.join(one.drop("c"), ["g", "f"]).select("g", "track_id", "first"))


def _block(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col("parts")).cast("int")


def widths_of(x: DataFrame, quantile: float, cuts: int = 32, passes: int = 6) -> DataFrame:
    """(g, width): mean distance to the (quantile * n)-th nearest of a group's n vectors, the vector itself counted first, at least 0.05;
    0.1 for a lone one.  Each vector's distance is closed in by counts at ``cuts`` steps a pass, to the ``cuts ** passes``-th part of the
    widest distance."""
    kind = dict(x.dtypes)["track_id"]
    steps = range(cuts)
    total = x.groupBy("g").agg(F.sum("c").alias("n"), (2 * F.max(e("sqrt(aggregate(f, 0D, (a, v) -> a + v * v))")) + 1e-9).alias("high"))
    total = cut(total.withColumn("rank", F.greatest(F.lit(1), F.floor(F.col("n") * quantile)).cast("long")))
    state = cut(x.join(F.broadcast(total), "g").select("g", "track_id", "block", "parts", "f", "c", "rank", F.lit(-1e-9).alias("low"), "high"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p, q, weight = np.stack(a["f"]), np.stack(b["f"]), b["c"].to_numpy(dtype=float)
        low, high, found = a["low"].to_numpy(), a["high"].to_numpy(), []
        for first in range(0, len(p), AT_ONCE):
            part = slice(first, first + AT_ONCE)
            lo, one = low[part, None], (high - low)[part, None] / cuts
            rows = np.arange(len(lo))[:, None] * (cuts + 1)
            counts = np.zeros(len(lo) * (cuts + 1))
            for start in range(0, len(q), ACROSS):
                across = slice(start, start + ACROSS)
                place = np.clip(np.ceil((_far(p[part], q[across]) - lo) / one), 0, cuts).astype(np.int64)
                counts += np.bincount((place + rows).ravel(), np.broadcast_to(weight[across], place.shape).ravel(), len(counts))
            found.append(counts.reshape(len(lo), -1))
        below = np.cumsum(np.concatenate(found), axis=1).astype(np.int64)
        # below[:, j] counts what is at most low + j steps away.
        return pd.DataFrame({"g": a["g"], "track_id": a["track_id"], **{f"c{j}": below[:, j] for j in steps}})

    for _ in range(passes):
        counted = _meet(state.select("g", "track_id", "block", "parts", "f", "low", "high"), x.select("g", "block", "parts", "f", "c"), count, f"g int, track_id {kind}, " + ", ".join(f"c{j} long" for j in steps))
        counted = counted.groupBy("g", "track_id").agg(F.array(*(F.sum(f"c{j}") for j in steps[1:])).alias("n"))
        one = f"(high - low) / {cuts}"
        step = "size(filter(n, v -> v < rank))"
        state = cut(state.join(counted, ["g", "track_id"]).select("g", "track_id", "block", "parts", "f", "c", "rank", e(f"low + {one} * {step}").alias("low"), e(f"low + {one} * ({step} + 1)").alias("high")))
    mean = F.sum(F.greatest(F.lit(0.0), "high") * F.col("c")) / F.sum("c")
    return state.groupBy("g").agg(F.when(F.sum("c") < 2, F.lit(0.1)).otherwise(F.greatest(F.lit(0.05), mean)).alias("width"))


def _shift(modes: DataFrame, x: DataFrame, wide: int, pairs: int) -> DataFrame:
    """Modes with the number and the mean of the vectors within their width, and the largest step by an axis."""
    kind = dict(x.dtypes)["track_id"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m, q, weight = np.stack(a["m"]), np.stack(b["f"]), b["c"].to_numpy(dtype=float)
        summed, out = np.column_stack((q * weight[:, None], weight)), np.zeros((len(a), wide + 1))
        for width in a["width"].unique():
            own = np.flatnonzero(a["width"] == width)
            for i, j, hit in _near(m[own], q, width):
                if hit.any():
                    out[own[i]] += hit.astype(float) @ summed[j]
        met = out[:, -1] > 0
        return pd.DataFrame({"run": a["run"][met], "track_id": a["track_id"][met], "n": out[met, -1].astype(np.int64), "total": list(out[met, :-1])})

    sums = _meet(modes, x.select("g", "block", "parts", "f", "c"), run, f"run int, track_id {kind}, n long, total array<double>", pairs)
    sums = sums.groupBy("run", "track_id").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(wide))).alias("s"))
    out = modes.join(sums, ["run", "track_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    out = out.withColumn("new", e(f"if(n > 0, transform(s, v -> round(v / n, {PLACES})), m)")).drop("s")
    return out.withColumn("step", e("array_max(zip_with(new, m, (p, q) -> abs(p - q)))"))


def _centres(modes: DataFrame) -> DataFrame:
    """Modes with cluster_id: of each run those that a walk from the fullest to the emptiest (ties by track) takes if none taken
    before is closer than the width.  A mode is taken as soon as no fuller one beside it is open, so all are settled in a few rounds."""
    kind = dict(modes.dtypes)["track_id"]
    settled, open_ = [], modes

    def flags(fuller: bool) -> Callable:
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            m, o, hits = np.stack(a["m"]), np.stack(b["m"]), np.zeros(len(a), bool)
            n, more, ids, others = a["n"].to_numpy(), b["n"].to_numpy(), a["track_id"].to_numpy(), b["track_id"].to_numpy()
            for r in np.intersect1d(a["run"], b["run"]):
                own, other = np.flatnonzero(a["run"] == r), np.flatnonzero(b["run"] == r)
                for i, j, hit in _near(m[own], o[other], a["width"].iloc[own[0]], strict=True):
                    p, q = np.nonzero(hit)
                    p, q = own[i[p]], other[j[q]]
                    hits[p[(more[q] > n[p]) | ((more[q] == n[p]) & (others[q] < ids[p]))] if fuller else p] = True
            return a[hits][["run", "track_id"]]

        return run

    def hit(left: DataFrame, right: DataFrame, fuller: bool) -> DataFrame:
        return _meet(left, right, flags(fuller), f"run int, track_id {kind}").distinct()

    while not open_.isEmpty():
        taken = cut(open_.join(hit(open_, open_, True), ["run", "track_id"], "left_anti"))
        settled.append(taken)
        open_ = cut(open_.join(hit(open_, taken, False), ["run", "track_id"], "left_anti"))
        open_ = cut(open_.join(taken.select("run", "track_id"), ["run", "track_id"], "left_anti"))
    taken = reduce(DataFrame.unionByName, settled).withColumn("less", -F.col("n"))
    return cut(placed(taken, "run", "less", "track_id").withColumn("cluster_id", F.col("__place").cast("int")).drop("__place", "less"))


def clusters_of(x: DataFrame, runs: DataFrame, rounds: int = 300, least: int = 3) -> DataFrame:
    """(run, track_id, cluster_id): labels of the vectors of ``x`` by flat-kernel mean shift for each of ``runs`` (run, g, width) on its
    group; -1 for those in no cluster of ``least`` tracks."""
    spark, kind = x.sparkSession, dict(x.dtypes)["track_id"]
    state = ["run", "g", "width", "track_id", "block", "parts", "m"]
    modes = cut(x.join(F.broadcast(runs), "g").withColumnRenamed("f", "m").select(*state))
    settled, wide, pairs = [], len(x.first().f), _pairs(x)
    for done in range(rounds + 1):
        step = cut(_shift(modes, x, wide, pairs))
        largest = step.groupBy("run", "width").agg(F.max("step").alias("d")).collect()
        left = [(r.run,) for r in largest if r.d >= 1e-3 * r.width and done < rounds]
        open_ = step.join(F.broadcast(spark.createDataFrame(left, "open int")), F.col("run") == F.col("open"), "left")
        moves = F.col("open").isNotNull() & (F.col("step") >= STILL)
        settled.append(open_.where(~moves).select(*state, "n"))
        if not left:
            break
        merged = open_.where(moves).groupBy("run", "g", "width", "parts", "new").agg(F.min("track_id").alias("track_id"))
        modes = cut(merged.withColumnRenamed("new", "m").withColumn("block", _block("track_id")).select(*state))
    last = reduce(DataFrame.unionByName, settled).groupBy("run", "g", "width", "parts", "m").agg(F.min("track_id").alias("track_id"), F.max("n").alias("n"))
    centres = _centres(cut(last.withColumn("block", _block("track_id"))))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m, q, out = np.stack(a["m"]), np.stack(b["f"]), []
        number, ids = a["cluster_id"].to_numpy(), b["track_id"].to_numpy()
        for r in a["run"].unique():
            own = np.flatnonzero(a["run"] == r)
            for i, j, hit in _near(m[own], q, a["width"].iloc[own[0]]):
                p, o = np.nonzero(hit)
                p, o = own[i[p]], j[o]
                out.append(pd.DataFrame({"run": r, "track_id": ids[o], "far": np.sqrt(((m[p] - q[o]) ** 2).sum(axis=1)), "cluster_id": number[p]}))
        found = pd.concat(out) if out else pd.DataFrame(columns=["run", "track_id", "far", "cluster_id"])
        return found.sort_values(["far", "cluster_id"]).drop_duplicates(["run", "track_id"])

    best = _meet(centres.select("g", "run", "width", "block", "parts", "m", "cluster_id"), x, nearest, f"run int, track_id {kind}, far double, cluster_id int")
    best = cut(best.groupBy("run", "track_id").agg(F.min(F.struct("far", "cluster_id")).alias("b")))
    every = x.join(F.broadcast(runs), "g").select("run", "track_id", "c").join(best, ["run", "track_id"], "left")
    label = cut(every.select("run", "track_id", "c", F.coalesce("b.cluster_id", F.lit(-1)).alias("cluster_id")))
    small = label.groupBy("run", "cluster_id").agg(F.sum("c").alias("size")).where(F.col("size") < least).select("run", "cluster_id", F.lit(True).alias("small"))
    return label.join(small, ["run", "cluster_id"], "left").select("run", "track_id", "c", F.when(F.col("small"), -1).otherwise(F.col("cluster_id")).alias("cluster_id"))


def mean_shift(points: DataFrame, quantile: float = 0.2, block: int = BLOCK) -> DataFrame:
    """(g, track_id, cluster_id) as ``cluster_kernels.mean_shift`` on every group g (an integer)."""
    x, members = vectors(points, block)
    label = clusters_of(x, cut(widths_of(x, quantile).select(F.col("g").alias("run"), "g", "width")))
    return members.join(label.select(F.col("run").alias("g"), F.col("track_id").alias("first"), "cluster_id"), ["g", "first"]).drop("first")


def adaptive(points: DataFrame, widths: tuple[float, ...], clusters: int, block: int = BLOCK) -> DataFrame:
    """(g, track_id, cluster_id, score): mean shift at the bandwidth with the best score of shares and sizes on every group g (an
    integer), see ``clustering.adaptive_mean_shift``."""
    x, members = vectors(points, block)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("width")) for i, w in enumerate(widths)))).alias("w")
    runs = cut(x.groupBy("g").agg(F.sum("c").alias("all")).select("g", "all", each).select((F.col("g") * len(widths) + F.col("w.i")).alias("run"), "g", "w.width", "all"))
    label = cut(clusters_of(x, runs.drop("all")))
    sizes = label.where("cluster_id >= 0").groupBy("run", "cluster_id").agg(F.sum("c").alias("size"))
    sizes = sizes.groupBy("run").agg(F.count("*").alias("k"), F.avg("size").alias("mean"), F.var_pop("size").alias("var")).where(F.col("k") <= clusters)
    scored = sizes.join(runs, "run").withColumn("score", e("0.6D * mean / all + 0.4D / (1 + var / k)"))
    best = scored.groupBy("g").agg(F.max(F.struct("score", (-F.col("run")).alias("less"))).alias("b")).select("g", (-F.col("b.less")).alias("run"), "b.score")
    taken = label.join(F.broadcast(best), "run").select("g", F.col("track_id").alias("first"), "cluster_id", "score")
    out = members.join(taken, ["g", "first"], "left").drop("first")
    return out.select("g", "track_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def features(points: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """``vectors`` of one group, with the number of tracks and of blocks."""
    x, members = vectors(points.withColumn("g", F.lit(0)), block)
    return x, members.count(), max(1, x.agg(F.max("parts").alias("p")).first().p or 1)


def width_of(x: DataFrame, n: int, parts: int, quantile: float) -> float:
    """``widths_of`` on one group of ``features``."""
    return float(widths_of(x, quantile).first().width) if n > 1 else 0.1


def shifted(x: DataFrame, parts: int, width: float, rounds: int = 300, least: int = 3) -> DataFrame:
    """``clusters_of`` on one group of ``features``, whose vectors stand under their first track."""
    runs = x.sparkSession.createDataFrame([(0, 0, float(width))], "run int, g int, width double")
    return clusters_of(x, runs, rounds, least).select("track_id", "cluster_id")
