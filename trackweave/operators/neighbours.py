"""Exact nearest neighbours of vectors by pivots: no pair is made whose cells are too far apart to matter.

Vectors are dealt to the nearest of a few pivots.  The triangle inequality leaves out every cell that can't hold a neighbour better
than the ``k`` a vector has found in its own block; the cells that are left are met block by block, so a task never holds more than
a block of vectors and a block of askers, however large a group or a cell is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut

#: Guard of a norm, and the digits by which likenesses are compared.
EPS, DIGITS = 1e-8, 9
e = F.expr


def _units(rows: pd.Series) -> np.ndarray:
    """Rows at length 1; a zero row gets a direction of its own, so that it is far from all others."""
    x = np.array(rows.tolist(), dtype=float)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    flat = size[:, 0] == 0
    return np.column_stack((x / np.where(size > 0, size, 1.0), flat.astype(float)))


def _likeness(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Rounded cosines with a guard on each norm."""
    left, right = np.array(a.tolist(), dtype=float), np.array(b.tolist(), dtype=float)
    p, q = (m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS) for m in (left, right))
    return np.round(p @ q.T, DIGITS)


def _best(sim: np.ndarray, mine: np.ndarray, theirs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``k`` most alike others, ties by their id."""
    sim = np.where(mine[:, None] == theirs[None, :], -np.inf, sim)
    order = np.lexsort((np.broadcast_to(theirs, sim.shape), -sim), axis=1)[:, :k]
    row = np.repeat(np.arange(len(mine)), order.shape[1])
    column = order.ravel()
    there = np.isfinite(sim[row, column])
    return row[there], column[there]


def _dealt(vectors: DataFrame, group: str, key: str, pivots: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Vectors (g, id, vector) with their hash h, distances ``away`` to all pivots, cell and block, and one row a cell: its reach, its number of blocks, and how far its
    pivot is apart from the others."""
    x = vectors.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col("vector").isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("id"), "vector")
    x = x.withColumn("h", F.xxhash64("id"))
    drawn = [r.vector for r in x.orderBy(F.xxhash64("h"), "id").limit(pivots).select("vector").collect()]
    heads = _units(pd.Series(drawn)) if drawn else np.zeros((1, 1))

    def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.sqrt(np.maximum(0.0, 2 - 2 * _units(pdf["vector"]) @ heads.T)) if len(pdf) else np.zeros((0, 1))
            yield pdf.assign(away=list(d), cell=d.argmin(axis=1).astype("int32"))

    schema = ", ".join(f"{c} {t}" for c, t in x.dtypes) + ", away array<double>, cell int"
    placed = cut(x.mapInPandas(away, schema))
    cells = placed.groupBy("g", "cell").agg(F.max(F.col("away")[F.col("cell")]).alias("reach"), F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    apart = [(n, row.tolist()) for n, row in enumerate(np.sqrt(np.maximum(0.0, 2 - 2 * heads @ heads.T)))]
    cells = cut(cells.join(F.broadcast(vectors.sparkSession.createDataFrame(apart, "cell int, apart array<double>")), "cell"))
    own = placed.join(cells.select("g", "cell", "blocks"), ["g", "cell"]).withColumn("block", F.pmod("h", "blocks").cast("int")).drop("blocks")
    return own, cells


def _visits(base: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Each vector with the cells (other) that may hold one of its ``k`` nearest, judged by the ``k`` found in its own block."""

    def first(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        sim = _likeness(pdf["vector"], pdf["vector"])
        row, column = _best(sim, ids, ids, k)
        found = np.full((len(ids), k), -1.0)
        found[row, np.arange(len(row)) - np.searchsorted(row, row)] = sim[row, column]
        low = found.min(axis=1)
        # The guards shrink likenesses, so below 0 they say nothing about the angle: all cells are met.
        return pdf.drop(columns="block").assign(bound=np.where(low < 0, 3.0, np.sqrt(np.maximum(0.0, 2 - 2 * low)) + 1e-4))

    schema = ", ".join(f"{c} {t}" for c, t in base.drop("block").dtypes) + ", bound double"
    asking = cut(base.groupBy("g", "cell", "block").applyInPandas(first, schema))
    there = cells.select("g", F.col("cell").alias("other"), "reach", "blocks", "apart")
    # A vector of another cell is nearer to that cell's pivot, so at least as far away as the plane between the two pivots.
    plane = "if(apart[cell] > 0, (pow(away[other], 2) - pow(away[cell], 2)) / (2 * apart[cell]), 0D)"
    return asking.join(there, "g").where(f"away[other] - reach <= bound and {plane} <= bound").select("g", "other", "blocks", "id", "vector", "h")


def nearest(vectors: DataFrame, k: int, *, group: str = "label", key: str = "vec_id", pivots: int = 64, most: int = 2_000) -> DataFrame:
    """(group, i, j, sim, rank): for every vector the ``k`` others of its group with the largest cosine, ties by the smaller id.

    All neighbours are exact, for groups of any size.  Likenesses are compared at nine digits.  Ids are unique in a group; rows
    without a group, an id or a vector are left out; a vector of zeros is like none (0); a group of one row gives no row, a smaller
    group than ``k`` all its pairs; an empty table gives none.  Only ``pivots`` vectors are at the driver.
    """
    kinds = dict(vectors.dtypes)
    one, name = kinds[key], kinds[group]
    own, cells = _dealt(vectors, group, key, pivots, most)

    base = own.select("g", "cell", "id", F.col("vector").cast("array<double>").alias("vector"), "h", "away", "block")
    visits = _visits(base, cells, k)
    askers = cut(visits.groupBy("g", "other").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks")))
    mine = visits.join(askers, ["g", "other"]).withColumn("chunk", F.pmod(F.xxhash64("h"), "chunks").cast("int"))
    mine = mine.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "other", "block", "chunk", "id", "vector")
    theirs = base.select("g", F.col("cell").alias("other"), "block", "id", "vector").join(askers, ["g", "other"])
    theirs = theirs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("g", "other", "block", "chunk", "id", "vector")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["g", "i", "j", "sim"])
        sim, mine_, theirs_ = _likeness(a["vector"], b["vector"]), a["id"].to_numpy(), b["id"].to_numpy()
        row, column = _best(sim, mine_, theirs_, k)
        return pd.DataFrame({"g": a["g"].to_numpy()[row], "i": mine_[row], "j": theirs_[column], "sim": sim[row, column]})

    on = ("g", "other", "block", "chunk")
    met = mine.groupBy(*on).cogroup(theirs.groupBy(*on)).applyInPandas(meet, f"g {name}, i {one}, j {one}, sim double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("g", "i").orderBy(F.desc("sim"), "j"))).where(F.col("rank") <= k)
    return ranked.select(F.col("g").alias(group), "i", "j", "sim", "rank")


def mutual(near: DataFrame) -> DataFrame:
    """(i, j, sim) with i < j of ``nearest``: pairs of which each is among the other's neighbours."""
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return near.where("i < j").select("i", "j", "sim").join(back, ["i", "j"], "left_semi")
