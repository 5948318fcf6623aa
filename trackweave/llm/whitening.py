"""Embedding whitening by a singular value decomposition of the centred vectors.

Vectors are put on a grid of whole numbers, so that sums are exact; each distinct one counts once.  Every task compresses its centred
rows block by block to a triangle R (TSQR), rounds of tasks stack a fixed number of triangles and compress them again, and the last one,
as large as the square of the dimensions, is taken apart on the driver: plane rotations make its columns orthogonal (one-sided
Jacobi), the rotations give the components and the columns' lengths the standard deviations, without forming a covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Triangles that a task of a round stacks.
FAN_IN = 16
#: Grid values stay exact as doubles: scaled entries beyond this are set to it.
FURTHEST = float(1 << 52)
_LOW = 26


def on_grid(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift as longs."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-FURTHEST)), F.lit(FURTHEST))).cast("long") + shift)


def usable(vector: Column) -> Column:
    """Whether the vector and all its entries are there and finite."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling, of ``r``.

    A sweep rotates every pair of columns once; the pairs of a step have no column in common and are rotated together.
    """
    dims = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = r[:, order].astype(np.float64), np.eye(dims)[:, order]
    size = dims + dims % 2
    ring = np.arange(size)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(size - 1):
            i, j = ring[: size // 2], ring[size // 2 :][::-1]
            inside = (i < dims) & (j < dims)
            i, j = np.minimum(i, j)[inside], np.maximum(i, j)[inside]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            share = np.abs(xy) / np.maximum(np.sqrt(xx) * np.sqrt(yy), np.finfo(float).tiny)
            worst = max(worst, float(share.max(initial=0.0)))
            turn = share > 1e-16
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            tan = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            cos = 1 / np.sqrt(1 + tan * tan)
            sin = cos * tan
            a[:, i], a[:, j] = cos * x - sin * y, sin * x + cos * y
            p, q = v[:, i], v[:, j]
            v[:, i], v[:, j] = cos * p - sin * q, sin * p + cos * q
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if worst < 4e-15:
            break
    sigma = np.linalg.norm(a, axis=0)
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with exact ``sums`` by dimension; eigenvalues of the covariance, its trace and unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    trace: float
    vectors: np.ndarray

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part of the mean, and n times its fraction."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return whole, np.array([s - int(w) * self.n for s, w in zip(self.sums, whole, strict=True)], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.rest()
        return (x - whole).astype(np.float64) - rest / self.n

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S)**2, exact; null where a long can't hold one."""
        whole, rest = self.rest()
        off = x - whole
        reach = float(self.n) * (float(np.abs(off).max(initial=0)) + 1)
        if reach * reach * max(1, x.shape[1]) < 9e18:
            return pa.array(((off * self.n - rest) ** 2).sum(axis=1), pa.int64())
        exact = ((off.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([int(d) if d < 1 << 63 else None for d in exact], pa.int64())


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fitted: DataFrame, dims: int) -> list[int]:
    """Exact sums by dimension, of high and low bits on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for x in _blocks(batches, dims):
            high += (x >> _LOW).sum(axis=0)
            low += (x & ((1 << _LOW) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    rows = map_batches(fitted, run, "i long, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    return [(r["high"] << _LOW) + r["low"] for r in rows]


def _triangle(fitted: DataFrame, dims: int, centre: Whitening) -> np.ndarray:
    """R of the centred rows, up to signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for x in _blocks(batches, dims):
            r = np.linalg.qr(np.vstack((r, centre.centred(x))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["key", "r"])

    def stacked(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r).reshape(-1, dims) for r in group.sort_values("key")["r"]]
        return pd.DataFrame({"key": [int(group["key"].iloc[0]) // FAN_IN], "r": [np.linalg.qr(np.vstack(parts), mode="r").tobytes()]})

    parts = written(map_batches(fitted, run, "key long, r binary"), "triangles")
    while (parts.agg(F.max("key")).first()[0] or 0) > 0:
        parts = written(parts.groupBy(F.floor(F.col("key") / FAN_IN)).applyInPandas(stacked, "key long, r binary"), "triangles")
    last = parts.first()
    return np.frombuffer(last["r"]).reshape(-1, dims) if last else np.zeros((0, dims))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct rows of ``vectors`` (x: array<long>) of the most common length (the longest of several), and these
    rows as a stored table; None without any row that has entries."""
    fitted = written(vectors.select("x").distinct(), "fitted")
    most = fitted.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).where("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    n, dims = most["n"], most["dims"]
    fitted = fitted.where(F.size("x") == dims)
    centre = Whitening(n, tuple(_summed(fitted, dims)), np.zeros(0), 0.0, np.zeros((dims, 0)))
    r = _triangle(fitted, dims, centre)
    sigma, v = jacobi(r)
    rank = min(components, int((sigma > sigma[0] * max(r.shape) * np.finfo(float).eps).sum()))
    return Whitening(n, centre.sums, sigma[:rank] ** 2 / n, float((sigma**2).sum() / n), v[:, :rank]), fitted


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the whitened rows' covariance minus the identity."""
    dims, k = model.vectors.shape
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in _blocks(batches, dims):
            w = model.white(x)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "v"])

    rows = map_batches(fitted, run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return float(np.abs(np.array([r["v"] for r in rows]).reshape(k, k) / model.n - np.eye(k)).max())


def whitened(df: DataFrame, *, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``keep`` columns with component, n, deviation, whitened, explained and identity_error, a row for each component.

    Rows whose vector is null or has null or non-finite entries are left out, and so are those of another length than most distinct
    vectors have (the longest of several).  A component exists where the vectors vary: as many as their rank, ``components`` at most,
    so a table of one distinct vector, or of none, gives an empty result.  Components are numbered from 1 by falling eigenvalue.
    Repeated vectors count once in the fit; each row gets its result, with ids of any kind, repeated or null.  Scaled entries
    beyond 2**52 are set to it, and a deviation that a long can't hold is null.  Columns of ``keep`` with names of new ones are refused.
    """
    new = {"component": F.lit(0), "n": F.lit(0).cast("long"), "deviation": F.lit(None).cast("long"), "whitened": F.lit(0.0), "explained": F.lit(0.0), "identity_error": F.lit(0.0)}
    if clash := set(keep) & set(new):
        raise ValueError(f"columns of keep have names of new ones: {sorted(clash)}")
    rows = df.where(usable(F.col(vector))).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), on_grid(F.col(vector), scale, shift).alias("x"))
    schema = df.select(*keep).withColumns(new).schema
    found = fit(rows, components)
    if found is None or not found[0].vectors.shape[1]:
        return df.sparkSession.createDataFrame([], schema)
    model, fitted = found
    dims, k = model.vectors.shape
    error = identity_error(fitted, model)
    share = model.eigenvalues / model.trace
    shared, names = df.sparkSession.sparkContext.broadcast(model), [*keep, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = next(_blocks([batch], dims))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [c.take(each) for c in batch.columns[:-1]]
            size = len(x) * k
            columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, model.n)), model.deviations(x).take(each)]
            columns += [pa.array(model.white(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(size, error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows.where(F.size("x") == dims), run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
