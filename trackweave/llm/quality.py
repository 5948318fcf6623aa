"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features are the distinct words of a text (those that tell the labels apart), ranges of statistics of its structure and of its
size.  Every two features interact through low-rank factors; the sum over all pairs comes in linear time from the square
of the sum minus the sum of squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, map_batches, table, written
from .language_id import remainder
from .textops import LOWER, chunks, split_words
from .toxicity import HASH_BITS, TRAIN_ROWS, chosen, label_counts, labelled_rows

RANK, RANGES = 8, 12

_is = lambda *ranges: np.isin(np.arange(256), np.concatenate([np.arange(a, b) for a, b in ranges]))
_UPPER, _LETTER, _DIGIT = _is((0x41, 0x5B)), _is((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)), _is((0x30, 0x3A))
_SYMBOL = _is((0x21, 0x22), (0x23, 0x27), (0x28, 0x2C), (0x2F, 0x30), (0x3C, 0x41), (0x5B, 0x61), (0x7B, 0x7F))
_STOP, _COMMA, _LINE = _is((0x2E, 0x2F), (0x3F, 0x40)), _is((0x2C, 0x2D)), _is((0x0A, 0x0B))


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def structure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words, their bounds, and a row of statistics for each document."""
    words = split_words(LOWER[data], offsets)
    hashes, bounds = words.hashes(), words.bounds
    n = len(offsets) - 1
    cells = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    key = np.unique((doc << HASH_BITS) | cells)
    cut = np.searchsorted(key >> HASH_BITS, np.arange(n + 1))
    size, count = np.maximum(1, np.diff(offsets)).astype(float), np.maximum(1, np.diff(bounds)).astype(float)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    length = (words.end - words.start).astype(float)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    bare = letters[words.end] == letters[words.start]
    heavy = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    marked = heavy[words.end] > heavy[words.start]
    out = np.column_stack(
        [
            np.log1p(np.diff(offsets)),
            np.log1p(np.diff(bounds)),
            np.diff(cut) / count,
            _per_doc(again, bounds) / count,
            _per_doc(length, bounds) / count,
            _per_doc(bare, bounds) / count,
            _per_doc(marked, bounds) / count,
            _per_doc(_SYMBOL[data], offsets) / size,
            _per_doc(_UPPER[data], offsets) / np.maximum(1, _per_doc(_LETTER[data], offsets)),
            _per_doc(_DIGIT[data], offsets) / size,
            _per_doc(_STOP[data], offsets) / count,
            _per_doc(_COMMA[data], offsets) / count,
            _per_doc(_LINE[data], offsets) / count,
        ]
    )
    return key & ((1 << HASH_BITS) - 1), cut, out


@dataclass(frozen=True)
class Machine:
    """Feature of each hashed word (-1: none), the ranges' limits by statistic, bias, weights and factors."""

    word: np.ndarray
    limits: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, cells: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value): statistics first, then words with values that keep a long text's sum bounded."""
        n, k = stats.shape
        place = np.empty((n, k), dtype=np.int64)
        for j in range(k):
            place[:, j] = j * RANGES + np.searchsorted(self.limits[j], stats[:, j], side="right")
        row = np.repeat(np.arange(n), np.diff(bounds))
        own = self.word[cells]
        row, own = row[own >= 0], own[own >= 0]
        count = np.bincount(row, minlength=n)
        value = 1 / np.sqrt(np.maximum(1, count))[row]
        return np.concatenate((np.repeat(np.arange(n), k), row)), np.concatenate((place.ravel(), own)), np.concatenate((np.full(n * k, k**-0.5), value))

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output, and the sums of factors that gradients need too."""
        linear = np.bincount(row, weights=self.weights[feature] * value, minlength=n)
        sums, squares = np.zeros((n, RANK)), np.zeros(n)
        for f in range(RANK):
            x = self.factors[feature, f] * value
            sums[:, f] = np.bincount(row, weights=x, minlength=n)
            squares += np.bincount(row, weights=x * x, minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(*structure(data, offsets)), n)[0], -30, 30)))


def fit(cells: np.ndarray, bounds: np.ndarray, stats: np.ndarray, labels: np.ndarray, *, steps: int = 250, decay: float = 2e-4, seed: int = 7) -> Machine:
    """By Adam on all rows, with their picked words; with no rows or one label only the machine is constant."""
    n, kinds = len(labels), stats.shape[1]
    word = np.full(1 << HASH_BITS, -1, dtype=np.int64)
    limits = np.quantile(stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T if n else np.zeros((kinds, RANGES - 1))
    rate = float(labels.mean()) if n else 0.5
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    base = kinds * RANGES
    if not n or labels.min() == labels.max():
        return Machine(word, limits, bias, np.zeros(base), np.zeros((base, RANK)))
    picked = np.unique(cells)
    word[picked] = base + np.arange(len(picked))
    size = base + len(picked)
    factors = np.random.default_rng(seed).normal(0, 0.05, (size, RANK))
    machine = Machine(word, limits, bias, np.zeros(size), factors)
    row, feature, value = machine.rows(cells, bounds, stats)
    state = np.zeros((2, size, RANK + 1))
    for t in range(1, steps + 1):
        out, sums = machine.raw(row, feature, value, n)
        err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels) / n
        grad = np.empty((size, RANK + 1))
        ev = err[row] * value
        grad[:, 0] = np.bincount(feature, weights=ev, minlength=size) + decay * machine.weights
        own = np.bincount(feature, weights=ev * value, minlength=size)
        for f in range(RANK):
            grad[:, f + 1] = np.bincount(feature, weights=ev * sums[row, f], minlength=size) - own * machine.factors[:, f] + decay * machine.factors[:, f]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        machine = Machine(word, limits, machine.bias - 0.5 * float(err.sum()), machine.weights - step[:, 0], machine.factors - step[:, 1:])
    return machine


def train(labelled: DataFrame, *, text: str = "text", label: str = "quality", key: str = "doc_id", bound: int = TRAIN_ROWS) -> Machine:
    """A machine from at most ``bound`` of the rows with a non-null label, chosen by hash."""
    rows = written(bounded_ids(labelled.where(F.col(label).isNotNull()), key, bound).select(label, text), "sample")
    asked = rows.sparkSession.sparkContext.broadcast(chosen(*label_counts(rows, text, label, lambda data, offsets: structure(data, offsets)[:2]), least=8, z=5.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                cells, bounds, stats = structure(data, offsets)
                own = np.isin(cells, asked.value)
                cells, bounds = cells[own], np.concatenate(([0], np.cumsum(own)))[bounds]
                flat = pa.array(np.arange(0, stats.size + 1, stats.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(cells.astype(np.int32))), pa.ListArray.from_arrays(flat, pa.array(stats.ravel()))],
                    names=["label", "cells", "stats"],
                )

    got = map_batches(rows.select(F.col(label).cast("int").alias("label"), F.col(text).cast("string").alias("text")), run, "label int, cells array<int>, stats array<double>").toArrow().combine_chunks()
    kinds = structure(np.zeros(0, dtype=np.uint8), np.array([0, 0]))[2].shape[1]
    if not got.num_rows:
        return fit(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((0, kinds)), np.zeros(0))
    lists = got.column("cells").combine_chunks()
    bounds = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
    return fit(lists.flatten().to_numpy().astype(np.int64), bounds, got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, kinds), got.column("label").to_numpy().astype(np.float64))


def scored(df: DataFrame, machine: Machine, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns with score and predicted (1 from ``threshold`` on).

    Null texts count as empty; rows that repeat are scored one by one; an empty table gives an empty result; texts of any
    length are read whole.  Columns of ``keep`` with the names of new ones aren't allowed.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                score = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return map_batches(source, run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(labelled_rows(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    return scored(docs, machine).select("doc_id", (F.coalesce(remainder("doc_id", 3), F.lit(-1)) == 1).alias("held_out"), "score", "predicted")
