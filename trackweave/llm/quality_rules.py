"""Quality rules: counts of each text, and its perplexity under an n-gram model of the whole corpus.

The model is modified Kneser-Ney over byte n-grams (letters lower-cased, digits and white space made one).  Tasks count the n-grams of
their texts, Spark sums them, and each order's probabilities come from joins with the order below; nothing is pruned or sampled, so
the tables grow with the corpus.  The finished entries are stored as arrays of values beside sorted 64-bit hashes.  Texts are scored
against the arrays as long as these fit ``BROADCAST_BYTES``; the n-grams of larger models are looked up by a join.  Every language
has its own upper and lower limit of perplexity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table, written
from .textops import LOWER, SPACE, Words, chunks, mix64, split_words, window_hashes

ORDER = 5
#: Entries of one array of the stored model, bytes of a model that is broadcast, and n-grams that a task holds before it sends them on.
BLOCK, BROADCAST_BYTES, HELD = 1 << 16, 96 << 20, 1 << 21
#: Text of one lookup by join.
CHUNK_BYTES = 4 << 20
#: Limits lie this many quartile distances outside the quartiles of log perplexity, the outer fences of a box plot; the width of
#: its histogram's cells, and their number.
REACH, CELL, CELLS = 3.0, 0.005, 2400
#: The rules' own limits.
LEAST_WORDS, MOST_REPEATED = 50, 50

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_NORMAL = LOWER.copy()
_NORMAL[0x09:0x0E], _NORMAL[0x30:0x3A] = 0x20, 0x30
_START = 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _seen_before(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, value): whether it stands further up too, and whether it stands anywhere else."""
    order = np.lexsort((value, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    before, twice = np.zeros(len(value), dtype=bool), np.zeros(len(value), dtype=bool)
    before[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return before, twice


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``COUNTS`` for each document."""
    n = len(offsets) - 1
    words = split_words(data, offsets)
    hashes = words.hashes()
    windows, first = window_hashes(hashes, words.bounds, 3)
    _, twice = _seen_before(np.searchsorted(words.bounds, first, side="right"), windows)
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + 3, -1)
    covered = np.cumsum(edge[:-1]) > 0
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, offsets[1:])))
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(offsets, start, side="right") - 1
    again, _ = _seen_before(doc, Words(data, start, end, np.zeros(1, dtype=np.int64)).hashes())
    return np.column_stack(
        [words.counts, _sums(~SPACE[data] & ((data & 0xC0) != 0x80), offsets), _sums(SYMBOLS[data], offsets), np.bincount(doc[again], minlength=n), _sums(covered, words.bounds)]
    )


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` - 1 before it as one number; a text starts after marks of its start."""
    pad = order - 1
    place = np.arange(len(data)) + pad * (1 + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
    line = np.full(len(data) + pad * len(offsets), _START, dtype=np.uint64)
    line[place] = _NORMAL[data]
    out = np.zeros(len(data), dtype=np.uint64)
    for back in range(pad, -1, -1):
        out = (out << np.uint64(8)) | line[place - back]
    return out


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


@dataclass(frozen=True)
class Model:
    """Sorted hashes and values by kind: ``order`` for log probabilities of n-grams, -``order`` for the log weight that a context of
    that order's n-grams leaves to the order below."""

    order: int
    arrays: dict[int, tuple[np.ndarray, np.ndarray]]

    def value(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """NaN where there is no entry."""
        hashes, values = self.arrays.get(kind, (np.zeros(0, dtype=np.uint64), np.zeros(0)))
        out = np.full(len(keys), np.nan)
        if len(hashes):
            asked = mix64(keys)
            at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
            hit = hashes[at] == asked
            out[hit] = values[at[hit]]
        return out

    def log_p(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        order = self.order if order is None else order
        if not order:
            return np.full(len(keys), -np.log(256.0))
        out = self.value(order, keys)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            left = self.value(-order, keys[new] >> np.uint64(8))
            out[new] = np.where(np.isnan(left), 0.0, left) + self.log_p(keys[new] & np.uint64(_mask(order - 1)), order - 1)
        return out


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """The discounts of n-grams seen once, twice and more often, from the numbers of n-grams seen one to four times; fixed ones where
    these numbers allow none."""
    c = [counts.get(k, 0) for k in (1, 2, 3, 4)]
    if min(c) > 0:
        y = c[0] / (c[0] + 2 * c[1])
        found = tuple(k + 1 - (k + 2) * y * c[k + 1] / c[k] for k in range(3))
        if all(0 < d <= k + 1 for k, d in enumerate(found)):
            return found
    return 0.5, 1.0, 1.5


def counted(df: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, n) of all n-grams of all texts.  A task adds up its texts' n-grams and sends them on whenever it holds ``HELD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

        def merge() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([k for k, _ in parts])
            by = np.argsort(every, kind="stable")
            every = every[by]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            return every[first], np.add.reduceat(np.concatenate([c for _, c in parts])[by], first)

        keys, n, parts, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), CHUNK_BYTES):
                if len(data):
                    parts.append(np.unique(grams(data, offsets, order), return_counts=True))
                    size += len(parts[-1][0])
                if size > HELD:
                    keys, n = merge()
                    parts, size = [(keys, n)], len(keys)
                    if size > HELD // 2:
                        yield out()
                        parts, size = [], 0
        if parts:
            keys, n = merge()
            yield out()

    found = map_batches(df.select(F.col(text).cast("string").alias("text")), run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def train(df: DataFrame, *, text: str = "text", order: int = ORDER) -> DataFrame:
    """The model of all texts as a stored table (kind, key, value), kinds as in ``Model``.

    Orders below the highest count the different bytes that an n-gram follows, not its places.
    """
    if not 1 <= order <= 7:
        raise ValueError("n-grams have 1 to 7 bytes")
    counts = {order: written(counted(df, text, order), "grams")}
    for k in range(order - 1, 0, -1):
        counts[k] = written(counts[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.count("*").alias("n")), "grams")
    entries, lower = None, None
    for k in range(1, order + 1):
        few = counts[k].where("n <= 4").groupBy("n").count().collect()
        d = discounts({r["n"]: r["count"] for r in few})
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = Window.partitionBy("context")
        rows = counts[k].select("key", F.shiftright("key", 8).alias("context"), "n", off.alias("off"))
        rows = rows.withColumns({"total": F.sum("n").over(own), "left": F.sum("off").over(own)})
        rows = rows.withColumns({"alpha": (F.col("n") - F.col("off")) / F.col("total"), "gamma": F.col("left") / F.col("total")})
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit(_mask(k - 1)))).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
        rows = written(rows.select("key", "context", "gamma", (F.col("alpha") + F.col("gamma") * F.col("below")).alias("p")), "order")
        lower = rows
        both = rows.select(F.lit(k).alias("kind"), "key", F.log("p").alias("value"))
        both = both.unionByName(rows.groupBy("context").agg(F.max("gamma").alias("gamma")).select(F.lit(-k).alias("kind"), F.col("context").alias("key"), F.log("gamma").alias("value")))
        entries = both if entries is None else entries.unionByName(both)
    return written(entries, "model")


def stored_arrays(entries: DataFrame) -> DataFrame:
    """The entries as rows (kind, block, hashes, values) of sorted arrays, each about ``BLOCK`` long."""
    bits = max(0, (entries.count() // BLOCK).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix64(batch.column(1).to_numpy())
            block = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(block), pa.array(h.view(np.int64)), batch.column(2)], names=["kind", "block", "hash", "value"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        h = group["hash"].to_numpy().view(np.uint64)
        by = np.argsort(h)
        return pd.DataFrame({"kind": group["kind"].iloc[:1].to_numpy(), "block": group["block"].iloc[:1].to_numpy(), "hashes": [h[by].tobytes()], "values": [group["value"].to_numpy()[by].astype(np.float32).tobytes()]})

    hashed = map_batches(entries.select("kind", "key", "value"), run, "kind int, block long, hash long, value double")
    return written(hashed.groupBy("kind", "block").applyInPandas(pack, "kind int, block long, hashes binary, values binary"), "arrays")


def _assembled(rows: list[tuple[int, int, bytes, bytes]], order: int) -> Model:
    parts: dict[int, list] = {}
    for kind, _, hashes, values in sorted(rows, key=lambda r: r[:2]):
        parts.setdefault(kind, []).append((np.frombuffer(hashes, dtype=np.uint64), np.frombuffer(values, dtype=np.float32)))
    return Model(order, {k: (np.concatenate([h for h, _ in p]), np.concatenate([v for _, v in p])) for k, p in parts.items()})


def _measured(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    n = len(offsets) - 1
    p = model.log_p(grams(data, offsets, model.order))
    total = np.bincount(np.repeat(np.arange(n), np.diff(offsets)), weights=p, minlength=n)
    size = np.diff(offsets)
    surprise = pa.array(np.where(size > 0, -total / np.maximum(1, size), 0.0), mask=size == 0)
    return [*(pa.array(c.astype(np.int64)) for c in text_counts(data, offsets).T), surprise]


_NEW = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("surprise", T.DoubleType())])


def measured(df: DataFrame, entries: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns with ``COUNTS`` and surprise (mean negative log probability of a byte: the log of the perplexity)."""
    source = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*source.drop("text").schema, *_NEW])
    names = schema.names
    if entries.count() * 12 <= broadcast_bytes:
        arrays = stored_arrays(entries).toArrow().combine_chunks()
        shared = df.sparkSession.sparkContext.broadcast(_assembled(list(zip(*(c.to_pylist() for c in arrays.columns), strict=True)), order))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *_measured(shared.value, data, offsets)], names=names)

        out = map_batches(source, run, schema)
    else:
        out = _looked_up(source, entries, order, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *_NEW.names)


def _looked_up(source: DataFrame, entries: DataFrame, order: int, schema: T.StructType) -> DataFrame:
    """Chunks of texts ask for the entries of their n-grams and contexts by a join, and are scored with what comes back."""
    names = ["chunk", *source.columns]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b, data, _ in chunks(batch.column(batch.num_columns - 1)):
                if held and held + len(data) > CHUNK_BYTES:
                    number, held = number + 1, 0
                held += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), *(c.slice(a, b - a) for c in batch.columns)], names=names)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for c in np.unique(number):
                part = batch.column(1).filter(pa.array(number == c))
                for _, _, data, offsets in chunks(part, CHUNK_BYTES):
                    key = np.unique(grams(data, offsets, order))
                    for k in range(order, 0, -1):
                        for kind, keys in ((k, key), (-k, np.unique(key >> np.uint64(8)))):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c)), pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.astype(np.int64))], names=["chunk", "kind", "key"])
                        key = np.unique(key & np.uint64(_mask(k - 1)))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        kinds, keys, values = (answers.column(c).to_numpy() for c in ("kind", "key", "value"))
        arrays = {}
        for kind in np.unique(kinds):
            h = mix64(keys[kinds == kind])
            by = np.argsort(h)
            arrays[int(kind)] = (h[by], values[kinds == kind][by].astype(np.float32))
        model, out = Model(order, arrays), []
        for batch in texts.to_batches():
            for a, b, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                out.append(pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:-1]), *_measured(model, data, offsets)], names=schema.names))
        return pa.Table.from_batches(out)

    texts = written(map_batches(source, dealt, T.StructType([T.StructField("chunk", T.LongType(), False), *source.schema])), "texts")
    answers = map_batches(texts.select("chunk", "text"), asked, "chunk long, kind int, key long").distinct().join(entries, ["kind", "key"])
    return texts.groupBy("chunk").cogroup(answers.select("chunk", "kind", "key", "value").groupBy("chunk")).applyInArrow(score, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(rows: DataFrame, *, lang: str = "lang", reach: float = REACH) -> DataFrame:
    """(lang, lower, upper) of surprise: ``reach`` quartile distances outside the quartiles of each language's rows, from a histogram
    with cells of ``CELL``."""
    cell = F.least(F.floor(F.col("surprise") / CELL), F.lit(CELLS - 1))
    counts = rows.where("surprise is not null").groupBy(F.col(lang).alias("lang"), cell.alias("cell")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    ranked = counts.select("lang", "cell", F.sum("n").over(own.orderBy("cell")).alias("upto"), F.sum("n").over(own).alias("all"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell")))
    found = ranked.groupBy("lang").agg(quartile(0.25).alias("low"), quartile(0.75).alias("high"))
    width = reach * (F.col("high") + 1 - F.col("low"))
    return found.select("lang", ((F.col("low") - width) * CELL).alias("lower"), ((F.col("high") + 1 + width) * CELL).alias("upper"))


def judged(df: DataFrame, *, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, reach: float = REACH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns with ``COUNTS``, base_failed, perplexity (of a byte), lower and upper (its limits in the language) and kept.

    Texts with fewer than 50 words, or with more than half of their words in repeated windows, fail the base rules; others are kept
    within their language's limits, which come from the texts that pass the base rules.  Null texts count as empty: no words, no
    perplexity, failed.  A null language is a language of its own.  Repeated rows are counted and judged one by one; texts of any
    length are read whole; an empty table gives an empty result.  Columns of ``keep`` with names of new ones are refused.
    """
    new = [*COUNTS, "base_failed", "perplexity", "lower", "upper", "kept"]
    if clash := set(keep) & set(new):
        raise ValueError(f"columns of keep have names of new ones: {sorted(clash)}")
    kept = [f"__keep{i}" for i in range(len(keep))]
    source = df.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col(lang).alias("__lang"), F.col(text).alias("text"))
    rows = measured(source, train(df, text=text, order=order), keep=(*kept, "__lang"), order=order, broadcast_bytes=broadcast_bytes)
    rows = written(rows.withColumn("base_failed", base_failed()), "measured")
    limits = bands(rows.where("not base_failed"), lang="__lang", reach=reach)
    out = rows.join(limits, F.col("__lang").eqNullSafe(F.col("lang")), "left")
    inside = F.coalesce(F.col("surprise").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select(
        *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), *COUNTS, "base_failed", F.exp("surprise").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), (~F.col("base_failed") & inside).alias("kept")
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
