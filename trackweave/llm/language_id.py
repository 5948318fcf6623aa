"""Language identification with bit-sliced Bloom filters of n-grams.

A filter row is a bitmask of languages; the rows at an n-gram's places, ANDed, give every language whose filter has the
n-gram, all in one probe.  A language's filter holds the n-grams that are common in it and not much more common in another.
For each text the bits are counted by language, the count expected from false positives is taken off, and the language
with the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, map_batches, table
from .textops import LOWER, chunks, mix64

GRAM, PROBES, ROW_BITS, COUNT_BITS = 4, 2, 20, 20
#: Documents used for training at most, chosen by hash.
TRAIN_DOCS = 20_000
#: Languages at most, one bit of a mask each.
LANGUAGES = 64

_FOLD = LOWER.copy()
_FOLD[:0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams (bytes of letters, everything else in ASCII as a space) and each document's bounds in them.

    Each document gets a space before and behind, so a single letter has n-grams too.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    pad = GRAM - 1
    out = np.full(len(data) + 2 * pad * n, 0x20, dtype=np.uint8)
    start = offsets[:-1] + pad + 2 * pad * np.arange(n)
    folded = _FOLD[data]
    upper = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded = folded + (upper * np.uint8(0x20))
    out[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = folded
    ends = np.cumsum(size + 2 * pad)
    code = np.zeros(max(0, len(out) - pad), dtype=np.uint64)
    for i in range(GRAM):
        code |= out[i : len(code) + i].astype(np.uint64) << np.uint64(8 * i)
    blank = np.uint64(int.from_bytes(b" " * GRAM, "little"))
    keep = code != blank
    for i in range(1, pad + 1):
        keep[ends[:-1] - i] = False
    return mix64(code[keep]), np.concatenate(([0], np.cumsum(keep)))[np.minimum(np.concatenate(([0], ends)), len(keep))]


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(1, counts.sum(axis=-1, keepdims=True))


@dataclass(frozen=True)
class Filters:
    """Rows of language bitmasks, the languages, each one's false-positive rate, and the most frequent one."""

    rows: np.ndarray
    languages: tuple[str, ...]
    false_rate: np.ndarray
    usual: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For every n-gram the bitmask of all languages that contain it."""
        if not self.languages:
            return np.zeros(len(grams), dtype=np.uint64)
        mask = self.rows[(grams & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)]
        for i in range(1, PROBES):
            mask = mask & self.rows[((grams >> np.uint64(ROW_BITS * i)) & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)]
        return mask

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each document."""
        grams, bounds = _grams(data, offsets)
        mask, total = self.masks(grams), np.diff(bounds)
        share = np.zeros((len(total), len(self.languages)))
        for k in range(len(self.languages)):
            bit = np.concatenate(([0], np.cumsum((mask >> np.uint64(k)) & np.uint64(1))))
            found = (bit[bounds[1:]] - bit[bounds[:-1]]).astype(np.float64)
            share[:, k] = np.maximum(0, (found / np.maximum(1, total) - self.false_rate[k]) / (1 - self.false_rate[k]))
        best = np.where(share.max(axis=1) > 0, share.argmax(axis=1), self.usual)
        return best, np.where(share.sum(axis=1) > 0, share.max(axis=1) / np.maximum(1e-12, share.sum(axis=1)), 1 / len(self.languages))


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", common: float = 2e-5, ratio: float = 0.5) -> Filters:
    """Filters from rows with a non-null language and text; n-grams are counted in the tasks and summed by Spark."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    seen = rows.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(seen) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = tuple(r["lang"] for r in seen)
    if not languages:
        return Filters(np.zeros(1 << ROW_BITS, dtype=np.uint64), (), np.zeros(0), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << COUNT_BITS), dtype=np.int64)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                grams, bounds = _grams(data, offsets)
                cell = (grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                own = np.array([languages.index(x) for x in batch.column(0).slice(a, b - a).to_pylist()])
                for k in range(len(languages)):
                    counts[k] += np.bincount(cell[np.repeat(own, np.diff(bounds)) == k], minlength=1 << COUNT_BITS)
        for k in range(len(languages)):
            have = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(have), k)), pa.array(have), pa.array(counts[k][have])], names=["lang", "cell", "n"])

    counts = np.zeros((len(languages), 1 << COUNT_BITS))
    table_ = map_batches(rows, run, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts[table_.column("lang").to_numpy(), table_.column("cell").to_numpy()] = table_.column("n").to_numpy()
    share = _share(counts)
    member = (share >= common) & (share >= ratio * share.max(axis=0))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filter rows of the n-grams in the text, with the languages' bits."""
        out = np.zeros(1 << ROW_BITS, dtype=np.uint64)
        bits = (member_b.value * (np.uint64(1) << np.arange(len(languages), dtype=np.uint64))[:, None]).sum(axis=0, dtype=np.uint64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(1)):
                grams = np.unique(_grams(data, offsets)[0])
                own = bits[(grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                grams, own = grams[own > 0], own[own > 0]
                for i in range(PROBES):
                    np.bitwise_or.at(out, ((grams >> np.uint64(ROW_BITS * i)) & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64), own)
        have = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(out[have].astype(np.int64))], names=["row", "bits"])

    member_b = labelled.sparkSession.sparkContext.broadcast(member)
    filters = np.zeros(1 << ROW_BITS, dtype=np.uint64)
    got = map_batches(rows, grams_of, "row long, bits long").groupBy("row").agg(F.bit_or("bits").alias("bits")).toArrow()
    filters[got.column("row").to_numpy()] = got.column("bits").to_numpy().astype(np.uint64)
    fill = np.array([((filters >> np.uint64(k)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filters(filters, languages, np.minimum(0.9, fill**PROBES), int(np.argmax([r["count"] for r in seen])))


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def identify(df: DataFrame, filters: Filters, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score; `und` and 0 for null texts and texts without a letter."""
    model = df.sparkSession.sparkContext.broadcast(filters)
    names = (*filters.languages, "und")
    ascii_letter = np.zeros(256, dtype=bool)
    ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                if filters_empty:
                    best, score = np.full(b - a, len(names) - 1), np.zeros(b - a)
                else:
                    best, score = model.value.decide(data, offsets)
                letters = np.concatenate(([0], np.cumsum(ascii_letter[data])))
                bare = np.flatnonzero(letters[offsets[1:]] == letters[offsets[:-1]])
                for i in bare.tolist():
                    if not has_letter(data[offsets[i] : offsets[i + 1]].tobytes()):
                        best[i], score[i] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    filters_empty = not filters.languages
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return map_batches(source, run, schema)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = bounded_ids(docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull()), "doc_id", TRAIN_DOCS)
    out = identify(docs, train(learn))
    return out.select("doc_id", (F.coalesce(remainder("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score")
