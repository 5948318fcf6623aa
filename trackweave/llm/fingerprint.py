"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``K`` smallest of the distinct 48-bit shingle hashes.  Sketches of parts merge to the
sketch of the union; two sketches estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table
from .textops import LOWER, chunks, shingle_sets, split_words

K, WIDTH, BITS = 128, 5, 48
#: Text of a range of documents, and ranges at most: their cut points and first ids are at the driver.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000


def sketches(texts: pa.Array, width: int = WIDTH, k: int = K) -> list[np.ndarray]:
    """Sorted sketches of whole texts: lower-cased (A-Z) words between white space, shingles of ``width`` words; fewer
    words are one shingle; null and wordless texts have an empty sketch."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in chunks(texts):
        words = split_words(LOWER[data], offsets)
        for s in shingle_sets(words.hashes(), words.bounds, width):
            s = s[: k + 16] >> np.uint64(64 - BITS)
            out.append(s[:k] if len(s) < 2 or (s[1:] != s[:-1]).all() else np.unique(s)[:k])
    return out


def with_sketch(df: DataFrame, *, text: str = "text", out: str = "sketch", width: int = WIDTH, k: int = K) -> DataFrame:
    """``df`` with a column of sketches (array<long>)."""

    @F.pandas_udf("array<long>")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([s.astype(np.int64) for s in sketches(pa.array(texts, pa.string()), width, k)])

    return df.withColumn(out, sketch(F.col(text).cast("string")))


def merged(df: DataFrame, keys: list[str], *, sketch: str = "sketch", k: int = K) -> DataFrame:
    """Sketches of the unions by ``keys``.  Each task keeps k values of a key at most before the shuffle."""
    values = df.select(*keys, F.explode(sketch).alias("value")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("value"))
    return values.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketch columns; 1 for two empty ones."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    inter = resemblance(a, b, k) * distinct_count(F.slice(F.sort_array(F.array_union(a, b)), 1, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / distinct_count(a, k)))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.element_at(sketch, k))


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    same = both[1:] == both[:-1]
    union = np.concatenate((both[:1], both[1:][~same]))
    limit = union[min(k, len(union)) - 1]
    return float((both[1:][same] <= limit).sum() / min(k, len(union)))


def text_of(sketch: np.ndarray) -> str:
    """Twelve hex digits a value."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(df: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """Rows dealt into ranges of doc_id, sorted in each partition by (range, tail, id, text).

    Every range also gets, as a row with ``tail``, the first row of the next range (the last range that of the first), so
    a document's successor stands right behind it without a global window.  Only cut points and first ids, one for each
    range, are at the driver.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(np.array(cuts, dtype=np.int64), ids.fillna(0).astype(np.int64), side="right")))

    ranged = docs.withColumn("range", range_of("doc_id"))
    firsts = sorted((r.range, r.first) for r in docs.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return ranged.withColumn("tail", F.lit(False))
    behind = [(firsts[(i + 1) % len(firsts)][1], own[0]) for i, own in enumerate(firsts)]
    starts = df.sparkSession.createDataFrame(behind, "first long, range long")
    tails = docs.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "range", F.lit(True).alias("tail"))
    rows = ranged.withColumn("tail", F.lit(False)).unionByName(tails)
    return rows.repartitionById(parts, F.pmod(F.col("range") + 1, F.lit(parts)).cast("int")).sortWithinPartitions("range", "tail", "doc_id", "text")


def ranges_for(df: DataFrame, text: str) -> int:
    """How many ranges the texts are dealt into: by their size, so a task's share doesn't grow with the input, one a core at least."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("n")).first().n
    return int(min(MOST_RANGES, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))))


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its tail from the next document by ascending doc_id (nulls first, repeated ids by text; the
    last row's is the first).  Null texts count as empty; two empty sketches are alike (1), an empty one and another aren't
    (0); a single row is its own successor.  Texts of any length are read whole, an empty table gives an empty result, and other
    columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
            changed = [edited(r[1], f[1]) for r, f in zip(rows, following, strict=True)]
            first = [r[3] for r in rows]
            second = sketches(pa.array(changed, pa.string()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                    pa.array([text_of(s) for s in first], pa.string()),
                    pa.array([text_of(s) for s in second], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(first, second, strict=True)], pa.float64()),
                    pa.array([likeness(a, f[3]) for a, f in zip(first, following, strict=True)], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        closed = None
        for batch in batches:
            texts = batch.column(1)
            rows = [(i, t, (r, tail), s) for i, t, r, tail, s in zip(batch.column(0).to_pylist(), texts.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), sketches(texts), strict=True)]
            done: list[tuple] = []
            after: list[tuple] = []
            for row in rows:
                if row[2][0] == closed:
                    continue
                if held:
                    done.append(held.pop())
                    after.append(row)
                if row[2][1]:
                    closed = row[2][0]
                else:
                    held.append(row)
            if done:
                yield out(done, after)

    rows = with_next(df, doc_id, text, ranges_for(df, text)).select("doc_id", "text", "range", "tail")
    return map_batches(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
