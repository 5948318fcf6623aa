"""Removal of repeated passages with a count-min prefilter.

A window is ``width`` consecutive words.  Its anchor is the smallest hash among the shorter runs of words in it, so two
equal windows have equal anchors, and at different places their anchors stand at different places: the number of places
of an anchor is never less than the number of windows with the same words.  Anchors change only every tenth word or so,
which makes the sketches small.

1. Documents are gathered into chunks of some megabytes, written once to the shared folder.
2. Each task adds the anchors' places of its chunks to a count-min sketch; the sketches are merged block by block.  Only
   whether a cell has two or more is kept, one bit a cell.  Its cells grow with the words; up to ``max_cells`` the sketch
   is broadcast, beyond it stays in its blocks: each chunk sends its anchors' cells there and gets a bit back for each.
3. Windows estimated repeated are sent to buckets by hash: each chunk sends a window's 128-bit hash once, with a mark if
   the chunk itself has it twice, so a passage in a third of all documents costs a bucket one entry a chunk.
4. Buckets answer one bit for each entry; each chunk then marks the covered words and writes its documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .textops import Words, mix64, split_words, text_buffer, window_hashes

BLOCK_BITS = 16
#: Answers are broadcast to the chunks up to this size; beyond it chunks and answers are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Cells of a block that stays where it was merged, at most (2 to this number).
STAY_BITS = 22
ANSWERS = "array<struct<bucket: bigint, again: binary>>"
QUESTION_SCHEMA = "bucket long, chunk long, keys binary, twice binary"
CHUNK_SCHEMA = "chunk long, words long, ids array<long>, texts array<string>"


def _chunked(df: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """Whole documents gathered into rows of about ``chunk_bytes`` of text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, number
            i, t = pa.concat_arrays(ids), pa.concat_arrays(texts)
            words = 0
            for a in range(0, len(t), 256):
                data, offsets = text_buffer(t.slice(a, 256))
                words += len(split_words(data, offsets).start)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + number]), pa.array([words]), pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), i), pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t)],
                names=["chunk", "words", "ids", "texts"],
            )
            ids, texts, size, number = [], [], 0, number + 1
            return out

        for batch in batches:
            col = batch.column(1)
            offsets = text_buffer(col)[1]
            at = 0
            while at < len(col):
                room = offsets[at] + max(1, chunk_bytes - size)
                end = max(at + 1, int(np.searchsorted(offsets, room, side="right")) - 1)
                ids.append(batch.column(0).slice(at, end - at))
                texts.append(col.slice(at, end - at))
                size += int(offsets[end] - offsets[at])
                at = end
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    return map_batches(df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), gather, CHUNK_SCHEMA)


def _chunk_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = text_buffer(texts)
    words = split_words(data, offsets)
    return words, words.hashes()


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values; the result has width - 1 values fewer."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _anchors(words: Words, hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash of each window by first word, whether a window starts there, and the hashes of all anchor places."""
    n = len(hashes)
    runs = width - gram + 1
    none = np.zeros(0, dtype=np.uint64)
    if n < width:
        return none, np.zeros(0, dtype=bool), none
    grams = window_hashes(hashes, np.array([0, n]), gram)[0]
    anchor = _sliding(grams, runs, np.minimum)
    counts = words.counts
    last = np.repeat(words.bounds[1:], counts) - width
    valid = np.arange(n) <= last
    valid = valid[: len(anchor)]
    # A place is an anchor's if some window over it has that place's hash as its smallest.
    seen = np.zeros(len(grams) + runs - 1, dtype=np.uint64)
    seen[runs - 1 : runs - 1 + len(anchor)] = np.where(valid, anchor, np.uint64(0))
    best = _sliding(seen, runs, np.maximum)
    return anchor, valid, grams[best == grams]


def _cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix64(anchor)
    mask = np.uint64((1 << bits) - 1)
    return (m & mask).astype(np.int64), ((m >> np.uint64(64 - bits)) & mask).astype(np.int64)


def _sketch(chunks: DataFrame, width: int, gram: int, bits: int) -> np.ndarray:
    """For both rows of the merged sketch, a bit for each cell that counts two or more."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for row in range(batch.num_rows):
                found.append(_anchors(*_pair(batch.column(0), row), width, gram)[2])
        anchors = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        for r, cell in enumerate(_cells(anchors, bits)):
            cell = np.sort(cell)
            # Only whether a cell has two matters, so a task sends two of each at most.
            cell = cell[np.append(np.ones(min(2, len(cell)), dtype=bool), cell[2:] != cell[:-2])]
            block = cell >> BLOCK_BITS
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            low = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            ends = np.append(cut[1:], len(cell))
            for a in range(0, len(cut), 4096):
                c, e = cut[a : a + 4096], ends[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array((r << 40) + block[c]), pa.array([low[x:y].tobytes() for x, y in zip(c, e, strict=True)], pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.setdefault(b, []).append(cells)
        for b, cells in blocks.items():
            counts = np.bincount(np.frombuffer(b"".join(cells), dtype=np.uint16), minlength=1 << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())], names=["block", "cells"])

    parts = map_batches(chunks.select("texts"), cells_of, "block long, cells binary").repartition(F.col("block"))
    out = np.zeros((2, (1 << bits) // 8), dtype=np.uint8)
    step = (1 << BLOCK_BITS) // 8
    for row in map_batches(parts, merge, "block long, cells binary").collect():
        r, b = row.block >> 40, row.block & ((1 << 40) - 1)
        out[r, b * step : (b + 1) * step] = np.frombuffer(bytes(row.cells), dtype=np.uint8)
    return out


def _pair(column: pa.Array, row: int) -> tuple[Words, np.ndarray]:
    return _chunk_words(column[row].values)


def _question(chunk: int, bucket: np.ndarray, keys: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """The keys of a chunk, which are in order of their buckets, as one row a bucket with a bit for those that it has twice."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(keys))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut]),
            pa.array(np.repeat(np.int64(chunk), len(cut))),
            pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
            pa.array([np.packbits(twice[a:b], bitorder="little").tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
        ],
        names=["bucket", "chunk", "keys", "twice"],
    )


def _answers(questions: DataFrame, kind: type, columns: int) -> DataFrame:
    """By chunk, for each bucket that has something to say: a bit for each key, set if all chunks together have it twice or more."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = None

        def settle() -> pa.RecordBatch:
            keys = np.concatenate([k for _, k, _ in rows])
            weight = np.concatenate([t for _, _, t in rows])
            order = np.lexsort(keys.T[::-1])
            k = keys[order]
            fresh = np.ones(len(k), dtype=bool)
            fresh[1:] = (k[1:] != k[:-1]).any(axis=1)
            group = np.cumsum(fresh) - 1
            again = np.empty(len(k), dtype=bool)
            again[order] = np.bincount(group, weights=weight[order])[group] >= 2
            cut = np.cumsum([0] + [len(x) for _, x, _ in rows])
            said = [(c, np.packbits(again[a:b], bitorder="little").tobytes()) for (c, _, _), a, b in zip(rows, cut[:-1], cut[1:], strict=True) if again[a:b].any()]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in said], pa.int64()), pa.array([now] * len(said), pa.int64()), pa.array([s for _, s in said], pa.binary())], names=["chunk", "bucket", "again"])

        for batch in batches:
            for b, c, keys, twice in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != now and rows:
                    yield settle()
                    rows = []
                now = b
                k = np.frombuffer(keys, dtype=kind).reshape(-1, columns)
                rows.append((c, k, 1 + np.unpackbits(np.frombuffer(twice, dtype=np.uint8), bitorder="little")[: len(k)]))
        if rows:
            yield settle()

    replies = map_batches(questions.repartition(F.col("bucket")).sortWithinPartitions("bucket"), answer, "chunk long, bucket long, again binary")
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "again")).alias("replies"))


def _told(bucket: np.ndarray, replies: list[dict] | None) -> np.ndarray:
    """The bits that answer the keys of a chunk, given the buckets of its keys in the order they were sent."""
    said = {r["bucket"]: r["again"] for r in replies or ()}
    out = np.zeros(len(bucket), dtype=np.uint8)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        if (bits := said.get(int(bucket[a]))) is not None:
            out[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")[: b - a]
    return out


def _looked_up(sketch: np.ndarray, bits: int, anchor: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether windows with these anchors are estimated repeated, from the whole sketch."""
    c0, c1 = _cells(anchor, bits)
    return (sketch[0][c0 >> 3] >> (c0 & 7).astype(np.uint8)) & (sketch[1][c1 >> 3] >> (c1 & 7).astype(np.uint8)) & 1


def _stay(bits: int) -> int:
    """Bits of a cell's place in its block: 64 blocks at least."""
    return min(STAY_BITS, bits - 6)


def _own_cells(places: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of the sketch: the order of a chunk's distinct anchors by cell, their blocks and their places in these."""
    for r, cell in enumerate(_cells(places, bits)):
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        yield order, (r << 40) + (cell >> _stay(bits)), (cell & ((1 << _stay(bits)) - 1)).astype(np.uint32)


def _asked(replies: list[dict] | None, bits: int, anchor: np.ndarray, places: np.ndarray) -> np.ndarray:
    """As ``_looked_up``, from the bits that the sketch's blocks sent to this chunk."""
    distinct = np.unique(places)
    found = np.ones(len(distinct), dtype=np.uint8)
    for order, block, _ in _own_cells(distinct, bits):
        found[order] &= _told(block, replies)
    return found[np.searchsorted(distinct, anchor)]


def _sketch_in_place(chunks: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """By chunk, the answers of the merged sketch's blocks to its anchors' cells."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                distinct, counts = np.unique(_anchors(*_pair(batch.column(1), row), width, gram)[2], return_counts=True)
                if len(distinct):
                    for order, block, cell in _own_cells(distinct, bits):
                        yield _question(batch.column(0)[row].as_py(), block, cell, counts[order] > 1)

    return _answers(map_batches(chunks.select("chunk", "texts"), send, QUESTION_SCHEMA), np.uint32, 1)


def _candidates(texts: pa.Array, estimate: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, gram: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; of windows estimated repeated: first words; their distinct hashes in order of (bucket, hash); the index of
    each window in these; and how often each occurs here."""
    words, hashes = _chunk_words(texts)
    anchor, valid, places = _anchors(words, hashes, width, gram)
    where = np.flatnonzero(valid)
    if len(where):
        where = where[estimate(anchor[where], places) == 1]
    if not len(where):
        return words, where, np.zeros((0, 2), dtype=np.uint64), where, where
    bounds = np.array([0, len(hashes)])
    one = window_hashes(hashes, bounds, width, 0)[0][where]
    two = window_hashes(hashes, bounds, width, 1)[0][where]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    fresh = np.ones(len(one), dtype=bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group = np.cumsum(fresh) - 1
    index = np.empty(len(order), dtype=np.int64)
    index[order] = group
    return words, where, np.column_stack((one[fresh], two[fresh])), index, np.bincount(group)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the first hash, so keys in hash order are in bucket order."""
    return ((keys[:, 0] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def remove_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 35, gram: int = 16, max_cells: int = 1 << 28, chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    Words are runs of anything but space and 0x09-0x0D.  A word goes if a window over it also starts anywhere else.  Null
    texts and texts without words give 0, 0 and an empty string; texts shorter than a window are kept; repeated rows count
    as other places, so both lose their windows.  A null doc_id stays null.  Kept words are joined by one space.  A document
    longer than a chunk is a chunk of its own, whole.  An empty table gives an empty result; other columns aren't read.
    A sketch of more than ``max_cells`` cells a row isn't broadcast, but asked where it is.
    """
    chunks = written(_chunked(df, doc_id, text, chunk_bytes), "chunks")
    total = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(1, total))))
    buckets = max(64, total >> 20)
    if 1 << bits <= max_cells:
        sketch = df.sparkSession.sparkContext.broadcast(_sketch(chunks, width, gram, bits))
        chunks = chunks.withColumn("known", F.lit(None).cast(ANSWERS))
    else:
        sketch = None
        known = _sketch_in_place(chunks, width, gram, bits).withColumnRenamed("replies", "known")
        chunks = written(chunks.join(known, "chunk", "left"), "chunks-known")

    def estimate(known: pa.Scalar) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return partial(_looked_up, sketch.value, bits) if sketch is not None else partial(_asked, known.as_py(), bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, _, keys, _, counts = _candidates(batch.column(1)[row].values, estimate(batch.column(2)[row]), width, gram)
                if len(keys):
                    yield _question(batch.column(0)[row].as_py(), _bucket(keys, buckets), keys, counts > 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, texts, replies = batch.column(0)[row].values, batch.column(1)[row].values, batch.column(2)[row].as_py()
                words, where, keys, index, _ = _candidates(texts, estimate(batch.column(3)[row]), width, gram)
                n = len(words.start)
                gone = np.zeros(n, dtype=bool)
                if len(keys):
                    again = _told(_bucket(keys, buckets), replies)
                    first = where[again[index] == 1]
                    step = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + width, -1)
                    gone = np.cumsum(step[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False), words.bounds[:-1]) * (words.counts > 0) if n else np.zeros(len(ids), dtype=np.int64)
                kept = _kept(words, gone)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    questions = map_batches(chunks.select("chunk", "texts", "known"), send, QUESTION_SCHEMA)
    replies = written(_answers(questions, np.uint64, 2), "replies")
    size = replies.agg(F.coalesce(F.sum(F.expr("aggregate(replies, 0L, (a, r) -> a + length(r.again) + 32)")), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_BYTES:
        replies = F.broadcast(replies)
    joined = chunks.drop("words").join(replies, "chunk", "left").select("ids", "texts", "replies", "known")
    return map_batches(joined, finish, "doc_id long, n_words long, n_removed long, kept_text string", rows=4)


def _kept(words: Words, gone: np.ndarray) -> list[str]:
    """Each document's kept words joined by one space."""
    keep = ~gone
    size = (words.end - words.start + 1) * keep
    ends = np.concatenate(([0], np.cumsum(size)))
    total = int(ends[-1])
    out = np.full(total, 0x20, dtype=np.uint8)
    start, length = words.start[keep], (words.end - words.start)[keep]
    to = ends[:-1][keep]
    source = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
    target = np.repeat(to - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
    out[target] = words.data[source]
    raw = out.tobytes()
    cut = ends[words.bounds]
    return [raw[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
starts as (
  select doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) as p, ws from words where len(ws) >= 35),
wins as (select doc_id, p, array_to_string(ws[p:p + 34], ' ') as w from starts),
again as (select w from wins group by w having count(*) >= 2),
cover as (
  select distinct doc_id, p + o as i from wins join again using (w), (select unnest(range(0, 35)) as o)),
listed as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as x from words),
kept as (
  select l.doc_id, string_agg(x, ' ' order by l.i) as kept, count(*) as n
  from listed l left join cover c on l.doc_id = c.doc_id and l.i = c.i where c.i is null group by l.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from words w left join kept k using (doc_id)
"""
