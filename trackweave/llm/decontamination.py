"""Benchmark decontamination with a distributed positional inverted index.

1. The test items' windows become *phrases* with their words, terms (word hashes) and items, in tasks.
2. The terms are counted over the whole corpus, and each phrase's rarest ones are chosen.
3. The index is a stored table of postings (term, text, positions) of the chosen terms over all training texts.  A text is
   known by a 128-bit key of its bytes, so rows that repeat, or have no id, share postings and answers.
4. A phrase's starts in a text are the offset-adjusted positions that all its chosen terms agree on.  The words at each
   start are compared with the phrase's, so the matches are exact; they give the hit words and the items.

Nothing that grows with the corpus or the test set is at the driver: of terms and keys only a bit map of a fixed size, which
thins out what tasks send; a wrong bit sends more, and the joins that follow drop it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table, written
from .textops import LOWER, NOT_ALNUM, Words, chunks, split_words

#: Bits of a map of terms or keys; its size doesn't depend on the input.
MAP_BITS = 24
#: Distinct terms that a task counts before it sends them on.
COUNTED = 1 << 20
#: Results are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return split_words(LOWER[data], offsets, NOT_ALNUM)


def _key(raw: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash."""
    digest = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _keys(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int] | tuple[None, None]]:
    """The keys of the texts; none for null."""
    raw = data.tobytes()
    return [_key(raw[a:b]) if known else (None, None) for a, b, known in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def phrases(items: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = 13) -> DataFrame:
    """(p1, p2, words, terms, items): the distinct windows of ``width`` words of the items, an item of fewer words being one.

    p1, p2 is a key of the words, ``words`` has them joined by a space, ``terms`` their hashes, ``items`` the ids of all items that
    have the window (null ids left out).  Null texts and texts without words have no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                words = _words(data, offsets)
                hashes, raw = words.hashes().view(np.int64), words.data.tobytes()
                for i in range(b - a):
                    at, end = int(words.bounds[i]), int(words.bounds[i + 1])
                    n = min(end - at, width)
                    own = [raw[x:y] for x, y in zip(words.start[at:end].tolist(), words.end[at:end].tolist(), strict=True)]
                    for s in range(0, end - at - n + 1 if n else 0, 4096):
                        firsts = range(s, min(s + 4096, end - at - n + 1))
                        joined = [b" ".join(own[f : f + n]) for f in firsts]
                        keys = [_key(j) for j in joined]
                        terms = hashes[(at + np.array(firsts))[:, None] + np.arange(n)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([k[0] for k in keys], pa.int64()),
                                pa.array([k[1] for k in keys], pa.int64()),
                                pa.array([j.decode() for j in joined], pa.string()),
                                pa.ListArray.from_arrays(pa.array(np.arange(0, terms.size + 1, n), pa.int32()), pa.array(terms.ravel())),
                                pa.array([batch.column(0)[a + i].as_py()] * len(keys), pa.string()),
                            ],
                            names=["p1", "p2", "words", "terms", "item"],
                        )

    source = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    windows = map_batches(source, run, "p1 long, p2 long, words string, terms array<long>, item string")
    return windows.groupBy("p1", "p2").agg(F.first("words").alias("words"), F.first("terms").alias("terms"), F.sort_array(F.collect_set("item")).alias("items"))


def bit_map(values: DataFrame, column: str) -> np.ndarray:
    """A map of ``MAP_BITS`` bits with those of the values' leading bits set; each task ORs its own words of 64 bits."""
    cell = F.shiftrightunsigned(column, 64 - MAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - MAP_BITS}) & 63 as int))")
    rows = values.where(F.col(column).isNotNull()).groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indices of the unsigned values whose bit is set."""
    cell = values >> np.uint64(64 - MAP_BITS)
    return np.flatnonzero((bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1))


def term_counts(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """(term, n): occurrences in the whole corpus of at least the terms in ``bits``; tasks count before the shuffle."""
    asked = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                hashes = _words(data, offsets).hashes()
                new, n = np.unique(hashes[marked(asked.value, hashes)], return_counts=True)
                terms, place = np.unique(np.concatenate((terms, new)), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate((counts, n)), minlength=len(terms)).astype(np.int64)
                if len(terms) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])
                    terms, counts = terms[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])

    return map_batches(docs.select(F.col(text).cast("string").alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def rarest(known: DataFrame, counts: DataFrame, lists: int = 2) -> DataFrame:
    """(p1, p2, rank, terms, offset, term): each phrase's ``lists`` rarest terms (all of a shorter one), ties by place; phrases with a
    term that the corpus lacks are left out."""
    spread = known.select("p1", "p2", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    own = spread.join(counts, "term").groupBy("p1", "p2", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("t"))
    own = own.where("size(t) = size").withColumn("t", F.slice("t", 1, lists)).withColumn("terms", F.size("t"))
    return own.select("p1", "p2", "terms", F.posexplode("t").alias("rank", "t")).select("p1", "p2", "rank", "terms", "t.offset", "t.term")


def build_index(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """Postings (term, k1, k2, positions) of at least the terms in ``bits`` over all texts; k1, k2 is the text's key."""
    asked = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(0)):
                words = _words(data, offsets)
                hashes = words.hashes()
                at = marked(asked.value, hashes)
                if not len(at):
                    continue
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                order = np.lexsort((at, hashes[at], doc))
                at, doc = at[order], doc[order]
                term = hashes[at].view(np.int64)
                cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(term, prepend=~term[0]) != 0))
                keys = _keys(batch.column(0).slice(a, b - a), data, offsets)
                positions = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)), pa.int32()), pa.array((at - words.bounds[doc]).astype(np.int32)))
                own = [keys[d] for d in doc[cut].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(term[cut]), pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()), positions], names=["term", "k1", "k2", "positions"])

    return map_batches(docs.select(F.col(text).cast("string").alias("text")), run, "term long, k1 long, k2 long, positions array<int>")


def phrase_starts(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(p1, p2, k1, k2, start) where all chosen terms of a phrase (table of ``rarest``) stand at their offsets in a text.

    Texts that repeat give a start once for each, so the distinct ranks are counted; tasks drop repeats before the shuffle.
    """
    places = index.select("term", "k1", "k2", F.explode("positions").alias("position")).join(chosen, "term")
    places = places.select("p1", "p2", "k1", "k2", (F.col("position") - F.col("offset")).alias("start"), "rank", "terms").where("start >= 0")
    return places.groupBy("p1", "p2", "k1", "k2", "start").agg(F.countDistinct("rank").alias("n"), F.max("terms").alias("terms")).where("n = terms").select("p1", "p2", "k1", "k2", "start")


def proximity_matches(index: DataFrame, first: int, second: int, within: int) -> DataFrame:
    """(k1, k2, position, other): every place of term ``first`` in a text with a place of ``second`` at most ``within`` words away."""
    distinct = index.groupBy("term", "k1", "k2").agg(F.first("positions").alias("positions"))
    a = distinct.where(F.col("term") == first).select("k1", "k2", F.col("positions").alias("p"))
    b = distinct.where(F.col("term") == second).select("k1", "k2", F.col("positions").alias("q"))
    near = a.join(b, ["k1", "k2"]).select("k1", "k2", "q", F.explode("p").alias("position"))
    return near.select("k1", "k2", "position", F.explode(F.filter("q", lambda x: F.abs(x - F.col("position")) <= within)).alias("other"))


def _texts(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """(k1, k2, text) of at least the texts whose k1 is in ``bits``, each once."""
    asked = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(0)):
                column = batch.column(0).slice(a, b - a)
                keys = _keys(column, data, offsets)
                at = marked(asked.value, np.array([k[0] or 0 for k in keys], dtype=np.int64).view(np.uint64))
                at = at[[keys[i][0] is not None for i in at.tolist()]] if len(at) else at
                if len(at):
                    own = [keys[i] for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()), column.take(pa.array(at))], names=["k1", "k2", "text"])

    found = map_batches(docs.select(F.col(text).cast("string").alias("text")), run, "k1 long, k2 long, text string")
    return found.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def _confirmed(candidates: DataFrame) -> DataFrame:
    """(k1, k2, n_hit, items) of the texts with a start where the phrase's words stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, offsets = next(chunks(batch.column(2).slice(i, 1)))[2:]
                words = _words(data, offsets)
                raw, start, end = words.data.tobytes(), words.start.tolist(), words.end.tolist()
                hit, mine = np.zeros(len(start), dtype=bool), set()
                for found in batch.column(3)[i].as_py():
                    own, s = found["words"].encode().split(b" "), found["start"]
                    if s + len(own) <= len(start) and all(raw[x:y] == w for x, y, w in zip(start[s:], end[s:], own)):  # noqa: B905
                        hit[s : s + len(own)] = True
                        mine.update(found["items"])
                if hit.any():
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), int(hit.sum()), sorted(mine)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["k1", "k2", "n_hit", "items"])

    return map_batches(candidates.select("k1", "k2", "text", "found"), run, "k1 long, k2 long, n_hit long, items array<string>")


def matches(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, lists: int = 2) -> DataFrame:
    """(k1, k2, n_hit, items): for the key of every text that has a phrase, how many of its words are inside one, and the sorted ids of
    the items it comes from."""
    known = written(phrases(items, item_id=item_id, text=item_text, width=width), "phrases")
    counts = term_counts(docs, text, bit_map(known.select(F.explode("terms").alias("term")), "term"))
    chosen = written(rarest(known, counts, lists), "rarest")
    index = written(build_index(docs, text, bit_map(chosen, "term")), "postings")
    starts = phrase_starts(index, chosen).join(known.select("p1", "p2", "words", "items"), ["p1", "p2"])
    found = written(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "words", "items")).alias("found")), "starts")
    return written(_confirmed(_texts(docs, text, bit_map(found, "k1")).join(found, ["k1", "k2"])), "hits")


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, lists: int = 2, share: int = 20, keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted item ids with a window in it), contaminated; with
    ``keep`` also the text and these columns.

    Words are runs of ASCII letters and digits and of everything outside ASCII, lower-cased (A-Z).  A window is ``width``
    words of an item, or the whole item if shorter; a document's word inside an occurrence of a window is hit;
    contaminated: n_hit > 0 and share * n_hit >= n_words.  Null and wordless texts have no words and no hits; items
    without words match nothing; null item ids are left out of ``items``; items that repeat count once; rows that repeat a
    doc_id, or have none, are judged one by one; empty tables give empty or clean results; texts of any length are
    judged whole.  Columns of ``keep`` with the names of new ones aren't allowed.
    """
    kept = [] if keep is None else ["text", *keep]
    hits = matches(docs, items, text=text, item_id=item_id, item_text=item_text, width=width, lists=lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                counts = split_words(data, offsets, NOT_ALNUM).counts
                keys = _keys(batch.column(1).slice(a, b - a), data, offsets)
                own = [batch.column(i).slice(a, b - a) for i in (0, *range(1 if kept else 2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["doc_id", *kept, "n_words", "__k1", "__k2"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(keep or ()))
    schema = source.select("doc_id", *kept).schema
    for name in ("n_words", "__k1", "__k2"):
        schema = schema.add(name, T.LongType())
    size = hits.agg(F.coalesce(F.sum(F.expr("40 + aggregate(items, 0L, (a, i) -> a + length(i) + 8)")), F.lit(0)).alias("n")).first().n
    hits = hits.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "n_hit", "items")
    out = map_batches(source, run, schema).join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, ["__k1", "__k2"], "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select("doc_id", *kept, "n_words", "n_hit", "items", "contaminated")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
sized as (select item_id, ws, least(len(ws), 13) as k from b where len(ws) > 0),
wins as (
  select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as w
  from (select *, unnest(range(1, len(ws) - k + 2)) as i from sized)),
sizes as (select distinct k from wins),
places as (select doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) as p from d, sizes where len(ws) >= k),
spots as (
  select p.doc_id, p.p, p.k, w.item_id
  from (select doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') as w from places) p join wins w on p.k = w.k and p.w = w.w),
hits as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + k)) as x from spots) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list
  from (select distinct doc_id, cast(item_id as varchar) as item_id from spots) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(list, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""
