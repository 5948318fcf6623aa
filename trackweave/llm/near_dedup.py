"""Near-duplicate groups by b-bit MinHash.

Documents with the same shingle set form a class, known by a number; everything after works on classes.  Of each minimum
only ``BITS`` low bits are kept, packed; bands of four whole minima give candidate buckets.

1. In each bucket every member is paired with the bucket's hub, the member with the smallest hash of its id.  Pairs whose
   estimate (equal packed values, corrected for chance collisions) isn't far below the threshold make *families*, the
   connected parts of the likely pairs; the likely pairs are confirmed on full sets and give components.
2. A bucket that holds several families is searched for likely pairs between them, in blocks, on packed signatures.
3. A family that holds several components is searched for links between them, in blocks, on full sets: its members outside
   the largest component against all its members.  Only links that connect something leave a task.

So no likely pair of a bucket is skipped unless its documents are already connected, and nothing is emitted for pairs.

The chance to miss a pair at the threshold in every band is (1 - t**4)**24, 2e-8 at 0.85 and 3e-6 at 0.8; that of a wrong
drop by the estimate is below 1e-5 (``MARGIN`` is over four standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .textops import LOWER, chunks, mix64, shingle_sets, split_words

MINIMA, BANDS, ROWS, BITS = 128, 24, 4, 4
MARGIN = 0.15
#: Members of a block, of either side, at most on average.
BLOCK = 1024

_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(1, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    words = split_words(LOWER[data], offsets)
    return shingle_sets(words.hashes(), words.bounds, width)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``MINIMA`` minima for each nonempty set; whole rows of 2**32 - 1 for empty ones."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), MINIMA), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x = np.concatenate([sets[i] for i in full])
    cut = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    buffer = np.empty_like(low)
    for i in range(MINIMA):
        np.multiply(low, _A[i], out=buffer)
        np.add(buffer, high, out=buffer)
        out[full, i] = np.minimum.reduceat(buffer, cut)
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of each minimum (after mixing), two to a byte."""
    low = (mix64(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def _bands(minima: np.ndarray) -> np.ndarray:
    m = minima[:, : BANDS * ROWS].astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    key = mix64(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]))
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.astype(np.int64)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed rows: share of equal values, corrected for the chance of equal low bits."""
    x = a ^ b
    equal = ((x & 0x0F) == 0).sum(axis=-1) + ((x & 0xF0) == 0).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit hash of each set."""
    digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    return (np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64), np.array([d & ((1 << 64) - 1) for d in digests], dtype=np.uint64).view(np.int64))


def signatures(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit hash, a hash of the text, the packed signature and the band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                sets = _sets(data, offsets, width)
                minima = _minima(sets)
                top, low = _digests(sets)
                bands = _bands(minima)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(top),
                        pa.array(low),
                        batch.column(2).slice(a, b - a),
                        pa.array([r.tobytes() for r in _packed(minima)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "t", "sig", "bands"],
                )

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    return map_batches(source, run, "doc_id long, n_shingles long, s1 long, s2 long, t long, sig binary, bands array<long>")


def _set_table(df: DataFrame, classes: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(rep, items): the full sets of the classes (rep, s1, s2, doc, t), made again from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                sets = _sets(data, offsets, width)
                top, low = _digests(sets)
                yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(low), pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "items"])

    source = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    wanted = classes.select(F.col("doc").alias("__doc"), F.col("t").alias("__t"))
    need = source.join(wanted, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("t") == F.col("__t")), "left_semi").select("text")
    made = map_batches(need, run, "s1 long, s2 long, items binary").join(classes.select("rep", "s1", "s2"), ["s1", "s2"])
    return made.groupBy("rep").agg(F.first("items").alias("items"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    return map_batches(pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): the smallest node reachable.  Neighbours' smallest labels and
    pointer jumping; each round is a table in the shared folder."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        new = written(new.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("comp"), "was"), "labels")
        if not new.where("comp < was").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _blocks(member: DataFrame, group: str) -> DataFrame | None:
    """The rows of groups with several values of ``comp`` and more than two members, dealt into blocks.

    Members outside the group's largest component (side 0) meet all members (side 1) in blocks of bounded size.  None if
    there is no such group.
    """
    parts = member.groupBy(group, "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy(group).agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1 and n > 2")
    mixed = written(mixed.select(group, "n", (F.col("n") - F.col("top.n")).alias("out"), F.col("top.comp").alias("top")), "mixed")
    if not mixed.limit(1).count():
        return None
    rows = member.join(mixed, group).withColumns({"lbs": F.ceil(F.col("out") / BLOCK), "rbs": F.ceil(F.col("n") / BLOCK), "h": F.xxhash64("rep")})
    zero = F.lit(0).cast("long")
    right = rows.select(F.col(group).alias("group"), F.explode(F.sequence(zero, F.col("lbs") - 1)).alias("lb"), F.pmod("h", "rbs").alias("rb"), "rep", "comp", F.lit(1).alias("side"))
    left = rows.where("comp != top").select(F.col(group).alias("group"), F.pmod("h", "lbs").alias("lb"), F.explode(F.sequence(zero, F.col("rbs") - 1)).alias("rb"), "rep", "comp", F.lit(0).alias("side"))
    return left.unionByName(right)


def _connecting(blocks: DataFrame, cut: float, percent: int | None) -> DataFrame:
    """Pairs (a, b) that connect components: with an estimate of ``cut`` or more and, if ``percent`` is given (column items:
    full sets), enough in common.  A block emits fewer pairs than it has components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        found: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        if len(left) and len(right):
            r_sig = np.frombuffer(b"".join(right.sig), dtype=np.uint8).reshape(len(right), -1)
            r_id, r_comp = right.rep.to_numpy(), right.comp.to_numpy()
            if percent is not None:
                both = [np.frombuffer(x, dtype=np.uint64) for x in [*left["items"], *right["items"]]]
                sizes = np.array([len(x) for x in both])
                distinct, code = np.unique(np.concatenate(both), return_inverse=True)
                codes = np.split(code, np.cumsum(sizes)[:-1])
                mark = np.zeros(len(distinct), dtype=bool)
            for i, (rep, comp, sig) in enumerate(zip(left.rep.tolist(), left.comp.tolist(), left.sig, strict=True)):
                hit = np.flatnonzero((_estimate(r_sig, np.frombuffer(sig, dtype=np.uint8)) >= cut) & (r_comp != comp))
                if percent is not None and len(hit):
                    own = sizes[len(left) + hit]
                    fit = 100 * np.minimum(own, sizes[i]) >= percent * np.maximum(own, sizes[i])
                    hit, own = hit[fit], own[fit]
                    if len(hit):
                        mark[codes[i]] = True
                        common = np.add.reduceat(mark[np.concatenate([codes[len(left) + j] for j in hit])].astype(np.int64), np.concatenate(([0], np.cumsum(own)[:-1])))
                        mark[codes[i]] = False
                        hit = hit[100 * common >= percent * (own + sizes[i] - common)]
                for j in hit.tolist():
                    x, y = root(comp), root(int(r_comp[j]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        found.append((min(rep, int(r_id[j])), max(rep, int(r_id[j]))))
        return pd.DataFrame({"a": np.array([f[0] for f in found], dtype=np.int64), "b": np.array([f[1] for f in found], dtype=np.int64)})

    return blocks.groupBy("group", "lb", "rb").applyInPandas(run, "a long, b long")


def _labelled(frame: DataFrame, comps: DataFrame) -> DataFrame:
    """``frame`` (column rep) with its component; a document without links is its own."""
    return frame.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z); words are runs of anything but space and 0x09-0x0D; a set has the distinct shingles of
    ``width`` words, or the whole sequence of fewer words.  Documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest reachable doc_id; kept marks that document.  Null and empty texts have
    n_shingles 0 and link with nothing.  Rows that repeat a doc_id count as one document with all their texts: each keeps
    its links, and their groups are one.  A row without an id links like any other and isn't kept; a group of such rows
    alone has a null component_id.  Ties can't arise (the smallest id wins), texts of any length are taken whole, other columns
    aren't read, and an empty table gives an empty result.
    """
    sigs = written(signatures(df, doc_id, text, width), "signatures")
    last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "t")
    classes = sigs.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(last).alias("m"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "m.doc", "m.t", "sig", "bands"), "classes")
    buckets = classes.select(F.explode("bands").alias("band"), "rep")
    hubs = buckets.groupBy("band").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = buckets.join(hubs.select("band", F.col("hub.rep").alias("hub")), "band").where("rep != hub")
    pairs = pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    sig = classes.select("rep", "sig")
    cut = percent / 100 - MARGIN

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_estimate(x, y) >= cut)], names=["a", "b", "likely"])

    pairs = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    pairs = map_batches(pairs.select("a", "b", "x", "y"), likely, "a long, b long, likely boolean").where("likely")
    pairs = written(pairs.select("a", "b"), "pairs")
    near = pairs
    while True:
        families = components(near)
        blocks = _blocks(_labelled(buckets, families), "band")
        if blocks is None:
            break
        found = written(_connecting(blocks.join(sig, "rep"), cut, None).distinct(), "found")
        if not found.limit(1).count():
            break
        near = written(near.unionByName(found), "pairs")
    wanted = classes.select("rep", "s1", "s2", "doc", "t").join(families.select(F.col("node").alias("rep")), "rep", "left_semi")
    sets = written(_set_table(df, wanted, doc_id, text, width), "sets")
    edges = written(_confirmed(near, sets, percent).unionByName(_same_id(sigs, classes)), "links")
    comps = components(edges)
    member = _labelled(families.select(F.col("node").alias("rep"), F.col("comp").alias("family")), comps)
    blocks = _blocks(member, "family")
    if blocks is not None:
        links = written(_connecting(blocks.join(sig, "rep").join(sets, "rep"), cut, percent).distinct(), "links")
        comps = components(edges.unionByName(links))
    named = written(_labelled(classes.select("rep", "s1", "s2", "doc"), comps), "named")
    smallest = named.groupBy("comp").agg(F.min("doc").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "s1", "s2").join(named.join(smallest, "comp").select("s1", "s2", "component"), ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _same_id(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of rows that share a doc_id, each with the first of them."""
    key = F.struct("s1", "s2")
    many = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high").select("doc_id", "low")
    own = sigs.where("n_shingles > 0").select("doc_id", "s1", "s2").join(many, "doc_id").select(F.col("low.s1").alias("x1"), F.col("low.s2").alias("x2"), "s1", "s2").distinct()
    first, second = (classes.select(F.col("rep").alias(n), F.col("s1").alias(u), F.col("s2").alias(v)) for n, u, v in (("a", "x1", "x2"), ("b", "s1", "s2")))
    return own.join(first, ["x1", "x2"]).join(second, ["s1", "s2"]).select("a", "b").where("a != b")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP5_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as s from words),
items as (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b
  where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from sets union select e.b, r from reach join edges e on e.a = reach.doc_id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r) as component_id, s.doc_id = min(r) as kept
from sets s join reach using (doc_id) group by s.doc_id, len(s.s)
"""
