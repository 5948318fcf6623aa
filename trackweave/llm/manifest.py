"""A Merkle manifest of a dataset: digests of rows, trees by group, and proofs that tie each row to one root.

Trees are built bottom-up, one stored table a level; a node keeps the places and digests of its run of children.  Proofs go top-down:
every level joins its nodes to their parents, and each child puts its siblings before the proof that its parent handed down.  Leaves
get their places from even ranges of the order, so a group of any size spreads over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT = 8
_STEP = "struct<place:int,siblings:array<string>>"


def encoded(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value, so that no two rows of values read alike."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        left = F.array_join(F.slice(step["siblings"], 1, step["place"]), "")
        right = F.array_join(F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"]) - step["place"]), "")
        return F.sha2(F.concat(left, digest, right), 256)

    return F.aggregate(proof, start, up)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 in each ``group``, by ``order``, equal rows in any fixed order) and ``size`` of the group.

    The rows are dealt by ranges of (group, order, row), sorted and stored with running numbers; a group's place in a range is its
    count in the ranges before.
    """
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    by = ["group", *order, "row"]
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy("group", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("group").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size"))
    joined = ranged.join(starts, F.col("group").eqNullSafe(F.col("g")) & (part == F.col("p")))
    return joined.withColumn("place", F.col("at") + F.col("shift")).drop("g", "p", "shift", "at", "row")


@dataclass(frozen=True)
class Tree:
    """``leaves`` (group, place, size, digest, payload), stored ``levels`` of (group, place, size, digest, children), where children
    are (place, digest, payload), and ``roots`` (group, digest)."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def build(rows: DataFrame, order: list[str]) -> Tree:
    """Trees of ``rows`` (group, digest, payload and the columns of ``order``).  While a group has several nodes, each run of
    ``FANOUT`` consecutive ones, the last possibly shorter, becomes the digest of their digests; a lone leaf is its group's root."""
    leaves = written(_placed(rows, order).select("group", "place", "size", "digest", "payload"), "placed")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels, below = [], leaves
    while largest > 1:
        child = F.struct("place", "digest", *(["payload"] if below is leaves else []))
        runs = below.where("size > 1").groupBy("group", F.floor(F.col("place") / FANOUT).alias("place"))
        runs = runs.agg(F.array_sort(F.collect_list(child)).alias("children"), F.ceil(F.max("size") / FANOUT).alias("size"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        below = written(runs.select("group", "place", "size", digest.alias("digest"), "children"), "level")
        levels.append(below)
        largest = -(-largest // FANOUT)
    tops = [level.where("size = 1").select("group", "digest") for level in [leaves, *levels]]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    return Tree(leaves, levels, written(roots, "roots"))


def pushed(tree: Tree, tops: DataFrame) -> DataFrame:
    """(digest, payload, proof, root, top) of every leaf.

    ``tops`` has for each group the proof that its root inherits, the last root and the group's own (``top``).  A proof's steps go
    from the leaf up: the place in the run and the siblings' digests, left to right.
    """
    handed = ["proof", "root", "top"]
    above = tops.select(F.col("group").alias("g"), *handed)

    def started(nodes: DataFrame, *columns: str) -> DataFrame:
        return nodes.where("size = 1").join(above, F.col("group").eqNullSafe(F.col("g"))).select(*columns, *handed)

    held = None
    for k in range(len(tree.levels) - 1, -1, -1):
        nodes = started(tree.levels[k], "group", "children")
        if held is not None:
            parents = held.select(F.col("group").alias("g"), F.col("child.place").alias("p"), *handed)
            joined = tree.levels[k].join(parents, F.col("group").eqNullSafe(F.col("g")) & (F.col("place") == F.col("p")))
            nodes = nodes.unionByName(joined.select("group", "children", *handed))
        digests = F.transform("children", lambda c: c["digest"])
        step = F.struct(F.col("pos").alias("place"), F.concat(F.slice("digests", 1, F.col("pos")), F.slice("digests", F.col("pos") + 2, F.lit(FANOUT))).alias("siblings")).cast(_STEP)
        held = nodes.select("group", digests.alias("digests"), *handed, F.posexplode("children").alias("pos", "child"))
        held = held.select("group", "child", F.concat(F.array(step), "proof").alias("proof"), "root", "top")
    lone = started(tree.leaves, "digest", "payload")
    if held is None:
        return lone
    return held.select("child.digest", "child.payload", *handed).unionByName(lone)


def proved(df: DataFrame, digest: Column, *, group: str = "lang", order: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with leaf, subroot, root and proof: array<struct<place, siblings>>, from the leaf via its group's root to the
    root of all.

    ``digest`` is the leaf's.  In a group leaves ascend by ``order`` (nulls first), equal ones by their digest; the groups' roots
    ascend by group, null first, bytewise, and are joined like leaves.  Nulls are values of their own in any column; rows that repeat
    are leaves of their own with equal digests and places in any order; texts of any length are read whole; an empty table gives an
    empty result.  Columns of ``keep`` may have any name but leaf, subroot, root and proof.
    """
    if clash := set(keep) & {"leaf", "subroot", "root", "proof"}:
        raise ValueError(f"columns of keep have names of new ones: {sorted(clash)}")
    kept = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))) if keep else F.struct(F.lit(0).alias("k"))
    by = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.col(group).alias("group"), *(F.col(c).alias(o) for c, o in zip(order, by, strict=True)), digest.alias("digest"), kept.alias("payload"))
    tree = build(rows, [*by, "digest"])
    upper = build(tree.roots.select(F.lit(0).alias("group"), F.col("group").alias("o0"), "digest", F.struct("group").alias("payload")), ["o0"])
    top = upper.roots.select("group", F.array().cast(f"array<{_STEP}>").alias("proof"), F.col("digest").alias("root"), F.col("digest").alias("top"))
    tops = written(pushed(upper, top).select("payload.group", "proof", "root", F.col("digest").alias("top")), "tops")
    out = pushed(tree, tops)
    return out.select(*(F.col(f"payload.k{i}").alias(c) for i, c in enumerate(keep)), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "proof")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document by crc32 of its id is tampered with: its text's A-Z are lower-cased."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = [F.col(c) for c in docs.columns]
    upper = "".join(map(chr, range(65, 91)))
    changed = leaf_digest(*columns[:-1], F.translate("text", upper, upper.lower()))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = proved(docs.withColumn("now", F.when(hit, changed)), leaf_digest(*columns), keep=("doc_id", "now"))
    out = out.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels by recursion; a tampered leaf folds up through the runs' lists of digests.
OP11_SQL = """
with recursive crc as (
  select *, case when doc_id is not null then (list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end))) end as h
  from documents),
leaves as (
  select row_number() over () as r, doc_id, coalesce(lang, '') as lang, lang is not null as known, h is not null and xor(h, 4294967295::bigint) % 3 = 0 as hit,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head, text
  from crc),
hashed as (
  select r, doc_id, known, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when hit then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as now
  from leaves),
placed as (
  select *, row_number() over (partition by known, lang order by doc_id nulls first, leaf, r) - 1 as place, count(*) over (partition by known, lang) as size from hashed),
nodes as (
  select 0 as level, known, lang, place, size, leaf as digest from placed
  union all
  select level + 1, known, lang, place // 8, (max(size) + 7) // 8, sha256(string_agg(digest, '' order by place)) from nodes where size > 1 group by level, known, lang, place // 8),
subroots as (
  select known, lang, digest, row_number() over (order by known, encode(lang)) - 1 as place, count(*) over () as size from nodes where size = 1),
tops as (
  select 0 as level, place, size, digest from subroots
  union all
  select level + 1, place // 8, (max(size) + 7) // 8, sha256(string_agg(digest, '' order by place)) from tops where size > 1 group by level, place // 8),
runs as (select level, known, lang, place // 8 as place, list(digest order by place) as digests from nodes where size > 1 group by level, known, lang, place // 8),
upper_runs as (select level, place // 8 as place, list(digest order by place) as digests from tops where size > 1 group by level, place // 8),
climb as (
  select 0 as level, r, known, lang, place, coalesce(now, leaf) as digest, '' as proof from placed
  union all
  select c.level + 1, c.r, c.known, c.lang, c.place // 8,
    sha256(array_to_string(u.digests[1:c.place % 8] || [c.digest] || u.digests[c.place % 8 + 2:], '')),
    c.proof || array_to_string(u.digests[1:c.place % 8] || u.digests[c.place % 8 + 2:], '')
  from climb c join runs u on u.level = c.level and u.known = c.known and u.lang = c.lang and u.place = c.place // 8),
arrived as (
  select c.r, s.digest as subroot, s.place, c.digest, c.proof from climb c join subroots s on s.known = c.known and s.lang = c.lang
  where c.level = (select max(level) from nodes n where n.known = c.known and n.lang = c.lang)),
upper_climb as (
  select 0 as level, r, place, digest, proof from arrived
  union all
  select c.level + 1, c.r, c.place // 8, sha256(array_to_string(u.digests[1:c.place % 8] || [c.digest] || u.digests[c.place % 8 + 2:], '')),
    c.proof || array_to_string(u.digests[1:c.place % 8] || u.digests[c.place % 8 + 2:], '')
  from upper_climb c join upper_runs u on u.level = c.level and u.place = c.place // 8)
select p.doc_id, p.leaf, a.subroot, t.digest as root, sha256(c.proof) as proof_sha256, c.digest as folded_root, c.digest = t.digest as verified
from placed p join arrived a on a.r = p.r join upper_climb c on c.r = p.r and c.level = (select max(level) from tops) cross join tops t where t.size = 1
"""
