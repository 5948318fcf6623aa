"""URL filters by cascades of Bloom filters, in DataFrame functions only.

A cascade answers "is this key listed?" exactly for every key of a known universe, without a join: level 0 encodes the
listed keys, level 1 the keys of the universe that level 0 takes by mistake, level 2 the listed keys that level 1 takes
by mistake, and so on until a level makes no mistake.  The levels a key passes alternate between "listed" and "not".

A level is an array of 64-bit words, made in a task and stored; a cascade is one row of such arrays, broadcast to the keys
that are tested.  A row has ``ROUND_BITS`` bits or so: a longer list is dealt by hash into several cascades, and the keys are
tested in as many rounds, each with its own row.  So lists of any length get the same answers, and nothing of them is at
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORD = 64
#: Bits of a round's first level; the others are smaller together.
ROUND_BITS = 1 << 28


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    probes: int


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the universe it was built over; without levels nothing is listed.  ``words`` is one row with an array for
    each level, named by ``name`` and the level's number."""

    name: str
    levels: tuple[Level, ...] = ()
    words: DataFrame | None = None

    def beside(self, df: DataFrame) -> DataFrame:
        """``df`` with the filters' words as columns, for ``test``."""
        return df if self.words is None else df.crossJoin(F.broadcast(self.words))

    def test(self, key: Column) -> Column:
        """Whether ``key`` is listed; false for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(_passes(level, F.col(f"{self.name}{i}"), key), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(out, F.lit(False)) if self.levels else F.lit(False)


def _positions(key: Column, seed: int, bits: int, probes: int) -> list[Column]:
    """Probe places by double hashing."""
    one, two = F.xxhash64(F.lit(seed), key), F.xxhash64(F.lit(seed + 7919), key).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftrightunsigned(one, 2) + F.lit(i) * F.shiftrightunsigned(two, 8), F.lit(bits)) for i in range(probes)]


def _passes(level: Level, words: Column, key: Column) -> Column:
    tests = [F.getbit(F.element_at(words, (F.floor(p / WORD) + 1).cast("int")), (p % WORD).cast("int")) == 1 for p in _positions(key, level.seed, level.bits, level.probes)]
    return key.isNotNull() & reduce(lambda a, b: a & b, tests)


def _level(keys: DataFrame, count: int, rate: float, seed: int, column: str) -> tuple[Level, DataFrame]:
    """A filter over the keys and its words as one row; tasks OR bits by word before the shuffle."""
    spark = keys.sparkSession
    probes = max(1, round(-math.log2(rate)))
    bits = max(WORD, WORD * math.ceil(count * probes / math.log(2) / WORD))
    places = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, bits, probes))).alias("p"))
    rows = places.groupBy(F.floor(F.col("p") / WORD).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    rows = spark.range(bits // WORD).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(rows).groupBy("w").agg(F.bit_or("b").alias("b"))
    return Level(seed, bits, probes), rows.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("r")).select(F.expr("transform(r, x -> x.b)").alias(column))


def _cascade(universe: DataFrame, listed: DataFrame, count: int, size: int, name: str, seed: int) -> Cascade:
    rate = min(0.5, max(2.0**-20, math.sqrt(0.5) * count / max(1, size)))
    cascade, rest, other = Cascade(name), listed, universe
    while count:
        level, words = _level(rest, count, rate if not cascade.levels else 0.5, seed + 31 * len(cascade.levels), f"{name}{len(cascade.levels)}")
        words = words if cascade.words is None else cascade.words.crossJoin(F.broadcast(words))
        cascade = Cascade(name, (*cascade.levels, level), written(words, "filter"))
        last = len(cascade.levels) - 1
        passed = cascade.beside(other).where(_passes(level, F.col(f"{name}{last}"), F.col("key"))).select("key")
        if not last:
            passed = passed.distinct().join(listed, "key", "left_anti")
        rest, other = written(passed, "mistaken"), rest
        count = rest.count()
    return cascade


def _share(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(4242), key), F.lit(parts))


def build(universe: DataFrame, listed: DataFrame, *, name: str = "__filter", seed: int = 1, round_bits: int = ROUND_BITS) -> list[Cascade]:
    """Cascades for ``listed`` over ``universe`` (both: column ``key``; null keys and repeats count for nothing), one for each round.

    Listed keys that the universe lacks are answered too.
    """
    listed = written(listed.select("key").where("key is not null").distinct(), "listed")
    count = listed.count()
    if not count:
        return [Cascade(name)]
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first().n
    rounds = max(1, math.ceil(1.45 * count * (2 + max(1.0, math.log2(1 + size / count))) / round_bits))
    if rounds == 1:
        return [_cascade(universe.select("key"), listed, count, size, f"{name}_0_", seed)]
    parts = [listed.where(_share(F.col("key"), rounds) == r) for r in range(rounds)]
    return [_cascade(universe.select("key").where(_share(F.col("key"), rounds) == r), p, p.count(), size // rounds, f"{name}_{r}_", seed) for r, p in enumerate(parts)]


def _round(cascade: Cascade, number: int, parts: int) -> Callable[[Column, Column], Column]:
    return lambda key, had: F.when(_share(key, parts) == number, cascade.test(key)).otherwise(had)


def member(df: DataFrame, lists: dict[str, tuple[str, list[Cascade]]]) -> DataFrame:
    """``df`` with new columns: name: (column of keys, cascades) adds an array of whether each key is listed.

    A round tests with one cascade of each list; between rounds the rows are stored, so one round's filters are in memory.
    """
    columns = df.columns
    rounds = max(len(c) for _, c in lists.values())
    for r in range(rounds):
        had = {n: F.transform(k, lambda _: F.lit(False)) if not r else F.col(n) for n, (k, _) in lists.items()}
        wide, tested = df, dict(had)
        for n, (keys, cascades) in lists.items():
            if r < len(cascades):
                wide = cascades[r].beside(wide)
                tested[n] = F.zip_with(keys, had[n], _round(cascades[r], r, len(cascades)))
        df = wide.select(*columns, *(c.alias(n) for n, c in tested.items()))
        if r + 1 < rounds:
            df = written(df, "round")
    return df


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


@dataclass(frozen=True)
class UrlRules:
    """Listed keys ``host + path`` (path starts with ``/`` or is empty) by verdict; a key may have one verdict."""

    allow: DataFrame
    block: DataFrame


def judge(pages: DataFrame, rules: UrlRules, blocked_hosts: DataFrame, *, url: str = "url", round_bits: int = ROUND_BITS) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict`` and ``by_method`` (whether the host list decided).

    A rule fits its host and all subdomains where the path starts with its own; the longest rule wins, of equally long ones
    the first in order; a key with both verdicts blocks.  Without a rule, ``block`` if the host or a domain above it is in
    ``blocked_hosts`` (column ``key``), else ``allow``.  Every answer comes from cascades over all the keys the pages can ask for,
    so it is exact.  A page's candidate keys have one of the label counts and path lengths that rules have.  Null urls and urls
    without ``://`` have empty parts; urls of any length are read whole; no page is lost, repeated ones are judged one by one; an
    empty table gives an empty result; input columns stay, except that columns with the names of new ones are replaced.
    """
    cut = F.expr("case when instr(key, '/') > 0 then instr(key, '/') - 1 else length(key) end")
    keys = rules.allow.select("key").unionByName(rules.block.select("key")).where("key is not null")
    shapes = keys.select(F.size(F.split(F.substring(F.col("key"), F.lit(1), cut), r"\.")).alias("labels"), (F.length("key") - cut).alias("chars")).distinct()
    depths = blocked_hosts.where("key is not null").select(F.size(F.split("key", r"\.")).alias("n")).distinct()
    asked = shapes.agg(F.collect_list(F.struct("labels", "chars")).alias("__shapes")).crossJoin(depths.agg(F.collect_list("n").alias("__depths")))
    host, path = url_parts(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict", "by_method").withColumns({"host": host, "path": path})
    names = base.columns
    base = base.crossJoin(F.broadcast(written(asked, "shapes"))).withColumn("__parts", F.split("host", r"\."))
    suffix = "array_join(slice(__parts, -{n}, {n}), '.')"
    base = base.select(
        *names,
        F.expr(f"transform(filter(__shapes, s -> s.labels <= size(__parts) and s.chars <= length(path)), s -> concat({suffix.format(n='s.labels')}, substring(path, 1, s.chars)))").alias("__candidates"),
        F.expr(f"transform(filter(__depths, n -> n <= size(__parts)), n -> {suffix.format(n='n')})").alias("__hosts"),
    )
    universe = written(base.select(F.explode("__candidates").alias("key")).distinct(), "universe")
    hosts = written(base.select(F.explode("__hosts").alias("key")).distinct(), "universe")
    lists = {
        "__allow": ("__candidates", build(universe, rules.allow, name="__a", seed=11, round_bits=round_bits)),
        "__block": ("__candidates", build(universe, rules.block, name="__b", seed=101, round_bits=round_bits)),
        "__listed": ("__hosts", build(hosts, blocked_hosts, name="__h", seed=1009, round_bits=round_bits)),
    }
    out = member(base, lists)
    fits = "filter(arrays_zip(__candidates, __allow, __block), x -> x.__allow or x.__block)"
    best = F.expr(f"array_min(transform({fits}, x -> named_struct('shorter', -length(x.__candidates), 'key', x.__candidates, 'block', x.__block)))")
    out = out.select(*names, best.alias("__best"), F.expr("exists(__listed, x -> x)").alias("__hit"))
    out = out.withColumns({"rule": F.col("__best.key"), "by_method": F.col("__best").isNull() & F.col("__hit")})
    verdict = F.when(F.coalesce(F.col("__best.block"), F.col("by_method")), "block").otherwise("allow")
    return out.withColumn("verdict", verdict).drop("__best", "__hit")


#: The contract's rules.
ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
#: Words that name a domain of advertising, gambling, spam or adult content.
MARKERS = "ads|adult|bets|casino|pills|spam"


def keys_frame(spark: SparkSession, keys: tuple[str, ...]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(k) for k in keys))).alias("key"))


def named_hosts(pages: DataFrame, *, url: str = "url", markers: str = MARKERS) -> DataFrame:
    """``key``: the domains among the pages' hosts of which a label has one of the marker words, alone or between hyphens."""
    host = url_parts(F.col(url))[0]
    key = F.regexp_extract(host, rf"(?:^|\.)((?:[a-z0-9]+-)*(?:{markers})(?:-[a-z0-9]+)*\..+)$", 1)
    return pages.select(key.alias("key")).where("key != ''").distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = UrlRules(keys_frame(spark, ALLOW), keys_frame(spark, BLOCK))
    return judge(pages, rules, named_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
ruled as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from split)
select page_id, host, path, rule,
       case when rule in ('com/', 'www.example.com/en/') then 'allow'
            when rule is not null then 'block'
            when regexp_matches(host, '(^|\.)([a-z0-9]+-)*(ads|adult|bets|casino|pills|spam)(-[a-z0-9]+)*\..+$') then 'block'
            else 'allow' end as verdict
from ruled
"""
