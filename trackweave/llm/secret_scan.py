"""Secret scans in DataFrame functions: patterns, and a battery of randomness tests for tokens that no pattern knows.

Tests, on runs of 20 and more characters of common encodings outside the patterns' spans:

* chi-squared against a uniform use of the inferred encoding's alphabet,
* runs of character classes (lower, upper, digit, other),
* serial correlation at lag one, of places in the alphabet and of vowels.

A token has to pass as random (uniform use and no serial dependence are not rejected), and its distance from ordinary text,
for which every test has an expectation that grows with the length, gives a combined z.  False discoveries are controlled
by length: in each class of lengths the Benjamini-Hochberg threshold comes from a histogram of all tokens of the corpus,
so a short token, which can't be far from ordinary text, is reported only if enough tokens of its class are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Fixed patterns of the contract; group 2 of the first has to have 8 characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_=\x00-])[A-Za-z0-9+/_=\x00-]{20,}"
#: Stands for each character of a pattern's span while tokens are looked for; a text's own one counts as another character.
COVER, OTHER = "\\u0000", "\\u0001"
SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Upper limits of the classes of lengths, the histogram's width and reach, and the accepted share of false discoveries.
LENGTHS, STEP, REACH, SHARE = (23, 31, 47, 79), 0.1, 40.0, 0.01


def _found(pattern: str, text: str, kind: int) -> str:
    """SQL for the spans of all matches, leftmost and not overlapping.

    Matches and the pieces between them alternate, so their lengths give the places: sums inside blocks of about the root of
    the number of matches, and sums of the blocks before them, so that many matches don't copy a long array for each.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    pairs = f"""filter(zip_with(regexp_extract_all({text}, '{p}', 0), split({text}, '{p}', -1), (m, b) -> named_struct('m', m, 'before', length(b))), x -> x.m is not null)"""
    blocks = f"""transform(array({pairs}), x -> transform(sequence(0, size(x) - 1, cast(ceil(sqrt(size(x))) as int)), i -> aggregate(slice(x, i + 1, cast(ceil(sqrt(size(x))) as int)),
        named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int,m:string>>)),
        (acc, y) -> named_struct('at', acc.at + y.before + length(y.m),
          'out', concat(acc.out, array(named_struct('start', acc.at + y.before, 'kind', {kind}, 'end', acc.at + y.before + length(y.m), 'm', y.m)))))))[0]"""
    shifted = f"""transform(array({blocks}), x -> zip_with(x, aggregate(x, named_struct('at', 0, 'out', cast(array() as array<int>)),
        (acc, y) -> named_struct('at', acc.at + y.at, 'out', concat(acc.out, array(acc.at))), acc -> acc.out),
        (y, at) -> transform(y.out, s -> named_struct('start', at + s.start, 'kind', s.kind, 'end', at + s.end, 'm', s.m))))[0]"""
    return f"if({text} rlike '{p}', flatten({shifted}), cast(array() as array<struct<start:int,kind:int,end:int,m:string>>))"


def _masked(text: str, pattern: str, wanted: str = "true") -> str:
    """SQL for the text with every match for which ``wanted`` holds overwritten by as many ``COVER`` characters."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    cover = f"if({wanted}, repeat('{COVER}', length(m)), m)"
    return f"if({text} rlike '{p}', array_join(zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (b, m) -> concat(b, coalesce({cover}, ''))), ''), {text})"


def _without_text(column: str) -> str:
    return f"transform({column}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"


_ALPHABET = r"""case when m rlike '^[0-9a-fA-F]+$' then 16 when m rlike '^[a-z]+$' or m rlike '^[A-Z]+$' then 26
  when m rlike '^[a-z0-9]+$' or m rlike '^[A-Z0-9]+$' then 36 when m rlike '^[A-Za-z]+$' then 52 when m rlike '^[A-Za-z0-9]+$' then 62 else 64 end"""
_ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="


def _battery(tokens: str) -> Column:
    """array<struct<start, kind, end, class, z>> of the tokens in column ``tokens`` that pass as random."""
    shape = f"""transform({tokens}, s -> named_struct('start', s.start, 'end', s.end, 'n', length(s.m), 'm', s.m, 'c', split(s.m, ''), 'a', {_ALPHABET.replace('m rlike', 's.m rlike')}))"""
    counted = f"""transform({shape}, s -> named_struct('start', s.start, 'end', s.end, 'n', s.n, 'a', s.a,
      'squares', aggregate(array_distinct(s.c), 0D, (acc, x) -> acc + pow(size(filter(s.c, y -> y = x)), 2)),
      'code', transform(s.c, x -> cast(instr('{_ORDER}', x) as double)),
      'vowel', transform(s.c, x -> if(instr('aeiouyAEIOUY', x) > 0, 1D, 0D)),
      'class', transform(s.c, x -> case when x between 'a' and 'z' then 1 when x between 'A' and 'Z' then 2 when x between '0' and '9' then 3 else 4 end)))"""

    means = f"transform({counted}, s -> named_struct('s', s, 'code', aggregate(s.code, 0D, (p, q) -> p + q) / s.n, 'vowel', aggregate(s.vowel, 0D, (p, q) -> p + q) / s.n))"
    centred = f"""transform({means}, r -> named_struct('start', r.s.start, 'end', r.s.end, 'n', r.s.n, 'a', r.s.a, 'squares', r.s.squares, 'class', r.s.class,
      'code', transform(r.s.code, x -> x - r.code), 'vowel', transform(r.s.vowel, x -> x - r.vowel)))"""

    def serial(x: str) -> str:
        return f"coalesce(try_divide(aggregate(zip_with(slice({x}, 1, s.n - 1), slice({x}, 2, s.n - 1), (p, q) -> p * q), 0D, (p, q) -> p + q), aggregate({x}, 0D, (p, q) -> p + q * q)), 0D)"

    tested = f"""transform({centred}, s -> named_struct('start', s.start, 'end', s.end, 'n', s.n, 'a', s.a, 'd', greatest(0.3D, s.a * 0.06D - 1),
      'chi', s.a * s.squares / s.n - s.n, 'serial', {serial('s.code')}, 'vowels', {serial('s.vowel')},
      'runs', 1 + aggregate(zip_with(slice(s.class, 1, s.n - 1), slice(s.class, 2, s.n - 1), (p, q) -> if(p = q, 0, 1)), 0, (p, q) -> p + q)))"""
    random = f"filter({tested}, s -> (s.chi - (s.a - 1)) / sqrt(2 * (s.a - 1)) <= 4 and abs(s.serial) * sqrt(s.n) <= 4)"
    classes = "case " + " ".join(f"when s.n <= {n} then {i}" for i, n in enumerate(LENGTHS)) + f" else {len(LENGTHS)} end"
    z = """((s.a - 1 + s.n * s.d - s.chi) / sqrt(2 * (s.a - 1) + 4 * s.n * s.d)
       + least(6, (s.runs - 1 - 0.08D * s.n) / sqrt(1 + 0.08D * s.n)) + least(6, (s.vowels + 0.35D) * sqrt(s.n))) / sqrt(3)"""
    return F.expr(f"transform({random}, s -> named_struct('start', s.start, 'kind', 3, 'end', s.end, 'class', {classes}, 'z', {z}))")


def _thresholds(found: DataFrame) -> list[float]:
    """For each class of lengths the smallest z at which expected false discoveries are ``SHARE`` of the reported ones.

    The histogram on the driver has a fixed number of cells.  A token at z in a cell counts from the cell's lower end on.
    """
    cell = F.least(F.greatest(F.floor(F.col("t.z") / STEP), F.lit(-10)), F.lit(int(REACH / STEP))).cast("int")
    rows = found.select(F.explode("tokens").alias("t"), "tested").select("t.class", cell.alias("cell")).groupBy("class", "cell").count().collect()
    tested = {r["class"]: r["n"] for r in found.select(F.explode("tested").alias("t")).groupBy(F.col("t").alias("class")).agg(F.count("*").alias("n")).collect()}
    out = []
    for c in range(len(LENGTHS) + 1):
        seen, best = 0, float("inf")
        for cell_, n in sorted(((r["cell"], r["count"]) for r in rows if r["class"] == c), reverse=True):
            seen += n
            if tested.get(c, 0) * 0.5 * math.erfc(cell_ * STEP / math.sqrt(2)) <= SHARE * seen:
                best = cell_ * STEP
        out.append(best)
    return out


def scan(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``spans``: array<struct<start, kind, end>> sorted by start, then kind (index in ``KINDS``).

    Places are code points, ends exclusive.  Null texts count as empty and have no spans; repeated rows are scanned one by one.
    Tokens that touch a pattern's span are left to the pattern, and digits alone aren't tested.  Texts and tokens of any
    length, and any number of matches, are scanned whole: spans are covered in the text and a token that shows cover is dropped, so
    spans and tokens are never held against each other, and time grows little faster than the text.  Spans that start together come in the order
    of their kinds.  An empty table gives an empty result.  A column of ``keep`` may have any name but ``spans``.
    """
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [f"__keep{i}" for i in range(len(keep))]
    base = df.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), text_.alias("__text"))
    base = base.withColumn("__assign", F.expr(_found(ASSIGN, "__text", 0)))
    value = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    base = base.withColumn("__assign", F.expr(f"filter(__assign, s -> length(regexp_extract(s.m, '{value}', 2)) >= 8)"))
    base = base.withColumns({"__access": F.expr(_found(ACCESS, "__text", 1)), "__hex": F.expr(_found(HEX, "__text", 2))})
    base = base.withColumn("__base", F.array_sort(F.concat(*(F.expr(_without_text(c)) for c in ("__assign", "__access", "__hex")))))
    base = base.withColumn("__text", F.expr(f"translate(__text, '{COVER}', '{OTHER}')"))
    for pattern, wanted in ((ASSIGN, f"length(regexp_extract(m, '{value}', 2)) >= 8"), (ACCESS, "true"), (HEX, "true")):
        base = base.withColumn("__text", F.expr(_masked("__text", pattern, wanted)))
    base = base.withColumn("__token", F.expr(_found(TOKEN, "__text", 3)))
    base = base.withColumn("__token", F.expr(f"filter(__token, t -> not t.m rlike '^[0-9]+$' and instr(t.m, '{COVER}') = 0)"))
    classes = "case " + " ".join(f"when length(t.m) <= {n} then {i}" for i, n in enumerate(LENGTHS)) + f" else {len(LENGTHS)} end"
    found = base.select(*kept, F.col("__base").cast(SPAN).alias("base"), F.expr(f"transform(__token, t -> {classes})").alias("tested"), _battery("__token").alias("tokens"))
    found = written(found, "tokens")
    limits = ", ".join("double('inf')" if math.isinf(z) else f"{z}D" for z in _thresholds(found))
    random = F.expr(f"transform(filter(tokens, t -> t.z >= element_at(array({limits}), t.class + 1)), t -> named_struct('start', t.start, 'kind', t.kind, 'end', t.end))").cast(SPAN)
    return found.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.array_sort(F.concat("base", random)).alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mask: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mask``; null stays null.

    Spans go in blocks of about the root of their number: a block's stretch is cut from the text once, and its spans from the stretch.
    """
    blocks = f"transform(sequence(0, size({spans}) - 1, cast(ceil(sqrt(size({spans}))) as int)), i -> slice({spans}, i + 1, cast(ceil(sqrt(size({spans}))) as int)))"
    ends = "aggregate(transform(bs, b -> array_max(transform(b, s -> s.end))), array(0), (acc, e) -> concat(acc, array(greatest(element_at(acc, -1), e))))"
    piece = f"""transform(array(substring({text}, lo + 1, greatest(0, array_max(transform(b, s -> s.end)) - lo))), w -> aggregate(b, named_struct('at', lo, 'out', ''),
      (acc, s) -> named_struct('at', greatest(acc.at, s.end),
        'out', concat(acc.out, if(s.start >= acc.at, concat(substring(w, acc.at - lo + 1, s.start - acc.at), '{mask}'), ''))), acc -> acc.out))[0]"""
    whole = f"concat(array_join(zip_with(bs, slice(es, 1, size(bs)), (b, lo) -> {piece}), ''), substring({text}, element_at(es, -1) + 1, greatest(0, length({text}) - element_at(es, -1))))"
    return F.expr(f"if(size({spans}) = 0, {text}, transform(array({blocks}), bs -> transform(array({ends}), es -> {whole})[0])[0])")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [F.expr(f"size(filter(spans, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(described(base), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))
