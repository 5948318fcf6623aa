"""Secrets in texts with very many matches, random tokens against a plain form of the tests, and clashing columns of the packing."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from trackweave.llm import packing, secret_scan

from .test_operators import base_spans

ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="


def alphabet(m):
    for n, pattern in ((16, "[0-9a-fA-F]+"), (26, "[a-z]+|[A-Z]+"), (36, "[a-z0-9]+|[A-Z0-9]+"), (52, "[A-Za-z]+"), (62, "[A-Za-z0-9]+")):
        if re.fullmatch(pattern, m):
            return n
    return 64


def serial(x):
    mean = sum(x) / len(x)
    c = [v - mean for v in x]
    square = sum(v * v for v in c)
    return sum(p * q for p, q in zip(c, c[1:])) / square if square else 0.0


def random_tokens(texts):
    """(text number, start, end) of the tokens that the battery and the false-discovery control report."""
    tested, passed = {}, []
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t or ""):
            if re.fullmatch("[0-9]+", m[0]) or any(a < m.end() and m.start() < b for a, _, b in base):
                continue
            s, n = m[0], len(m[0])
            c = next((k for k, limit in enumerate(secret_scan.LENGTHS) if n <= limit), len(secret_scan.LENGTHS))
            tested[c] = tested.get(c, 0) + 1
            a = alphabet(s)
            chi = a * sum(s.count(x) ** 2 for x in set(s)) / n - n
            if (chi - (a - 1)) / math.sqrt(2 * (a - 1)) > 4 or abs(serial([float(ORDER.index(x) + 1) for x in s])) * math.sqrt(n) > 4:
                continue
            kinds = [1 if "a" <= x <= "z" else 2 if "A" <= x <= "Z" else 3 if "0" <= x <= "9" else 4 for x in s]
            runs = 1 + sum(p != q for p, q in zip(kinds, kinds[1:]))
            vowels = serial([float(x in "aeiouyAEIOUY") for x in s])
            d = max(0.3, a * 0.06 - 1)
            z = (a - 1 + n * d - chi) / math.sqrt(2 * (a - 1) + 4 * n * d) + min(6, (runs - 1 - 0.08 * n) / math.sqrt(1 + 0.08 * n)) + min(6, (vowels + 0.35) * math.sqrt(n))
            passed.append((c, z / math.sqrt(3), i, m.start(), m.end()))
    out = []
    for c in tested:
        own = [(min(max(math.floor(z / secret_scan.STEP), -10), int(secret_scan.REACH / secret_scan.STEP)), z, *at) for k, z, *at in passed if k == c]
        cells = sorted({x[0] for x in own}, reverse=True)
        limits = [x for x in cells if tested[c] * 0.5 * math.erfc(x * secret_scan.STEP / math.sqrt(2)) <= secret_scan.SHARE * sum(y[0] >= x for y in own)]
        if limits:
            out += [tuple(at) for _, z, *at in own if z >= min(limits) * secret_scan.STEP]
    return sorted(out)


def test_random_spans_against_plain_python(spark):
    rng = random.Random(2)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for i in range(300):
        words = [draw("etaoinshr", rng.randint(2, 9)) for _ in range(20)]
        if i % 3 == 0:
            words[4] = draw(ORDER[: rng.choice((26, 52, 62, 64))], rng.randint(20, 90))
        if i % 5 == 0:
            words[9] = "counter-revolutionary-characterisation" + draw("aeiou", 4)
        if i % 7 == 0:
            words[12] = f"token={draw(ORDER[:62], 24)}{draw('+/', 1)}x"
        texts.append(" ".join(words))
    texts += [None, "", "a\x00b " + draw(ORDER[:62], 40), "1" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, s.start, s.end) for r in secret_scan.scan(df).collect() for s in r.spans if s.kind == 3)
    assert found == random_tokens(texts) and len(found) > 50


def test_very_many_matches_take_little_more_time(spark):
    def took(n):
        text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(n))
        began = time.time()
        out = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=("doc_id", "text"))
        row = out.select(F.size("spans").alias("n"), secret_scan.redacted("text", "spans").alias("masked")).first()
        assert row.n == n and row.masked == " ".join(["[SECRET]"] * n)
        return time.time() - began

    took(10)
    assert took(16_000) < took(1_000) + 6


def test_packing_keeps_other_columns_and_refuses_its_own(spark):
    df = spark.createDataFrame([(1, 0, 10, "x", 5, "r"), (2, 0, 4096, "y", 6, None)], "doc_id long, piece int, length long, group string, row long, `a.b` string")
    out = packing.packed(df)
    assert sorted((r.doc_id, r.group, r.row, r["a.b"], r.offset) for r in out.collect()) == [(1, "x", 5, "r", 0), (2, "y", 6, None, 0)]
    for name in ("sequence_id", "offset"):
        with pytest.raises(ValueError, match=name):
            packing.packed(df.withColumn(name, F.lit(1)))
