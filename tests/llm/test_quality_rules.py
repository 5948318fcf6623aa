"""The quality rules against plain Python: counts, the n-gram model entry by entry, limits and verdicts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from trackweave.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), again, len(covered)


def normal(text):
    return bytes(32 if 9 <= b <= 13 else 48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def model(texts, order):
    """{(order, n-gram): p} and {(order, context): weight of the order below}."""
    seen = Counter()
    for t in texts:
        line = b"\x02" * (order - 1) + normal(t)
        seen.update(line[i : i + order] for i in range(len(line) - order + 1))
    level = {order: seen}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    p, weight = {}, {}
    for k in range(1, order + 1):
        d = q.discounts(Counter(n for n in level[k].values() if n <= 4))
        total, left = defaultdict(int), defaultdict(float)
        for g, n in level[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        for g, n in level[k].items():
            weight[k, g[:-1]] = left[g[:-1]] / total[g[:-1]]
            p[k, g] = (n - d[min(n, 3) - 1]) / total[g[:-1]] + weight[k, g[:-1]] * (p[k - 1, g[1:]] if k > 1 else 1 / 256)
    return p, weight


def surprise(text, p, weight, order):
    line = b"\x02" * (order - 1) + normal(text)

    def log_p(g, k):
        if not k:
            return -math.log(256)
        if (k, g) in p:
            return math.log(p[k, g])
        return math.log(weight.get((k, g[:-1]), 1.0)) + log_p(g[1:], k - 1)

    got = [log_p(line[i : i + order], order) for i in range(len(line) - order + 1)]
    return -sum(got) / len(got) if got else None


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(4), []
    parts = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ung", "ein", "ich", "ö"], None: ["ka", "ro", "mi"]}
    for i in range(240):
        lang = ["en", "de", None][i % 3]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
        out.append((i, lang, " ".join(words)))
    noise = " ".join("".join(chr(rng.randint(0x21, 0x7E)) for _ in range(6)) for _ in range(80))
    out += [(900, "en", noise), (901, "en", "same words here " * 60), (902, "de", " ".join(f"a{i}\n" for i in range(60)) * 2), (903, "xx", " ".join(chr(0x4E00 + i) for i in range(70)))]
    out += [(None, None, None), (None, "en", ""), (5, "en", " \t\n"), (5, "en", "x"), (6, "de", "A" * 300_000 + " b"), (7, "en", out[0][2])] + [out[1]] * 40
    out += [(904, "en", "<a> #b\r\n<a> #b\n\n<a> #b\n" + "1 2 3 é\v\n" * 3)]
    return out


def stored(spark, texts, path):
    spark.createDataFrame([(i, t, lang, "s", 0) for i, lang, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def in_order(rows):
    return sorted(rows, key=str)


def test_query_against_plain_python(spark, texts, tmp_path):
    found = q.op13_quality_rules(spark, stored(spark, texts, tmp_path)).collect()
    p, weight = model([t for *_, t in texts], q.ORDER)
    own = [(i, lang, counts(t), surprise(t, p, weight, q.ORDER)) for i, lang, t in texts]
    failed = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
    cells = defaultdict(list)
    for _, lang, c, s in own:
        if not failed(c):
            cells[lang].append(math.floor(s / q.CELL))
    limits = {}
    for lang, at in cells.items():
        at.sort()
        low, high = (at[math.ceil(len(at) * share) - 1] for share in (0.25, 0.75))
        limits[lang] = ((low - q.REACH * (high + 1 - low)) * q.CELL, (high + 1 + q.REACH * (high + 1 - low)) * q.CELL)
    want = [(i, *c, failed(c), not failed(c) and limits[lang][0] <= s <= limits[lang][1]) for i, lang, c, s in own]
    assert in_order((r.doc_id, *(r[c] for c in q.COUNTS), r.base_failed, r.kept) for r in found) == in_order(want)
    kept = {r.doc_id for r in found if r.kept}
    assert {*range(100)} - {5, 6} <= kept | {i for i, _, c, _ in own if failed(c)} and not kept & {900, 901, 904}
    near = {str((r.doc_id, *(r[c] for c in q.COUNTS))): r.perplexity for r in found}
    for i, _, c, s in own:
        assert near[str((i, *c))] == (None if s is None else pytest.approx(math.exp(s), rel=1e-5))


def test_model_entry_by_entry(spark, texts):
    part = [(t,) for *_, t in texts[:60]] + [(None,)]
    p, weight = model([t for (t,) in part], 3)
    code = lambda g: int.from_bytes(g, "big")
    want = {(k, code(g)): math.log(v) for (k, g), v in p.items()} | {(-k, code(g)): math.log(v) for (k, g), v in weight.items()}
    found = {(r.kind, r.key): r.value for r in q.train(spark.createDataFrame(part, "text string"), order=3).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for k in range(1, 4):
        seen = defaultdict(float)
        for (kind, g), v in found.items():
            if kind == k:
                seen[g >> 8] += math.exp(v)
        assert all(v <= 1 + 1e-9 for v in seen.values())


def test_foreign_texts_and_the_join(spark, texts):
    df = spark.createDataFrame([(t,) for *_, t in texts[:60]], "text string")
    entries = q.train(df, order=4)
    p, weight = model([t for *_, t in texts[:60]], 4)
    other = [(k, t) for k, (*_, t) in enumerate(texts[100:])]
    asked = spark.createDataFrame(other, "k0 long, text string").repartition(3)
    want = {k: surprise(t, p, weight, 4) for k, t in other}
    for bound in (q.BROADCAST_BYTES, 0):
        found = {r.k0: r.surprise for r in q.measured(asked, entries, keep=("k0",), order=4, broadcast_bytes=bound).collect()}
        assert found.keys() == want.keys()
        assert all(found[k] == (None if s is None else pytest.approx(s, rel=1e-5)) for k, s in want.items())


def test_arrays_are_sorted_and_split(spark, texts, monkeypatch):
    import numpy as np

    entries = q.train(spark.createDataFrame([(t,) for *_, t in texts[:30]], "text string"), order=3)
    monkeypatch.setattr(q, "BLOCK", 100)
    rows = q.stored_arrays(entries).collect()
    assert len(rows) > 12 and sum(len(r.hashes) // 8 for r in rows) == entries.count() and all(len(r.hashes) == 2 * len(r["values"]) for r in rows)
    assert all((np.diff(np.frombuffer(r.hashes, dtype=np.uint64).astype(float)) >= 0).all() for r in rows)


def test_empty_table_and_clashes(spark, tmp_path):
    assert q.op13_quality_rules(spark, stored(spark, [], tmp_path)).collect() == []
    df = spark.createDataFrame([("a", "en", "b")], "kept string, lang string, text string")
    with pytest.raises(ValueError, match="kept"):
        q.judged(df, keep=("kept",))
    out = q.judged(df.withColumnsRenamed({"kept": "chunk"}), keep=("chunk", "lang", "text")).collect()
    assert [(r.chunk, r.lang, r.text, r.base_failed, r.kept) for r in out] == [("a", "en", "b", True, False)]
