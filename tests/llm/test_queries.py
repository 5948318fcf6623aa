"""The registered queries against brute force over small tables with nulls, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trackweave.llm import fingerprint
from trackweave.llm.registry import QUERIES

from .test_operators import SPACE, WORD, base_spans, components, corpus, in_order, lower

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
held = lambda i, modulus, rest: i is not None and zlib.crc32(str(i).encode()) % modulus == rest
SYLLABLES = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ung", "ein", "ich", "ö"], "fr": ["eau", "oi", "é", "ais", "qu"]}


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text, lang, quality, toxic): prose that can be learned, then the odd rows."""
    rng, out = random.Random(21), []
    for i in range(400):
        lang = ["en", "de", "fr"][i % 3]
        w = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randint(5, 60))]
        good, bad = i % 5 != 0, i % 4 == 1
        if not good:
            w = [x + "###" for x in w]
        if bad:
            w[2] = "moron"
        out.append((10_000 + i, " ".join(w), lang, int(good), int(bad)))
    return out + [(i, t, None, None, None) for i, t in corpus()] + [(20_000, "token=abcdefgh0123 " + "0123456789abcdef" * 3, "en", None, None)]


def stored(spark, path, texts):
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang, _, _ in texts]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, _, q, x in texts if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    long = next(t for _, t, _, _, _ in texts if t and len(t.split()) > 1000)
    items = [("b", " ".join(long.split()[100:160])), ("a", "One TWO"), ("none", None), ("dots", "..."), ("moron", "x")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    return stored(spark, str(tmp_path_factory.mktemp("tables")), texts)


def ran(spark, folder, name):
    return QUERIES[name](spark, folder[0]).collect()


def test_op2(spark, folder, texts):
    rows = sorted(((i, t or "") for i, t, *_ in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sets = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))(SPACE.findall(lower(t)))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        want.append(((i is None, i or 0), len(t), sha(changed), sets(t), sets(changed), sets(after)))
    found = sorted(ran(spark, folder, "op2_fingerprint"), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    want.sort(key=lambda w: (*w[0], *w[1:3]))
    for r, w in zip(found, want, strict=True):
        assert ((r.doc_id is None, r.doc_id or 0), r.n_chars, r.edited_sha256) == w[:3]
        for near, a, b in ((r.near_edited, w[3], w[4]), (r.near_next, w[3], w[5])):
            assert abs(near - jaccard(a, b)) < (1e-9 if len(a | b) <= fingerprint.K else 0.25)
        assert len(r.fingerprint) == 12 * min(fingerprint.K, len(w[3])) and len(r.edited_fingerprint) == 12 * min(fingerprint.K, len(w[4]))


def test_op3(spark, folder, texts):
    starts, split = {}, [(i, SPACE.findall(t or "")) for i, t, *_ in texts]
    for k, (_, w) in enumerate(split):
        for p in range(len(w) - 34):
            starts.setdefault(tuple(w[p : p + 35]), []).append((k, p))
    gone = {(k, q) for places in starts.values() if len(places) > 1 for k, p in places for q in range(p, p + 35)}
    want = [(i, len(w), sum((k, q) in gone for q in range(len(w))), sha(" ".join(x for q, x in enumerate(w) if (k, q) not in gone))) for k, (i, w) in enumerate(split)]
    assert in_order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in ran(spark, folder, "op3_substring_dedup")) == in_order(want)


def test_op4(spark, folder, texts):
    kinds, want = ("assign", "access", "hex"), []
    for i, t, *_ in texts:
        spans = base_spans(t or "")
        want.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))))
    found = ran(spark, folder, "op4_secret_scan")
    assert in_order((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == in_order(want)
    assert all(sha(",".join(x for x in r.spans.split(",") if x and not x.startswith("random"))) == r.base_sha256 for r in found)


def test_op5(spark, folder, texts):
    want = [(i, n, c, i is not None and i == c) for i, n, c in components([(i, t) for i, t, *_ in texts], 3, 85)]
    assert in_order((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in ran(spark, folder, "op5_near_dedup")) == in_order(want)


def test_op6(spark, folder, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public.path("word_bpe_49k.json")), []
    for i, text, *_ in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.append((i, k, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    found = ran(spark, folder, "op6_packing")
    assert in_order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == in_order(want)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0]
        for at, n in sorted(own):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 4096
    assert len(places) == -(-sum(r.length for r in found) // 4096)


def test_op7(spark, folder, texts):
    split = [(n, WORD.findall(lower(t or ""))) for n, t in folder[1]]
    want = []
    for i, t, *_ in texts:
        w, hit, mine = WORD.findall(lower(t or "")), set(), set()
        for name, x in split:
            k = min(13, len(x))
            for s in range(len(x) - k + 1 if x else 0):
                for p in [p for p in range(len(w) - k + 1) if w[p] == x[s] and w[p : p + k] == x[s : s + k]]:
                    hit |= set(range(p, p + k))
                    mine.add(name)
        want.append((i, len(w), len(hit), len(mine), sha(",".join(sorted(mine))), bool(hit) and 20 * len(hit) >= len(w)))
    found = ran(spark, folder, "op7_decontamination")
    assert in_order((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == in_order(want)
    assert sum(r.contaminated for r in found) > 2


def test_op8(spark, folder, texts):
    found = ran(spark, folder, "op8_language_id")
    assert len(found) == len(texts) and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in found)
    lang = {i: x for i, _, x, *_ in texts if x}
    right = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out and r.doc_id in lang]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(r.lang_pred == "und" for r in found) == sorted(not letters(t) for _, t, *_ in texts)


@pytest.mark.parametrize(("name", "column", "modulus", "rest", "threshold"), [("op9_toxicity", 4, 4, 2, 0.3), ("op10_quality", 3, 3, 1, 0.5)])
def test_op9_and_op10(spark, folder, texts, tmp_path, name, column, modulus, rest, threshold):
    found = ran(spark, folder, name)
    assert len(found) == len(texts)
    assert all(r.held_out == held(r.doc_id, modulus, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)
    label = {t[0]: t[column] for t in texts if t[column] is not None}
    right = [r.predicted == label[r.doc_id] for r in found if r.held_out and r.doc_id in label]
    assert len(right) > 50 and sum(right) >= 0.95 * len(right)
    flipped = [(*t[:3], *(1 - v if v is not None and held(t[0], modulus, rest) else v for v in t[3:])) for t in texts]
    other = {(r.doc_id, round(r.score, 9)) for r in ran(spark, stored(spark, str(tmp_path), flipped), name)}
    assert other == {(r.doc_id, round(r.score, 9)) for r in found}


def test_op1(spark, tmp_path):
    urls = ["http://WWW.Example.com/en/x?q", "https://example.com/en", "http://x.net/es/1#f", None, "", "no/scheme", "http://com", "http://u@b.com:80/" + "x" * 5000, "x://y://z.com/", "http://x.net/es/1#f"]
    spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()}
    assert [found[i].rule for i in range(10)] == ["www.example.com/en/", "com/", "net/es/", None, None, None, None, None, None, "net/es/"]
    assert (found[1].host, found[1].path, found[8].host, found[8].path) == ("example.com", "/en", "y:", "//z.com/")
    assert [found[i].verdict for i in (0, 1, 2, 9)] == ["allow", "allow", "block", "block"] and all(found[i].host == found[i].path == "" for i in (3, 4, 5))
