"""Whitening against numpy on exact integers."""

from fractions import Fraction

import numpy as np
import pytest

from trackweave.llm import whitening


def data(n=400, dims=20, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + rng.normal(size=dims) * 5).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(None, rows[8][1]), (5, rows[9][1])]
    odd = [(2000, None), (2001, [1.0] * (dims - 1) + [None]), (2002, [float("nan")] + [1.0] * (dims - 1)), (2003, [float("-inf")] * dims), (2004, []), (2005, [1.0, 2.0])]
    return rows, odd


def brute(rows, components=16):
    grid = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)) for i, v in rows]
    fitted = sorted({x for _, x in grid})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(x, mean, strict=True)] for x in fitted])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in grid:
        own = np.array([float(c - m) for c, m in zip(x, mean, strict=True)])
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out += [(i, k + 1, n, dev, float(own @ v[:, k] / np.sqrt(e[k])), float(e[k] / e.sum())) for k in range(min(components, len(e)))]
    return out


def test_query(spark, tmp_path):
    rows, odd = data()
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.op12_embedding_whitening(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = sorted(brute(rows), key=key)
    found.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component, r.deviation))
    sign = {}
    for r, w in zip(found, want, strict=True):
        assert (r.vec_id, r.component, r.n, r.deviation) == w[:4]
        s = sign.setdefault(r.component, np.sign(r.whitened * w[4]))
        assert r.whitened * s == pytest.approx(w[4], abs=1e-9)
        assert r.explained == pytest.approx(w[5], rel=1e-9)
        assert r.identity_error < 1e-9


def test_many_triangles_meet_in_rounds(spark):
    rows, _ = data(300, 9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    model, fitted = whitening.fit(df.select(whitening.on_grid(df.embedding).alias("x")).repartition(70), 16)
    x = np.array([r.x for r in fitted.repartition(70).collect()], dtype=float)
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-12)
    many = fitted.repartition(70)
    assert np.allclose(np.linalg.norm(whitening._triangle(many, 9, model)), np.linalg.norm(x - x.mean(axis=0)), rtol=1e-12)


def test_jacobi_against_numpy():
    rng = np.random.default_rng(1)
    for p, d in ((9, 9), (64, 64), (3, 7), (1, 1), (40, 5)):
        r = np.triu(rng.normal(size=(p, d))) * 10.0 ** -np.arange(d).clip(max=6)
        sigma, v = whitening.jacobi(r)
        assert np.allclose(sigma[: min(p, d)], np.linalg.svd(r, compute_uv=False)[: len(sigma)], rtol=1e-10, atol=1e-15)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)


def test_few_and_degenerate_rows(spark):
    schema = "vec_id string, n int, embedding array<double>"
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, schema), keep=("vec_id",)).collect()
    assert run([]) == [] and run([("a", 1, None)]) == [] and run([("a", 1, [])]) == [] and run([("a", 1, [1.0]), (None, 2, [1.0])]) == []
    two = run([("a", 1, [1.0, 5.0]), ("b", None, [3.0, 5.0]), ("b", 1, [3.0, 5.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in sorted(two)] == [("a", 1, 2, 128**2, 1.0, 1.0)] + [("b", 1, 2, 128**2, 1.0, 1.0)] * 2
    far = run([("a", 1, [1e30]), ("b", 1, [-1e30])])
    assert [r.deviation for r in far] == [None, None] and sorted(round(r.whitened, 9) for r in far) == [-1, 1]
    with pytest.raises(ValueError, match="n"):
        whitening.whitened(spark.createDataFrame([("a", 1, [1.0])], schema), keep=("n",))
