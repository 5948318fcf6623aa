"""Exact neighbours by pivots against brute force."""

import numpy as np
import pytest

from trackweave.operators import neighbours as nb


def brute(rows, k):
    """{(group, i): [(j, sim), ..]} of all pairs."""
    out = {}
    for g, i, v in rows:
        others = []
        for h, j, w in rows:
            if g == h and i != j:
                a, b = np.array(v), np.array(w)
                others.append((-round(float(a @ b / ((np.linalg.norm(a) + 1e-8) * (np.linalg.norm(b) + 1e-8))), 9), j))
        out[g, i] = [(j, s) for s, j in sorted(others)[:k]]
    return out


def found(spark, rows, k, **options):
    table = spark.createDataFrame(rows, "label string, vec_id long, vector array<double>").repartition(5)
    got = {}
    for r in nb.nearest(table, k, **options).collect():
        got.setdefault((r.label, r.i), []).append((r["rank"], r.j, r.sim))
    return {key: sorted(v) for key, v in got.items()}


def held(got, want):
    for key, near in want.items():
        mine = got.get(key, [])
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert np.allclose([-s for _, _, s in mine], [s for _, s in near], atol=2e-9)
        # Ties at the last digit may fall either way; all others are the same rows.
        clear = [j for n, (j, s) in enumerate(near) if all(abs(s - t) > 1e-8 for m, (_, t) in enumerate(near) if m != n)]
        assert set(clear[:-1]) <= {j for _, j, _ in mine}


@pytest.mark.parametrize("most,pivots", [(2_000, 64), (25, 4), (25, 40), (7, 1)])
def test_nearest_is_brute_force_for_any_block(spark, most, pivots):
    """A group with most of the rows, cells above a block, and likenesses that repeat."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = [("hot" if i % 8 else "small", i, (centres[i % 6] + 0.2 * rng.normal(size=5)).tolist()) for i in range(180)]
    held(found(spark, rows, 6, most=most, pivots=pivots), brute(rows, 6))


def test_zeros_copies_small_groups_and_gaps(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("a", 3, [2.0, 0.0]), ("a", 4, [0.0, 0.0]), ("a", 5, [0.0, 0.0]), ("a", 6, [-1.0, 0.0]), ("lone", 7, [1.0, 1.0])]
    got = found(spark, [*rows, (None, 8, [1.0, 0.0]), ("a", None, [1.0, 0.0]), ("a", 9, None)], 3, most=2, pivots=3)
    # The guard of the norm makes the longer copy a little more alike.
    assert [j for _, j, _ in got["a", 1]] == [3, 2, 4] and [j for _, j, _ in got["a", 3]] == [1, 2, 4]
    assert [(j, s) for _, j, s in got["a", 4]] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert [j for _, j, _ in got["a", 6]] == [4, 5, 1] and ("lone", 7) not in got and len(got) == 6
    assert found(spark, [], 3) == {}


def test_far_cells_are_never_met(spark):
    """Ten tight bundles of 60: a vector visits the cells of its own bundle, not all."""
    rng = np.random.default_rng(2)
    rows = [("g", i, (np.eye(10)[i % 10] + 0.01 * rng.normal(size=10)).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "label string, vec_id long, vector array<double>")
    own, cells = nb._dealt(table, "label", "vec_id", 20, 2_000)
    assert nb._visits(own, cells, 5).count() < 0.3 * 600 * cells.count()
    held(found(spark, rows, 5, pivots=20), brute(rows, 5))


def test_mutual_pairs(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.5), (1, 4, 0.4)], "i long, j long, sim double")
    assert [(r.i, r.j) for r in nb.mutual(near).collect()] == [(1, 2)]
