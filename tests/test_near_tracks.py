"""The threshold join of tracks against the spatial likeness of all pairs."""

import numpy as np
import pytest

from trackweave.operators import near_tracks as nt
from trackweave.operators import pair_kernels as pk

SCHEMA = "cluster_id int, track_id long, seq int, x double, y double, z double"


def tracks(seed, many, spread=40_000.0, meet=True):
    """Tracks of one to some dozen points that come from all sides and share one end."""
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(many):
        n = int(rng.integers(1, 3)) if i % 9 == 0 else int(rng.integers(3, 40))
        start = rng.normal(size=3) * [spread, spread, 2_000]
        line = start * (1 - np.linspace(0, 1, n)[:, None]) + rng.normal(size=(n, 3)) * 50
        out[i % 3, i] = line if meet else line[::-1]
    for i in range(4):
        out[0, many + i] = out[0, 3] + 30.0 * i
    return out


def brute(own, within, monkeypatch):
    """Distances of all pairs by the kernel of the likeness, its scale stretched so that wide ones don't vanish in exp."""
    monkeypatch.setattr(pk, "SCALE", 1e5)
    keys = sorted(own)
    sim = pk.spatial([own[k] for k in keys], [own[k] for k in keys])
    pairs = {(a[0], a[1], b[1]): -1e5 * np.log(sim[i, j]) for i, a in enumerate(keys) for j, b in enumerate(keys) if a[0] == b[0] and a[1] < b[1]}
    return {k: d for k, d in pairs.items() if d <= within}


def table(spark, own, extra=()):
    rows = [(g, t, n, *map(float, p)) for (g, t), line in own.items() for n, p in enumerate(line)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


@pytest.mark.parametrize("within,meet", [(150.0, True), (20_000.0, True), (20_000.0, False), (60_000.0, True)])
def test_near_tracks_are_all_pairs_within_the_distance(spark, monkeypatch, within, meet):
    own = tracks(int(within), 60, meet=meet)
    want = brute(own, within, monkeypatch)
    got = {(r.cluster_id, r.i, r.j): r.distance for r in nt.near_tracks(table(spark, own), within).collect()}
    assert len(want) >= 3 and set(got) == set(want)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-3)


def test_most_pairs_are_left_out_by_bounds(spark, monkeypatch):
    own = tracks(7, 240)
    lines = nt.lines(table(spark, own), "cluster_id")
    assert len(brute(own, 3_000.0, monkeypatch)) <= nt.bounded(lines, 3_000.0, "cluster_id").count() < 0.1 * 3 * 80 * 79 / 2


def test_gaps_and_small_groups(spark):
    own = {(0, 1): np.zeros((3, 3)), (0, 2): np.zeros((5, 3)), (1, 3): np.ones((1, 3)), (1, 4): np.ones((9, 3)), (2, 5): np.ones((4, 3))}
    extra = [(None, 6, 0, 0.0, 0.0, 0.0), (0, 7, 0, None, 0.0, 0.0), (0, 1, 3, 0.0, float("nan"), 0.0)]
    got = nt.near_tracks(table(spark, own, extra), 10.0).collect()
    assert sorted((r.cluster_id, r.i, r.j, r.distance, r.spatial) for r in got) == [(0, 1, 2, 0.0, 1.0), (1, 3, 4, 0.0, 1.0)]
    assert nt.near_tracks(spark.createDataFrame([], SCHEMA), 10.0).count() == 0


def test_a_pair_is_no_row_before_it_is_a_result(spark, monkeypatch):
    """Tracks meet as blocks, so what is shuffled grows with pairs of blocks; blocks of every size give the same pairs."""
    own = tracks(11, 90)
    want = brute(own, 20_000.0, monkeypatch)
    lines = nt.lines(table(spark, own), "cluster_id")
    for most in (60, 400, 100_000):
        rows = nt.blocks(lines, 20_000.0, "cluster_id", most).collect()
        assert len(rows) <= (94 * 94 if most == 60 else 94 * 12 if most == 400 else 94)
        monkeypatch.setattr(nt.blocks, "__defaults__", (most,))
        got = {(r.cluster_id, r.i, r.j): r.distance for r in nt._joined(lines, 20_000.0, "cluster_id", True).collect()}
        assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-3)
