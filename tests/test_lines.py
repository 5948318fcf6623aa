"""Bundles along common lines: the accumulator and its peaks against direct sums, and labels that don't depend on size or partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import clustering, lines

SCHEMA = "grp string, track_id long, seq long, x double, y double, z double"


def bundle(rng, start, end, n, spread=30.0):
    s = np.linspace(0, 1, 20)[:, None]
    return [np.asarray(start) + s * (np.asarray(end) - np.asarray(start)) + rng.normal(0, spread, (20, 3)) for _ in range(n)]


def made(scale=1, seed=5):
    """Three bundles, one of them flown both ways, and tracks that turn on their own."""
    rng = np.random.default_rng(seed)
    out = [bundle(rng, (0, 0, 3000), (1e4, 2e3, 1000), 9 * scale), bundle(rng, (1e4, 2e3, 1000), (0, 0, 3000), 5 * scale), bundle(rng, (0, 9e3, 2000), (4e3, -9e3, 500), 7 * scale), bundle(rng, (-9e3, 5e3, 100), (9e3, 6e3, 900), 6 * scale)]
    return [t for part in out for t in part], [k for k, part in enumerate(out) for _ in part]


def frame(spark, groups):
    rows = [(g, i, k + 1, *map(float, p)) for g, tracks in groups.items() for i, t in tracks.items() for k, p in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("likelihood", [False, True])
def test_scores_are_direct_sums(likelihood):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.3], [0.0, 0.4]])
    weights = lines.kernel(likelihood, 0.5)
    found = lines.peaks(lines.votes(p[:, 0], p[:, 1]).astype(float), weights)
    far = lambda t, r: np.abs(p[:, 1] * np.cos(t) - p[:, 0] * np.sin(t) - r)
    gain = lambda d: np.log((0.7 * np.exp(-(d**2) / 0.5) + 0.03 + 1e-8) / (0.03 + 1e-8)) if likelihood else (d <= 0.5 + 1e-9)
    for t, r, s in found[:40]:
        cells = np.rint((p[:, 1] * np.cos(t) - p[:, 0] * np.sin(t)) / lines.STEP) * lines.STEP
        d = np.abs(cells - r)
        assert s == pytest.approx(gain(d)[d < 2.0 + 1e-9].sum(), abs=1e-4)
    direct = max(gain(far(t, r)).sum() for t in np.arange(60) * np.pi / 60 for r in np.arange(-20, 21) * 0.1)
    assert found[0][2] >= 0.93 * direct and (np.diff(found[:, 2]) <= 0).all()
    for i, a in enumerate(found):
        for b in found[:i]:
            turn = abs(round((a[0] - b[0]) * 60 / np.pi))
            same = abs(a[1] - b[1]) if turn <= 30 else abs(a[1] + b[1])
            assert min(turn, 60 - turn) > 3 or same > 0.5 + 1e-9


@pytest.mark.parametrize("name", ["RANSAC", "MLESAC"])
def test_bundles_whatever_the_size_and_the_partitions(spark, name):
    tracks, kind = made()
    odd = {900: np.zeros((1, 3)), 901: np.full((2, 3), 5.0), 902: np.array([[0.0, 0, 0], [1.0, 1, 1], [0.0, 0, 0]])}
    one = dict(enumerate(tracks)) | odd
    big, _ = made(60, 6)
    groups = {"g": one, None: one, "big": dict(enumerate(big)), "two": dict(enumerate(tracks[:2])), "none": {900: odd[900]}}
    found = clustering.cluster(frame(spark, groups).repartition(7), name).collect()
    label = {g: {r.track_id: r.cluster_id for r in found if r.grp == g} for g in groups}
    assert sum(map(len, label.values())) == len(found) == sum(map(len, groups.values())) and len(big) > 1500
    alone = {r.track_id: r.cluster_id for r in clustering.cluster(frame(spark, {"g": one}).coalesce(1), name).collect()}
    assert label["g"] == label[None] == alone
    assert [alone.pop(i) for i in odd] == [-1, -1, -1] and label["none"] == {900: -1}
    numbers = sorted(set(alone.values()))
    assert numbers == list(range(len(numbers)))
    for k in range(4):
        own = [alone[i] for i in range(len(kind)) if kind[i] == k]
        assert own.count(max(own, key=own.count)) >= 0.8 * len(own)
    assert not {alone[i] for i in range(9)} & {alone[i] for i in range(9, 14)}
    assert len(set(label["big"].values())) < 40 and len(set(label["two"].values())) == 1


def test_lone_tracks_are_numbered_by_id(spark):
    rng = np.random.default_rng(3)
    own = {i: np.cumsum(rng.normal(0, 900, (12, 3)), axis=0) for i in range(12)}
    out = {r.track_id: r.cluster_id for r in lines.bundles(frame(spark, {"g": own}), "grp", threshold=1e-6).collect()}
    assert out == {i: i for i in range(12)}
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.bundles(empty, "grp").count() == 0


def test_string_ids_keep_their_type(spark):
    tracks, _ = made()
    df = frame(spark, {"g": dict(enumerate(tracks))}).withColumn("track_id", F.format_string("t%03d", "track_id"))
    assert {type(r.track_id) for r in lines.bundles(df, "grp").collect()} == {str}
