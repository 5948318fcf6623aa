"""Likeness of tracks with copies: pairs of classes and their members give all pairs; blocks of stacked tracks are fast."""

import time

import numpy as np
import pytest

from trackweave.operators import clustering, pair_kernels

SCHEMA = "grp string, track_id long, seq long, x double, y double, z double"


def test_classes_of_copies_give_all_pairs(spark):
    rng = np.random.default_rng(4)
    kinds = [np.cumsum(rng.normal(0, 30, (int(n), 3)), axis=0) for n in (1, 2, 9, 14, 20, 20)]
    rows = [(g, 100 * b + i, k + 1, *map(float, p)) for b, g in enumerate(("g", None)) for i in range(40) for k, p in enumerate(kinds[i % (6 if i < 30 else 3)])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = list(pair_kernels.MEASURES)
    every = {(r.i, r.j): [r[m] for m in names] for r in clustering.similarities(df, most=8).collect()}
    found = clustering.similarity_classes(df, most=8).collect()
    assert len(every) == 2 * 40 * 39 / 2 and len(found) == 2 * (15 + 34)
    first = {r.j: r.i for r in found if r.copy}
    links = {(r.i, r.j): [r[m] for m in names] for r in found if not r.copy}
    own = {r.i: [r[m] for m in names] for r in found if r.copy}
    for (i, j), want in every.items():
        a, b = sorted((first.get(i, i), first.get(j, j)))
        assert (links[a, b] if a != b else own[a]) == pytest.approx(want, abs=1e-12)


def test_tracks_go_to_few_blocks(spark):
    """However many pieces a group has, its tracks go to a few large blocks, whose pieces meet inside tasks."""
    rng = np.random.default_rng(8)
    rows = [("g", i, k + 1, *map(float, p)) for i in range(50) for k, p in enumerate(np.cumsum(rng.normal(0, 30, (4 + i % 7, 3)), axis=0))]
    tracks = clustering._tracks(spark.createDataFrame(rows, SCHEMA), "grp")
    dealt, pairs = clustering._dealt(tracks, "grp", 6, 1000)
    assert dealt.count() == 50 * 6 and pairs == 21
    whole, small, blocks = (sorted(map(tuple, clustering._measured(tracks, "grp", most, held).collect())) for most, held in ((1000, 1000), (6, 1000), (6, 5)))
    assert len(whole) == 50 * 49 / 2
    for found in (small, blocks):
        assert [r[:2] for r in found] == [r[:2] for r in whole]
        assert np.allclose([r[2:] for r in found], [r[2:] for r in whole], rtol=0, atol=1e-12)


def test_a_block_is_measured_in_microseconds_a_pair():
    rng = np.random.default_rng(1)
    a, b = ([np.cumsum(rng.normal(0, 3000, (int(n), 3)), axis=0) for n in rng.integers(45, 99, 175)] for _ in range(2))
    start = time.perf_counter()
    pair_kernels.measured(a, b)
    assert time.perf_counter() - start < 1.0
