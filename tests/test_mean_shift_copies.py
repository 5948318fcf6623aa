"""Mean shift of large groups: copies count as one vector with its number, and all groups go together."""

import numpy as np

from trackweave.operators import cluster_kernels as ck
from trackweave.operators import clustering
from trackweave.operators import large_clusters as lc

SCHEMA = "grp string, track_id long, seq long, x double, y double, z double"


def test_copies_and_groups_go_together(spark):
    rng = np.random.default_rng(6)
    kinds = [np.cumsum(rng.normal(0, 900, (int(n), 3)), axis=0) for n in rng.integers(3, 12, 9)]
    groups = {"a": [kinds[i % 9] for i in range(31)], None: [kinds[i % 4] + rng.normal(0, 5, 3) * (i % 3) for i in range(17)]}
    rows = [(g, 100 * b + i, k + 1, *map(float, p)) for b, (g, own) in enumerate(groups.items()) for i, t in enumerate(own) for k, p in enumerate(t)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.track_id: (r.grp, r.cluster_id) for r in clustering.cluster(df, "MeanShift", most=3).collect()}
    want = {100 * b + i: (g, int(label)) for b, (g, own) in enumerate(groups.items()) for i, label in enumerate(ck.mean_shift(own))}
    assert found == want
    x, members = lc.vectors(df.where("grp = 'a'").selectExpr("*", "0 as g"), 4)
    assert x.count() == 9 and members.count() == 31 and x.agg({"c": "sum"}).first()[0] == 31


def test_near_pairs_equal_all_distances():
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (600, 13)), np.vstack((rng.normal(0, 1, (300, 13)), np.zeros((5, 13))))
    for width in (0.5, 3.0, 5.0):
        got = np.zeros((len(a), len(b)), bool)
        for i, j, hit in lc._near(a, b, width):
            got[np.ix_(i, j)] = hit
        assert (got == (lc._far(a, b) <= width)).all()


def test_blocks_without_a_near_pair(spark):
    """Blocks none of whose vectors are within a width give no rows, and the result is that of one task."""
    rng = np.random.default_rng(3)
    rows = [("a", i, k + 1, *map(float, p)) for i in range(12) for k, p in enumerate(np.cumsum(rng.normal(0, 900, (4 + i % 5, 3)), axis=0))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = lc.adaptive(df.selectExpr("*", "0 as g"), (0.05, 2.5), 10, block=2)
    want = clustering.adaptive_mean_shift(df, widths=(0.05, 2.5))
    assert sorted((r.track_id, r.cluster_id, round(r.score, 9)) for r in found.collect()) == sorted((r.track_id, r.cluster_id, round(r.score, 9)) for r in want.collect())


def test_blocks_are_few_and_large(spark, monkeypatch):
    """However many small blocks a group would have, its vectors go to a few large ones, which are compared in pieces."""
    rng = np.random.default_rng(5)
    rows = [("a", i, k + 1, *map(float, p)) for i in range(40) for k, p in enumerate(np.cumsum(rng.normal(0, 900, (4 + i % 5, 3)), axis=0))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 as g")
    assert lc.vectors(df, 2)[0].agg({"parts": "max"}).first()[0] == 4
    monkeypatch.setattr(lc, "HELD", 7)
    assert lc.vectors(df, 2)[0].agg({"parts": "max"}).first()[0] == 6
    monkeypatch.setattr(lc, "ACROSS", 37)
    a, b = rng.normal(0, 1, (300, 15)), rng.normal(0, 1, (400, 15))
    for width in (3.0, 6.0):
        got = np.zeros((len(a), len(b)), int)
        for i, j, hit in lc._near(a, b, width):
            assert hit.shape[1] <= 37
            got[np.ix_(i, j)] += 1 + hit
        assert ((got == 2) == (lc._far(a, b) <= width)).all() and got.max() == 2
