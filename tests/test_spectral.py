"""Spectral clustering on blocks against numpy on one group in memory."""

import numpy as np
import plain
import pytest

from trackweave.operators import clustering, pair_kernels
from trackweave.operators import spectral as sp


SCHEMA = "grp string, track_id long, seq long, x double, y double, z double"


def walks(n, seed=0, least=1):
    rng = np.random.default_rng(seed)
    return [np.cumsum(rng.normal(0, 30, (int(k), 3)), axis=0) for k in rng.integers(least, 40, n)]


def bundles(seed=3):
    """Three shapes of tracks, ten of each."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, 30)[:, None]
    arc = lambda w: np.hstack((np.sin(w * t), np.cos(w * t), t)) * 4000
    out = []
    for w, turn in ((0.3, 1), (4.0, -1), (9.0, 1)):
        out += [arc(w)[::turn] + rng.normal(0, 3, (30, 3)) for _ in range(10)]
    return out


def frame(spark, groups):
    rows = [(g, i, k + 1, *map(float, p)) for g, tracks in groups.items() for i, t in enumerate(tracks) for k, p in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_stacked_measures_equal_the_plain_ones():
    tracks = walks(40) + [np.zeros((5, 3)), np.linspace(0, 1, 6)[:, None] * np.ones(3), np.zeros((2, 3)), np.cumsum(np.ones((100, 3)), axis=0)]
    a, b = tracks[:25] + tracks[40:], tracks[10:]
    own = {"curvature": plain.curvature_similarity, "spatial": plain.spatial_similarity, "shape": plain.shape_similarity, "polar": plain.polar_similarity, "multiscale": plain.multiscale_affinity}
    for name, f in pair_kernels.MEASURES.items():
        assert np.abs(f(a, b) - np.array([[own[name](x, y) for y in b] for x in a])).max() < 1e-12, name


def test_similarities_of_all_pairs(spark):
    tracks = walks(21, 4)
    found = {(r.i, r.j): r for r in clustering.similarities(frame(spark, {"g": tracks, "h": tracks[:3]}).where("grp = 'g'"), most=8).collect()}
    assert len(found) == 21 * 20 / 2
    for (i, j), r in found.items():
        assert i < j and r.polar == pytest.approx(plain.polar_similarity(tracks[i], tracks[j]), abs=1e-12)
        assert r.multiscale == pytest.approx(plain.multiscale_affinity(tracks[i], tracks[j]), abs=1e-12)


def test_eigenvalues_and_neighbours_equal_numpy(spark):
    groups = {"g": walks(75, 1, 5), None: walks(20, 2, 5), "one": walks(1, 3, 9)}
    tracks, sizes = sp.dealt(frame(spark, groups), "grp", 32)
    number = {r.grp: r.gid for r in sizes.collect()}
    near = sp.nearest(tracks, sizes, 5)
    links = {(r.gid, r.i, r.j): r.s for r in near.collect()}
    for pairs, dense in ((sp.affinity(tracks, sizes), lambda t: plain.matrix(t, plain.polar_similarity, 0.5)), (sp.mutual(near, 32), lambda t: plain.mutual(plain.matrix(t, plain.multiscale_affinity), 5))):
        values, vectors = sp.eigenvectors(pairs, tracks, 11)
        found = {r.gid: r["values"] for r in values.collect()}
        q = {g: np.vstack([np.frombuffer(r.q).reshape(r.n, -1) for r in sorted(vectors.where(f"gid = {number[g]}").collect(), key=lambda r: r.block)]) for g in groups}
        for g, own in groups.items():
            lap = plain.laplacian(dense(own))
            want = np.linalg.eigvalsh(lap)[:11]
            assert np.abs(np.array(found[number[g]]) - want).max() < 1e-6
            assert np.abs(lap @ q[g] - q[g] * want).max() < 1e-3 and np.allclose(q[g].T @ q[g], np.eye(len(want)), atol=1e-6)
    for g, own in groups.items():
        a = plain.matrix(own, plain.multiscale_affinity)
        for i in range(len(own)):
            order = [j for j in np.argsort(-a[i], kind="stable") if j != i][:5]
            assert {j for gid, x, j in links if gid == number[g] and x == i} == set(order)


def labels(spark, name, groups):
    found = clustering.cluster(frame(spark, groups), name, most=None).collect()
    assert not any(r.is_noise for r in found)
    return {g: [r.cluster_id for r in sorted(found, key=lambda r: r.track_id) if r.grp == g] for g in groups}


def test_spectral_labels_of_shapes(spark):
    own = bundles()
    label = labels(spark, "SCC", {"g": own, None: own, "one": own[:1], "two": own[:2]})
    assert same_partition(label["g"], plain.spectral(own)) and len(set(label["g"])) > 1
    assert label["g"] == label[None] and label["one"] == [0] and label["two"] == [0, 0]


def test_laplacian_labels_are_as_good_as_the_plain_ones(spark):
    own = bundles()
    label = labels(spark, "LSCC", {"g": own, None: own, "one": own[:1], "two": own[:2]})
    x = np.linalg.eigh(plain.laplacian(plain.mutual(plain.matrix(own, plain.multiscale_affinity), 10)))[1][:, :10]
    assert plain.silhouette(x, np.array(label["g"])) >= plain.silhouette(x, plain.laplacian_clusters(own)) - 0.03
    assert label["g"] == label[None] and label["one"] == [0] and label["two"] == [0, 0]


def test_silhouettes_and_means_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.4, (25, 3)) for c in (0, 3, 6)])
    rows = spark.createDataFrame([(0, b, 15, bytearray(x[b * 15 : b * 15 + 15].tobytes())) for b in range(5)], "gid long, block long, n int, q binary")
    sizes = spark.createDataFrame([(0, 75, 5)], "gid long, n long, parts long")
    centres = sp.kmeans(rows, spark.createDataFrame([(0, [2, 3, 4])], "gid long, ks array<int>"))
    labels = sp._labels(rows, centres)
    found = {r.k: r.silhouette for r in sp.silhouettes(rows, labels, sizes).collect()}
    for k in (2, 3, 4):
        own = np.array([r.label for r in sorted(labels.where(f"k = {k}").collect(), key=lambda r: (r.block, r.at))])
        assert found[k] == pytest.approx(plain.silhouette(x, own), abs=1e-9)
        cost = lambda own: sum(((x[own == c] - x[own == c].mean(axis=0)) ** 2).sum() for c in np.unique(own))
        assert cost(own) <= 1.05 * cost(plain.kmeans(x, k))
    assert max(found, key=found.get) == 3


def test_large_groups_go_to_features_unless_told_otherwise(spark):
    own = bundles()
    df = frame(spark, {"g": own, "few": own[:2]})
    found = {(r.grp, r.track_id): r.cluster_id for r in clustering.cluster(df, "SCC", most=5).collect()}
    assert len(found) == 32 and clustering.cluster(df.where("false"), "LSCC").count() == 0
