"""Hulls of all points by partial hulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import kernels, sector


def clusters():
    rng = np.random.default_rng(4)
    ball = rng.normal(size=(400, 3))
    return {
        1: rng.normal(size=(3000, 3)) * [5, 5, 1],
        2: np.c_[rng.normal(size=(300, 2)), np.zeros(300)],
        3: ball / np.linalg.norm(ball, axis=1)[:, None],
        4: np.repeat([[1.0, 2.0, 3.0]], 60, axis=0),
        5: np.array([[i, j, k] for i in range(6) for j in range(6) for k in range(6)], dtype=float),
        6: np.array([[0.0, 0, 0], [1, 1, 1], [3, 3, 3]]),
    }


def test_hulls_of_all_points(spark):
    rows = [(c, i // 20, i % 20, *map(float, p)) for c, points in clusters().items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "cluster_id int, track_id long, seq long, x double, y double, z double").repartition(6)
    found = {r.cluster_id: r for r in sector.hulls(df, None, chunk=50).collect()}
    assert found.keys() == clusters().keys()
    for c, p in clusters().items():
        r, whole = found[c], kernels.hull_3d(p)
        assert r.degenerate == (whole is None)
        for plane, axes in (("xy", [0, 1]), ("xz", [0, 2]), ("yz", [1, 2])):
            assert r[f"area_{plane}"] == pytest.approx(kernels.area_2d(p[:, axes]), rel=1e-9)
        if whole is not None:
            assert r.volume == pytest.approx(whole[2], rel=1e-9)
            corners, own = {tuple(v) for v in whole[0]}, {tuple(v) for v in r.vertices}
            # On a grid, points on a side may count as corners too.
            assert corners == own if c != 5 else {(i, j, k) for i in (0, 5) for j in (0, 5) for k in (0, 5)} <= own
    inside = {r.cluster_id: r["count"] for r in sector.inside_hull(df, sector.hulls(df, None, chunk=50), 1e-6).groupBy("cluster_id").count().collect()}
    assert inside == {c: len(p) for c, p in clusters().items()}


def test_hull_against_every_point_as_a_corner():
    rng = np.random.default_rng(7)
    p = rng.normal(size=(200, 3))
    vertices, planes, _ = kernels.hull_3d(p)
    assert (p @ planes[:, :3].T + planes[:, 3]).max() < 1e-9
    for v in vertices:
        off = planes[:, :3] @ v + planes[:, 3]
        assert (np.abs(off) < 1e-9).sum() >= 3
    assert (kernels.outermost(np.zeros((5, 3))) == 0).all()


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_points_meet_faces_as_arrays(spark, chunk):
    """Parts of a cluster of every size keep the same points, all columns with them; a flat hull holds none back, a missing one all."""
    rows = [(c, i, 0, *map(float, p)) for c, points in clusters().items() for i, p in enumerate(points)] + [(1, -1, 0, None, 0.0, 0.0), (2, -1, 0, None, 0.0, 0.0), (9, -1, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cluster_id int, track_id long, seq long, x double, y double, z double")
    small = df.where("cluster_id in (1, 2, 3) and track_id between 0 and 120")
    hull = sector.hulls(small, None)
    got = sector.inside_hull(df, hull, 0.25, chunk=chunk)
    assert got.schema == df.schema
    planes = {r.cluster_id: np.array(r.equations).reshape(-1, 4) for r in hull.collect()}
    want = {(r[0], r[1]) for r in rows if r[0] in planes and (not len(planes[r[0]]) or (r[3] is not None and (planes[r[0]][:, :3] @ np.array(r[3:], float) + planes[r[0]][:, 3] <= 0.25).all()))}
    found = [(r.cluster_id, r.track_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and 0 < sum(c == 1 for c, _ in want) < 3000
    assert "ArrayForAll" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "forall" not in plan


def test_faces_made_of_the_points_themselves(spark):
    """Faces that are worked out from the points that meet them have the points' own column of clusters."""
    rows = [(c, i, 0, float(i), float(c), 0.0) for c in range(3) for i in range(10 + c)]
    tracks = spark.createDataFrame([(i, c) for c in range(3) for i in range(10 + c)], "track_id long, cluster_id int")
    df = spark.createDataFrame([(i, c, x, y, z) for c, i, _, x, y, z in rows], "track_id long, own int, x double, y double, z double")
    df = df.join(tracks, (df.track_id == tracks.track_id) & (df.own == tracks.cluster_id)).select("cluster_id", "own", "x", "y", "z")
    faces = df.groupBy("cluster_id").agg(F.max("x").alias("m")).select("cluster_id", F.expr("array(array(1D, 0D, 0D, 4D - m))").alias("equations"))
    found = sector.inside_hull(df, faces, 0.5, chunk=4).groupBy("cluster_id").count().collect()
    assert {r.cluster_id: r["count"] for r in found} == {0: 6, 1: 7, 2: 8}


def test_points_meet_only_the_planes_near_them():
    """Leaves of points against all planes one by one, with places that aren't numbers, on both sides of every plane."""
    rng = np.random.default_rng(12)
    ball = rng.normal(size=(150, 3))
    _, planes, _ = kernels.hull_3d(ball)
    p = np.vstack((rng.normal(size=(5000, 3)), ball, np.zeros((300, 3)), [[np.nan, 0, 0], [0, np.inf, 0]]))
    with np.errstate(invalid="ignore"):
        for buffer in (-0.3, 0.0, 1e-9, 0.5):
            want = np.ones(len(p), bool)
            for a, b, c, d in planes:
                want &= a * p[:, 0] + b * p[:, 1] + c * p[:, 2] + d <= buffer
            assert (kernels.within(p, planes, buffer) == want).all() and 0 < want.sum() < 5450
    assert kernels.within(p, np.zeros((0, 4)), 0.0).all() and not len(kernels.within(p[:0], planes, 0.0))


def test_hulls_with_many_corners_are_fast():
    """A hull nearly all of whose points are corners: the planes aren't made anew for each, nor are all points looked at after every few."""
    from time import perf_counter

    q = np.random.default_rng(0).normal(size=(3000, 3))
    q /= np.linalg.norm(q, axis=1)[:, None]
    start = perf_counter()
    vertices, planes, volume = kernels.hull_3d(q)
    assert perf_counter() - start < 4.0 and len(vertices) == 3000 and len(planes) == 5996 and volume == pytest.approx(4.1719285854338, rel=1e-9)
