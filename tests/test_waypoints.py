"""Limits of waypoints from the nearest points of tracks, against numpy; points meet waypoints without a row for each of both."""

import numpy as np

from trackweave.operators import procedure as pr


def test_limits_of_nearest_points(spark):
    rng = np.random.default_rng(8)
    p = [(c, 10 * c + t, i + 1, *(float(v) for v in rng.integers(0, 40, 3)), float(rng.integers(100, 200))) for c in (0, 1) for t in range(6) for i in range(20)]
    points = spark.createDataFrame(p, "cluster_id int, track_id long, seq long, x double, y double, z double, v double")
    centroid = spark.createDataFrame([(c, s, float(s), float(c), 0.0) for c in (0, 1) for s in range(9)], "cluster_id int, step int, x double, y double, z double")
    fixes = spark.createDataFrame([(0, "ENTRY", "ENTRY-0-1", 5.0, 5.0, 1.0)], "cluster_id int, kind string, name string, x double, y double, z double")
    out = pr.waypoints(centroid, fixes, points)
    rows = out.collect()
    assert len(rows) == 11
    place = {("ENTRY-0-1"): (5.0, 5.0)} | {f"C{c}-{s:02d}": (float(s), float(c)) for c in (0, 1) for s in (0, 2, 4, 6, 8)}
    for r in rows:
        x, y = place[r.waypoint_id]
        best = {}
        for c, t, i, px, py, pz, pv in p:
            if c == r.cluster_id:
                best[t] = min(best.get(t, (np.inf,)), ((px - x) ** 2 + (py - y) ** 2, i, pz, pv))
        z, v = (np.array([b[k] for b in best.values()]) for k in (2, 3))
        assert abs(r.alt_low_ft - max(0, z.mean() - 3 * z.std())) < 1e-9 and abs(r.alt_high_ft - z.mean() - 3 * z.std()) < 1e-9 and abs(r.speed_kt - np.quantile(v, 0.85)) < 1e-9
    # One grouping by (cluster, waypoint, track) would shuffle a row for each track and waypoint.
    assert "min_by" not in out._jdf.queryExecution().executedPlan().toString()
