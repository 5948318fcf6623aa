"""The full analysis of one crowded cluster: hulls of all its points, and conflicts that are summed but not stored."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import kernels, workload
from trackweave.plans import analysis
from trackweave.sources.adapters import flights, trackpoints

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def case(spark):
    points = trackpoints(spark, DATA).where("track_id < 90").withColumn("t_abs", F.col("t_abs") % 7200)
    tracks = flights(spark, DATA).where("track_id < 90")
    members = tracks.select(F.lit(0).alias("cluster_id"), "track_id")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    found = analysis.analyse(points, tracks, members)
    return found, points.withColumn("cluster_id", F.lit(0)), [p for p in folder.iterdir() if p not in before]


def test_hull_of_all_points(case):
    found, points, _ = case
    p = np.array([tuple(r) for r in points.select("x", "y", "z").collect()])
    hull = found.hulls.first()
    vertices, _, volume = kernels.hull_3d(p)
    assert len(p) > 5000 and hull.volume == pytest.approx(volume, rel=1e-9) and {tuple(v) for v in hull.vertices} == {tuple(v) for v in vertices}
    inside = [sorted(map(tuple, workload.samples(points, found.sectors, h).select("track_id", "seq").collect())) for h in (None, found.hulls)]
    assert inside[0] == inside[1] and len(inside[0]) == len(p)


def test_conflicts_are_summed_and_not_stored(spark, case):
    found, _, stored = case
    assert len(stored) > 10 and not any("convergence" in spark.read.parquet(str(p)).columns for p in stored)
    rows = found.conflicts.collect()
    digest = {r.result: r for r in analysis.digest(found).where("result in ('conflicts', 'workload')").collect()}
    numbers = ("cluster_id", "bin", "track_a", "track_b", "horizontal_ft", "time", "vertical_ft", "convergence")
    assert len(rows) > 100 and found.workload.first().conflicts == digest["conflicts"].rows == len(rows)
    assert digest["conflicts"].numbers == len(rows) * len(numbers) and digest["conflicts"].characters == sum(len(r.severity) for r in rows)
    assert digest["conflicts"].total == pytest.approx(sum(r[c] for r in rows for c in numbers), rel=1e-9)
