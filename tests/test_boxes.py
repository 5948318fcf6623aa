"""The join of touching boxes against all pairs."""

import numpy as np

from trackweave.operators import sector
from trackweave.operators.boxes import touching

BOUNDS = ", ".join(f"{m}_{c} double" for c in "xyz" for m in ("min", "max"))


def boxes(n, seed, scale):
    rng = np.random.default_rng(seed)
    low = rng.uniform(-1000, 1000, (n, 3))
    size = np.exp(rng.uniform(-4, scale, (n, 3)))
    return [tuple(float(v) for k in range(3) for v in (a[k], a[k] + s[k])) for a, s in zip(low, size, strict=True)]


def touch(a, b):
    return all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (0, 2, 4))


def odd():
    inf = float("inf")
    return [(-inf, inf) * 3, (0.0, inf, -5.0, 5.0, -5.0, 5.0), (None, 1.0, 0.0, 1.0, 0.0, 1.0), (3.0, 3.0) * 3, (5.0, 3.0, 0.0, 10.0, 0.0, 10.0), (float("nan"), 1.0, 0.0, 1.0, 0.0, 1.0), (-1e250, 1e250, 0.0, 1.0, 0.0, 1.0)]


def test_pairs_equal_all_pairs_once(spark):
    left, right = boxes(400, 1, 6) + odd(), boxes(150, 2, 7) + odd() + [(3.0, 4.0, 3.0, 4.0, 3.0, 4.0)] * 2
    a = spark.createDataFrame([(i, *b) for i, b in enumerate(left)], f"cluster_id int, {BOUNDS}")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], f"id int, {BOUNDS}")
    whole = lambda x: None not in x and all(v == v for v in x)
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if whole(x) and whole(y) and touch(x, y))
    found = touching(a, b)
    assert sorted((r.a_cluster_id, r.b_id) for r in found.collect()) == want and len(want) > 300
    assert sorted((r.cluster_id, r.zone) for r in sector.zone_conflicts(a, b).collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert touching(a.where("false"), b).count() == 0 == touching(a, b.where("false")).count()


def test_many_boxes_and_zones_in_seconds(spark):
    n = 20_000
    side = lambda seed, c: f"(pmod(xxhash64(id, {seed}, '{c}'), 1000000) / 10D)"
    made = lambda seed, name: spark.range(n).selectExpr(f"id as {name}", *(f"{side(seed, c)} as min_{c}" for c in "xyz"), *(f"{side(seed, c)} + 200 + id % 7 * 100 as max_{c}" for c in "xyz"))
    pairs = touching(made(1, "cluster_id"), made(2, "id")).count()
    assert 0 < pairs < 100 * n


def test_trimmed_boxes_fold_only_touching_zones(spark):
    box = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0), (2, 50.0, 60.0, 0.0, 1.0, 0.0, 1.0)], f"cluster_id int, {BOUNDS}")
    zones = spark.createDataFrame([("b", -5.0, 2.0, -5.0, 20.0, -5.0, 20.0), ("a", 9.0, 20.0, -5.0, 20.0, -5.0, 20.0), ("c", 100.0, 200.0, 0.0, 1.0, 0.0, 1.0)], f"id string, {BOUNDS}")
    found = {r.cluster_id: (r.min_x, r.max_x, r.min_y, r.max_y) for r in sector.trimmed(box, zones).collect()}
    assert found == {1: (2.0, 9.0, 0.0, 10.0), 2: (50.0, 60.0, 0.0, 1.0)}
