"""Readers, kernels and operators on hand-made tracks."""

import itertools
import json
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import cluster_kernels as ck
from trackweave.operators import clustering, geometry, graph, kernels, procedure, rules, runway, sector, selection, workload
from trackweave.sources import radar, sinks
from trackweave.streaming.occupancy import occupancy

POINTS = "31613,-38144,251,45,0 31336,-38150,261,45,4 31032,-38169,269,47,9 30714,-38202,273,49,18 30405,-38251,272,50,23 30099,-38312,265,50,27 29785,-38383,257,49,32 29483,-38457,251,48,41 29217,-38528,246,47,46 28986,-38594,242,46,50 28771,-38659,231,45,55 28562,-38727,218,45,60".split()
SHORT = ["0", "01/01/2006", "00:01:04", "00:02:04", "SJC", "CALSTR5", "HELO", "H", "0365", "A", "30L", "715", "925", "166925", "173507"]
FULL = ["7", "01/02/2006", "010203", "00:02:04", "SJC", "X1", "", "B747", "HEAVY", "0365", "A", "WP", "nan", "30R", "-5", "925", "1", "2"]


def lt6(*blocks):
    return "\n".join(line for b in blocks for line in b)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("radar")
    one = lt6(["TRACK 12607553", *SHORT, "12", *POINTS])
    two = lt6(["TRACK 1", *FULL, *POINTS[:3], "1,2,3,4", "a,b,c,d,e"], ["TRACK 2", *SHORT, "99", *POINTS[:2]], ["TRACK 3", "odd", "shape", "1,2,3,4,5"], ["TRACK 1", *FULL, "2", *POINTS[:4]])
    (f / "20060101.lt6").write_text(one)
    (f / "20060102.lt6").write_text(two)
    (f / "notes.txt").write_text("TRACK 9")
    with zipfile.ZipFile(f / "days.zip", "w") as z:
        z.writestr("20060102.lt6", two)
        z.writestr("20060101.lt6", one)
        z.writestr("readme.md", "x")
    return str(f)


def test_files(spark, folder):
    raw = radar.read_tracks(spark, "files", folder)
    t = {r.track_id: r for r in radar.tracks(raw).collect()}
    assert set(t) == {"12607553_0", "1_7", "2_0", "3_0"}
    assert t["12607553_0"].runwayname == "30L" and t["12607553_0"].min_alt == 715 and t["12607553_0"].owner_name is None
    assert str(t["12607553_0"].trackstart_date) == "2006-01-01"
    assert t["1_7"].copies == 2 and len(t["1_7"].lines) == 2 and t["1_7"].min_alt is None and t["1_7"].owner_name is None
    assert t["3_0"].corrupt is not None
    n = {r.track_id: r["count"] for r in radar.trackpoints(radar.tracks(raw)).groupBy("track_id").count().collect()}
    assert n == {"12607553_0": 12, "1_7": 2, "2_0": 2}


def test_archives(spark, folder):
    assert [r.member for r in radar.archive_members(radar.archive_files(spark, folder)).collect()] == ["20060101.lt6", "20060102.lt6"]
    assert radar.read_tracks(spark, "archive", folder, members=["20060101.lt6", "missing.lt6"]).count() == 1
    assert radar.read_tracks(spark, "range", folder, first=1, last=5).count() == 5
    with pytest.raises(ValueError):
        radar.read_tracks(spark, "mongo", folder)


def test_broken_members_are_corrupt_blocks(spark):
    import io

    def packed(**how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", **how) as z:
            for day in (1, 2):
                z.writestr(f"2006010{day}.lt6", lt6([f"TRACK {day}", *SHORT, "12", *POINTS] * 20))
        return bytearray(out.getvalue())

    torn, whole, odd = packed(compression=zipfile.ZIP_DEFLATED), packed(), packed(compression=zipfile.ZIP_BZIP2)
    torn[60:90] = b"x" * 30
    files = spark.createDataFrame([("a/torn.zip", torn), ("a/whole.zip", whole), ("odd.zip", odd), ("none.zip", bytearray(b"no archive"))], "path string, content binary")
    found = {(r.source_file, r.corrupt is not None): r.opnum for r in radar.archive_blocks(files.repartition(2)).collect()}
    assert found == {("torn.zip/20060101.lt6", True): None, ("torn.zip/20060102.lt6", False): "2", ("whole.zip/20060101.lt6", False): "1", ("whole.zip/20060102.lt6", False): "2", ("odd.zip/20060101.lt6", False): "1", ("odd.zip/20060102.lt6", False): "2", ("none.zip", True): None}


def test_load_order_follows_the_list(spark, folder):
    raw = radar.read_tracks(spark, "files", folder)
    first = lambda order: [r.source_file for r in radar.tracks(raw, order).orderBy("load_seq").collect()]
    assert first(None) == ["20060101.lt6"] + ["20060102.lt6"] * 3
    assert first(["20060102.lt6", "missing.lt6"]) == ["20060102.lt6"] * 3 + ["20060101.lt6"]


def test_points_without_a_count(spark):
    rows = list(radar.blocks("f", lt6(["TRACK 5", *FULL, *POINTS[:3], "1,2,3,4"])))
    assert rows[0]["count"] is None and len(rows[0]["lines"]) == 4


def test_zones(spark, tmp_path):
    b = {f"{m}_{c}": float(i) for i, (c, m) in enumerate(itertools.product("xyz", ("min", "max")))}
    (tmp_path / "z.json").write_text(json.dumps({"restricted_zones": [{"id": "A", "name": "n", "bounds": b}, {"bounds": {"min_x": 1}}]}))
    got = radar.zones(spark, str(tmp_path / "z.json")).collect()
    assert [r.id for r in got] == ["A", "unknown"] and got[1].max_x is None
    assert radar.zones(spark, str(tmp_path / "none.json")).count() == 0


@pytest.fixture(scope="module")
def sample(spark):
    rows = [("s", i + 1, *map(float, p.split(","))) for i, p in enumerate(POINTS)]
    return spark.createDataFrame(rows, "track_id string, seq long, x double, y double, z double, v double, t double")


def test_sample_track(sample):
    first = lambda df: df.first()
    assert first(geometry.path_length(sample)).length_3d == pytest.approx(3120.339539)
    assert first(geometry.path_length(sample)).length_int == 3113
    d = first(geometry.direction(sample))
    assert (d.ux, d.uy, d.uz) == pytest.approx((-0.982173, -0.187678, -0.010623), abs=1e-6)
    assert first(geometry.mean_curvature(sample)).mean_curvature == pytest.approx(0.032671621)
    t = first(geometry.turn_bank_profile(sample))
    assert (t.min_radius, t.max_radius, t.max_bank) == pytest.approx((5872.715483, 17654.859319, 2.073138), abs=1e-5)
    assert first(geometry.descent_gradient(sample)).gradient == pytest.approx(0.010623907)
    assert first(geometry.glide_angle(sample)).glide_deg == pytest.approx(0.506778912)
    assert first(geometry.acceleration_max(sample)).max_acceleration == pytest.approx(5.435135806)
    assert geometry.segment_gradients(sample).agg(F.max("gradient")).first()[0] == pytest.approx(0.059148987)
    assert kernels.plane_residual(np.array([[float(v) for v in p.split(",")[:3]] for p in POINTS])) == pytest.approx(3.819879124)


def test_sample_rules(spark, sample):
    tracks = spark.createDataFrame([("s", "H")], "track_id string, aircraft_category string")
    c = rules.category(sample, tracks)
    assert c.first().category == "A"
    assert rules.descent(sample, c).first().below == pytest.approx(128.522497)
    s = rules.speeds(sample, c).first()
    assert (s.final, s.middle) == (46.0, 50.0)
    found = rules.risks(sample, tracks, with_plane=False).collect()
    assert [(r.type, r.severity) for r in found] == [("PROFILE", "HIGH")]
    assert rules.rollup(rules.risks(sample, tracks, with_plane=False), tracks).first().max_severity == "HIGH"


def test_sample_arrival(spark, sample):
    tracks = spark.createDataFrame([("s", 1, "30L", "H", "HELO", "00:01:04")], "track_id string, load_seq long, runwayname string, aircraft_category string, aircrafttype string, trackstart_time string")
    a = runway.arrivals(sample, tracks, spark.createDataFrame([("s", 0)], "track_id string, cluster_id int")).first()
    assert (a.eta, a.optimal_eta) == pytest.approx((124.0, 79.406254), abs=1e-5)


def test_degenerate_tracks(spark):
    rows = [("one", 1, 1.0, 1.0, 1.0, 1.0, 0.0), *(("same", i, 2.0, 2.0, 2.0, 5.0, 0.0) for i in (1, 2, 3))]
    df = spark.createDataFrame(rows, "track_id string, seq long, x double, y double, z double, v double, t double")
    for f in (geometry.path_length, geometry.glide_angle, geometry.whole_number_profile, geometry.curvature_radius, geometry.kinematics, geometry.mean_curvature, geometry.acceleration_max, geometry.direction, geometry.velocities, geometry.duration, geometry.minimum_jerk, geometry.chord_distance):
        assert f(df).count() >= 2
        assert f(df.limit(0)).count() == 0
    assert geometry.turn_bank_profile(df).count() == 0
    assert geometry.resample(df, 4).groupBy("track_id").count().collect()[0]["count"] == 4
    assert geometry.bounds(df.limit(0)).first().min_x == 0


def test_schedule_equals_the_recursion(spark):
    rng = random.Random(0)
    rows = [(f"t{i}", 0, i, r, 0.0, float(rng.randint(0, 4000)), float(rng.randint(0, 4000)), 0.0, rng.choice(["heavy", "medium"])) for r in ("09", "30L", "30R") for i in range(25)]
    df = spark.createDataFrame(rows, "track_id string, cluster_id int, load_seq long, runway string, start double, eta double, optimal_eta double, delay double, wake string")
    got = {(r.runway, r.number): r for r in runway.sequence(df).collect()}
    for r in ("09", "30L", "30R"):
        now = None
        for k in range(1, 26):
            g = got[r, k]
            now = g.eta if now is None else max(g.eta, now + g.required)
            assert g.scheduled == pytest.approx(now)


def test_schedule_across_empty_slots_and_without_eta(spark):
    rows = [(i, "09", float(v) if v is not None else None, w) for i, (v, w) in enumerate([(None, "medium"), (0, "heavy"), (0, "medium"), (10, "medium"), (59, "heavy"), (61, "medium"), (700, "heavy"), (5000, "medium"), (5001, "medium")])]
    df = spark.createDataFrame(rows, "load_seq long, runway string, eta double, wake string").withColumns({"track_id": F.col("load_seq"), "optimal_eta": -F.col("eta")})
    got = sorted(runway.sequence(df).collect(), key=lambda r: r.number)
    assert [r.load_seq for r in got] == list(range(9)) and got[0].scheduled is None
    c, best, lead = 0, None, None
    for r in got:
        need = 180 if lead is not None and lead.wake == "heavy" and r.wake != "heavy" else 120
        c += 0 if lead is None else need
        if r.eta is not None:
            best = r.eta - c if best is None else max(best, r.eta - c)
            assert r.required == need and r.scheduled == pytest.approx(c + best)
            assert r.overtaking == (lead is not None and lead.eta is not None and r.eta > lead.eta)
        lead = r
    assert runway.sequence(df.limit(0)).count() == 0


def test_reassignment_is_optimal(spark):
    rows = [(f"a{i}", 0, i, "30L", 0.0, 100.0 * i, 0.0, 0.0, "medium") for i in range(6)] + [("b", 0, 9, "30R", 0.0, 5000.0, 0.0, 0.0, "medium")]
    df = spark.createDataFrame(rows, "track_id string, cluster_id int, load_seq long, runway string, start double, eta double, optimal_eta double, delay double, wake string")

    def late(etas):
        out, now = 0.0, None
        for e in sorted(etas):
            now = e if now is None else max(e, now + 120)
            out += now - e
        return out

    best = min(late([100.0 * i for i in range(6) if not m >> i & 1]) + late([100.0 * i for i in range(6) if m >> i & 1] + [5000.0]) + 45 * bin(m).count("1") for m in range(64))
    plan = runway.reassignment(df, overload=0.1, movable=6).where("source = '30L'").collect()
    assert (plan[0].cost if plan else late([100.0 * i for i in range(6)])) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(4))
def test_reassignment_equals_all_masks(spark, seed):
    """Costs of all masks by the recursion; arrivals with one eta, heavy aircraft, movable ones amid the others, and without an eta."""
    rng = random.Random(seed)
    rows = [(f"a{i}", 0, i, "30L", 0.0, float(rng.randrange(0, 5000, 50)), 0.0, 0.0, rng.choice(["heavy", "medium"])) for i in range(40)]
    rows += [(f"b{i}", 0, 100 + i, "30R", 0.0, float(rng.randrange(0, 9000, 50)), 0.0, 0.0, rng.choice(["heavy", "medium"])) for i in range(30 if seed else 0)]
    rows += [("b", 0, 200, "30R", 0.0, 8000.0, 0.0, 0.0, "heavy"), ("n", 0, 300, "30L", 0.0, None, 0.0, 0.0, "heavy")]
    df = spark.createDataFrame(rows, "track_id string, cluster_id int, load_seq long, runway string, start double, eta double, optimal_eta double, delay double, wake string")
    own = sorted((r for r in rows if r[3] == "30L" and r[5] is not None), key=lambda r: -r[2])
    fixed, last, there = own[5:], own[:5], [r for r in rows if r[3] == "30R"]

    def late(these):
        out, now, lead = 0.0, None, None
        for r in sorted(these, key=lambda r: (r[5], r[2])):
            now = r[5] if now is None else max(r[5], now + (180 if lead == "heavy" and r[8] != "heavy" else 120))
            out, lead = out + now - r[5], r[8]
        return out

    def cost(m):
        moved = [r for k, r in enumerate(last) if m >> k & 1]
        hours = Counter(r[5] // 3600 for r in there + moved)
        return late(fixed + [r for r in last if r not in moved]) + late(there + moved) + 45 * len(moved) + 1000 * max(0.0, min(1.5, max(hours.values()) / 36) - 0.85)

    best = min(range(32), key=lambda m: (round(cost(m), 6), m.bit_count(), m))
    plan = [r for r in runway.reassignment(df, overload=0.1, movable=5).collect() if r.source == "30L"]
    assert [(r.target, round(r.cost, 4), r.moved) for r in plan] == [("30R", round(cost(best), 4), sorted(r[0] for k, r in enumerate(last) if best >> k & 1))]


def test_hull():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(200, 3))
    v, eq, volume = kernels.hull_3d(p)
    assert (eq[:, :3] @ p.T + eq[:, 3:] <= 1e-6).all() and 0 < volume < np.prod(np.ptp(p, axis=0))
    cube = np.array(list(itertools.product((0.0, 2.0), repeat=3)))
    assert kernels.hull_3d(np.vstack((cube, [[1, 1, 1]])))[2] == pytest.approx(8)
    assert kernels.hull_3d(np.c_[p[:, :2], np.zeros(200)]) is None and kernels.area_2d(cube[:, :2]) == pytest.approx(4)
    assert sorted(kernels.footprint(cube[:, 1:])) == [[0, 0], [0, 2], [2, 0], [2, 2]]
    assert kernels.area_2d(np.array([[0.0, 0.0], [2.0, 2.0], [1.0, 1.0]])) == 4


def test_profile_model_and_smoothing(spark):
    t = np.linspace(0, 1, 20)
    base = np.column_stack((t * 1e4, t**2 * 5e3, 3000 - t * 2000))
    tracks = base + np.random.default_rng(1).normal(0, 50, (9, 20, 3))
    tracks[8] += 5e4
    assert np.allclose(kernels.smooth(base, 5)[0], base, atol=1e-4)
    assert np.allclose(kernels.lerp(base, 7)[:, 0], np.interp(np.linspace(0, 1, 7), t, base[:, 0]))
    rows = [(c, i, k, *map(float, p)) for c, own in ((0, tracks), (1, tracks[:3])) for i, line in enumerate(own) for k, p in enumerate(line)]
    steps = spark.createDataFrame(rows, "cluster_id int, track_id long, step int, x double, y double, z double")

    def wanted(own, sigma):
        latent = np.median(own, axis=0)
        for _ in range(10):
            d2 = ((own - latent) ** 2).sum(axis=2)
            w = np.exp(-d2 / (2 * sigma**2))
            new = np.where((w.sum(axis=0) < 1e-6)[:, None], latent, (w[:, :, None] * own).sum(axis=0) / np.maximum(w.sum(axis=0), 1e-12)[:, None])
            change, latent = np.linalg.norm(new - latent) / (np.linalg.norm(latent) + 1e-8), new
            if change < 1e-3:
                break
        return kernels.smooth(latent, 5)[0]

    for sigma in (120.0, 2.0, None):
        got = {(r.cluster_id, r.step): (r.x, r.y, r.z) for r in procedure.modelled(steps, sigma).collect()}
        line = np.array([got[0, k] for k in range(20)])
        assert np.abs(line - base).max() < 150 if sigma != 2.0 else True
        if sigma:
            assert np.allclose(line, wanted(tracks, sigma), rtol=1e-6, atol=1e-3)
        assert np.allclose([got[1, k] for k in range(20)], np.median(tracks[:3], axis=0))


def test_plane_residuals(spark):
    rng, rows, want = np.random.default_rng(0), [], {}
    for t in range(30):
        n = int(rng.integers(1, 60))
        p = rng.normal(size=(n, 3)) * rng.choice([10, 300, 1e4], 3) + rng.normal(size=3) * 1e5
        p = np.outer(np.arange(n), [1, 2, 3.0]) if t % 7 == 0 else np.ones((n, 3)) if t % 11 == 0 else p
        want[t] = kernels.plane_residual(p)
        rows += [(t, *map(float, q)) for q in p]
    got = {r.track_id: r.residual for r in rules.plane_residuals(spark.createDataFrame(rows, "track_id long, x double, y double, z double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-3 * max(1, want[t]) for t in want)


def test_samples_inside_hulls(spark):
    """Against the box and every face, with and without a hull, for a cluster without a box too."""
    rng = np.random.default_rng(2)
    rows = [(c, 10 * c + i, k + 1, *map(float, rng.uniform(-100, 100, 3)), 0.0, float(k), float(k)) for c in (0, 1, 2) for i in range(4) for k in range(25)]
    points = spark.createDataFrame(rows, "cluster_id int, track_id long, seq long, x double, y double, z double, v double, t double, t_abs double")
    boxes = spark.createDataFrame([(c, -90.0, 90.0, -90.0, 90.0, -90.0, 90.0) for c in (0, 1)], "cluster_id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    faces = [[0.6, 0.8, 0.0, -30.0], [0.0, 0.0, -1.0, -20.0]]
    hull = spark.createDataFrame([(0, faces), (2, faces)], "cluster_id int, equations array<array<double>>")
    got = {(r.track_id, r.seq) for r in workload.samples(points, boxes, hull, 5.0).collect()}
    want = {(t, s) for c, t, s, *p, _, _, _ in rows if c < 2 and max(map(abs, p)) <= 90 and (c == 1 or all(np.dot(f[:3], p) + f[3] <= 5 for f in faces))}
    assert got == want and len(want) > 50


def two_bundles():
    rng = np.random.default_rng(3)
    line = np.linspace(0, 1, 25)[:, None]
    one = [np.hstack((line * 1e4, line * 2e3, 3000 - line * 1000)) + rng.normal(0, 20, (25, 3)) for _ in range(8)]
    two = [np.hstack((1e4 - line * 1e4, line * 9e3, 1000 + line * 1000)) + rng.normal(0, 20, (25, 3)) for _ in range(7)]
    return one + two


def test_clusterings_find_bundles():
    tracks = two_bundles()
    label = ck.mean_shift(tracks)
    assert not set(label[:8]) & (set(label[8:]) - {-1})
    assert ck.mean_shift([]).tolist() == []


def test_cluster_operator(spark):
    rows = [("g", i, k + 1, *map(float, p)) for i, t in enumerate(two_bundles()) for k, p in enumerate(t)]
    df = spark.createDataFrame(rows, "grp string, track_id long, seq long, x double, y double, z double")
    out = clustering.cluster(df, "MLESAC")
    assert out.count() == 15
    with pytest.raises(ValueError):
        clustering.cluster(df, "Nothing")


def test_mean_shift_of_a_large_group_equals_the_kernel(spark):
    from trackweave.operators import large_clusters as lc

    rng = np.random.default_rng(8)
    own = two_bundles() + [np.cumsum(rng.normal(0, 900, (int(rng.integers(3, 12)), 3)), axis=0) for _ in range(12)]
    rows = [("g", i, k + 1, *map(float, p)) for i, t in enumerate(own) for k, p in enumerate(t)]
    df = spark.createDataFrame(rows, "grp string, track_id long, seq long, x double, y double, z double")
    x, n, parts = lc.features(df, 8)
    assert (n, parts) == (27, 4)
    for width in (0.3, 2.0, None):
        w = lc.width_of(x, n, parts, 0.2) if width is None else width
        got = {r.track_id: r.cluster_id for r in lc.shifted(x, parts, w).collect()}
        assert [got[i] for i in range(27)] == ck.mean_shift(own, width=width).tolist()
    whole, large = (sorted(map(tuple, clustering.adaptive_mean_shift(df, widths=(0.1, 0.5, 1.5), most=m).collect())) for m in (700, 3))
    assert [r[:3] for r in whole] == [r[:3] for r in large] and whole[0][3] == pytest.approx(large[0][3])


def test_groups_are_whole(spark):
    from trackweave.plans.catalog import QUERIES

    found = QUERIES["mean_shift_clusters"](spark, "/root/testdata/sf0.01").groupBy("grp").count().collect()
    assert sorted((r.grp, r["count"]) for r in found) == [("OAK", 50), ("SFO", 50), ("SJC", 50)]
    compared = {r.algorithm for r in QUERIES["algorithm_comparison"](spark, "/root/testdata/sf0.001").collect()}
    assert {"RANSAC", "MLESAC", "SCC", "LSCC"} <= compared <= {*clustering.WHOLE, *clustering.ALGORITHMS}


def test_arinc_rows_and_geojson_agree(spark):
    from trackweave.plans.catalog import QUERIES

    lines = {}
    for r in sorted(QUERIES["arinc"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.procedure_id, r.seq)):
        assert r.waypoint_id and r.alt_low_ft <= r.alt_high_ft and -90 <= r.lat <= 90 and -180 <= r.lon <= 180
        lines.setdefault(r.procedure_id, []).append((r.lon, r.lat, r.z))
    features = [json.loads(r.feature) for r in QUERIES["geojson"](spark, "/root/testdata/sf0.001").collect()]
    assert lines and {f["properties"]["procedure_id"] for f in features} == set(lines)
    for f in features:
        assert f["type"] == "Feature" and f["geometry"]["type"] == "LineString"
        assert np.allclose(f["geometry"]["coordinates"], lines[f["properties"]["procedure_id"]], atol=1e-5)


def test_large_groups(spark):
    rows = [("g", i, k + 1, *map(float, p)) for i, t in enumerate(two_bundles()) for k, p in enumerate(t)]
    df = spark.createDataFrame(rows, "grp string, track_id long, seq long, x double, y double, z double")
    whole = sorted(map(tuple, clustering.similarities(df).collect()))
    assert len(whole) == 105
    assert np.allclose(whole, sorted(map(tuple, clustering.similarities(df, most=6).collect())))
    label = {r.track_id: r.cluster_id for r in clustering.cluster(df, "SCC", most=3).collect()}
    assert len(label) == 15 and len({label[i] for i in range(8)} | {label[i] for i in range(8, 15)}) == 2


def test_pairs_of_large_groups(spark):
    from trackweave.operators import similarity

    rng = np.random.default_rng(4)
    rows = [(i % 2, i, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, vec_id long, vector array<double>")
    whole = sorted(map(tuple, similarity.cosine_pairs(df).collect()))
    assert len(whole) == 2 * 30 * 29 // 2
    assert whole == sorted(map(tuple, similarity.cosine_pairs(df, most=7).collect()))
    a, b = ({r.label: r.bandwidth for r in similarity.bandwidth(df, most=n).collect()} for n in (7, 5000))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_many_zones_and_centres(spark):
    bounds = [f"{m}_{c}" for c in "xyz" for m in ("min", "max")]
    box = spark.createDataFrame([(1, *[0.0, 1e6] * 3)], ["cluster_id", *bounds])
    zones = spark.range(10_001).select("id", *((F.col("id") * 10.0 + (5.0 if b[:3] == "max" else 0.0)).alias(b) for b in bounds))
    assert sector.zone_conflicts(box, zones).count() == 10_001
    centre = spark.range(120_000).select(F.col("id").cast("int").alias("cluster_id"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = {(r.gx, r.gy): r.cluster_id for r in clustering.zones_of(centre, 4).collect()}
    assert got[3, 3] == round(119_999 * 3.5 / 4) and len(got) == 16


def test_a_failing_algorithm_keeps_the_others(spark, monkeypatch):
    def fails(points, group):
        raise ValueError("no lines today")

    monkeypatch.setitem(clustering.WHOLE, "RANSAC", fails)
    rows = [("g", i, k + 1, *map(float, p)) for i, t in enumerate(two_bundles()[:6]) for k, p in enumerate(t)]
    df = spark.createDataFrame(rows, "grp string, track_id long, seq long, x double, y double, z double").withColumn("t", F.col("seq").cast("double"))
    found = {r.algorithm: r for r in clustering.compare(df, ("RANSAC", "MLESAC")).collect()}
    assert found["RANSAC"].error == "no lines today" and found["RANSAC"].clusters is None
    assert found["MLESAC"].error is None and found["MLESAC"].tracks > 0
    text = {r.place: r.line for r in sinks.algorithm_lines(clustering.compare(df, ("RANSAC", "MLESAC"))).collect()}
    assert text["RANSAC"] == "RANSAC: error: no lines today" and text["MLESAC"].startswith("MLESAC: clusters ")
    assert clustering.best_algorithm(clustering.compare(df, ("RANSAC", "MLESAC"))).first().algorithm == "MLESAC"


def test_hypothesis_of_a_sample(spark):
    from trackweave.operators import similarity

    df = spark.createDataFrame([("a", i, [1.0, float(i)]) for i in range(40)] + [("b", 1, [0.0, 2.0])], "label string, vec_id long, vector array<double>")
    out = {r.label: r for r in similarity.hypothesis(df, 5, seed=1).collect()}
    again = {r.label: r for r in similarity.hypothesis(df.repartition(6), 5, seed=1).collect()}
    assert out == again and out["b"].sample == [1] and len(out["a"].sample) == 5
    assert out["b"].reference == pytest.approx([0.0, 1.0], abs=1e-6)
    own = np.array([[1.0, i] for i in out["a"].sample])
    mean = (own / np.linalg.norm(own, axis=1, keepdims=True)).mean(axis=0)
    assert out["a"].reference == pytest.approx((mean / np.linalg.norm(mean)).tolist(), abs=1e-6)


def test_adaptive_mean_shift_takes_bandwidths(spark):
    rows = [("g", i, k + 1, 1000.0 * k, 300.0 * k * (i // 5), 50.0 * k) for i in range(10) for k in range(10)]
    df = spark.createDataFrame(rows, "grp string, track_id long, seq long, x double, y double, z double")
    found = {r.track_id: (r.cluster_id, r.score) for r in clustering.adaptive_mean_shift(df).collect()}
    assert len({found[i][0] for i in range(5)}) == len({found[i][0] for i in range(5, 10)}) == 1 and found[0][0] != found[5][0]
    assert abs(found[0][1] - 0.7) < 1e-9


@pytest.mark.parametrize("spread", [1.5, 4.0, 30.0])
def test_eps_components_equal_all_pairs(spark, spread):
    rng = np.random.default_rng(int(spread))
    crowd = np.vstack((rng.normal(0, spread, (150, 3)), rng.normal(0, 0.4, (150, 3)), rng.normal(0, 0.3, (150, 3)) + [2.6, 0, 0]))
    group = rng.integers(0, 2, len(crowd))
    rows = [(f"g{g}", f"n{i:04}", *map(float, p)) for i, (g, p) in enumerate(zip(group, crowd, strict=True))] + [("g0", "n9", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, node string, x double, y double, z double")
    got = {r.node: r.comp for r in sector.eps_components(df, ["g"], 1.0).collect()}
    near = (((crowd[:, None] - crowd[None]) ** 2).sum(axis=2) <= 1.0) & (group[:, None] == group[None])
    label = np.arange(len(crowd))
    while (new := np.where(near, label[None], len(crowd)).min(axis=1)).tolist() != label.tolist():
        label = new
    assert got == {f"n{i:04}": f"n{c:04}" for i, c in enumerate(label)} | {"n9": "n9"}


def test_components_and_eps(spark):
    rng = random.Random(2)
    rows = [(f"n{i:03d}", "k", rng.random() * 30, rng.random() * 30, 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "node string, g string, x double, y double, z double")
    got = {r.node: r.comp for r in sector.eps_components(df, ["g"], 2.0).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in itertools.combinations(rows, 2):
        if (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 4:
            x, y = sorted((root(a[0]), root(b[0])))
            parent[y] = x
    assert got == {r[0]: root(r[0]) for r in rows}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert graph.components(chain).select("comp").distinct().collect()[0].comp == 0


def test_conflicts_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(0, f"t{i}", k, rng.uniform(0, 9e4), rng.uniform(0, 9e4), rng.uniform(0, 3e3), rng.uniform(-300, 300), rng.uniform(-300, 300), 0.0, float(rng.randint(0, 240))) for i in range(20) for k in range(8)]
    df = spark.createDataFrame(rows, "cluster_id int, track_id string, seq long, x double, y double, z double, vx double, vy double, vz double, t_abs double")
    got = {(r.bin, r.track_a, r.track_b) for r in workload.conflicts(df).collect()}
    want = set()
    for a, b in itertools.combinations(rows, 2):
        a, b = sorted((a, b), key=lambda r: r[1])
        if a[1] != b[1] and a[9] // 60 == b[9] // 60 and abs(a[5] - b[5]) <= 1000 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 18228**2:
            if -sum((b[3 + i] - a[3 + i]) * (b[6 + i] - a[6 + i]) for i in range(3)) > 0:
                want.add((a[9] // 60, a[1], b[1]))
    assert got == want and got <= {(r.bin, r.track_a, r.track_b) for r in workload.conflicts(df, sliding=True).collect()}


def test_selection(spark):
    t = spark.createDataFrame([(i, i, " NaN " if i % 2 else "30L") for i in range(103)], "track_id long, load_seq long, runwayname string")
    for k in (1, 2, 7, 40, 103, 200):
        want = list(range(103)) if k >= 103 else sorted({int(v) for v in np.linspace(0, 102, k)})
        assert sorted(r.track_id for r in selection.even_tracks(t, k).collect()) == want
    assert t.select(selection.clean("runwayname").alias("r")).distinct().count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5), (2, 1.5)], "cluster_id int, workload double")
    report = sinks.json_report("2026-01-01", "full", clusters=rows)
    assert len(json.loads(report.first().report)["results"]["clusters"]) == 2
    assert "CLUSTERS" in sinks.text_report(report)
    sinks.write_cluster_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("sep", ";").csv(str(tmp_path / "c"), header=True).count() == 2


def test_streaming_occupancy(spark, tmp_path):
    rows = [(0, i % 3, f"2026-01-01 00:{m:02d}:00") for i, m in enumerate([0, 1, 2, 3, 6, 7, 30, 59])]
    spark.createDataFrame(rows, "cluster_id int, track_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cluster_id int, track_id int, ts timestamp").parquet(str(tmp_path / "in"))
    q = occupancy(stream).writeStream.outputMode("append").format("memory").queryName("occ").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.window.start)[11:16]: r.aircraft for r in spark.table("occ").collect()}
    assert got["00:00"] == 3 and got["00:05"] == 2


def test_conflicts_of_blocks_of_every_size_and_chunk(spark, monkeypatch):
    """Blocks of a bin and pieces of a task's work don't matter; a pair's nearest samples count, and pairs aren't shuffled."""
    rng = random.Random(8)
    rows = [(i % 2, i, k, rng.uniform(0, 9e4), rng.uniform(-4e4, 4e4), rng.uniform(0, 3e3), rng.uniform(-300, 300), rng.uniform(-300, 300), 1.0, float(rng.randint(0, 240))) for i in range(24) for k in range(8)]
    rows += [(0, 90, 0, None, 0.0, 0.0, 1.0, 1.0, 1.0, 5.0), (0, 91, 0, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0, 5.0), (None, 92, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "cluster_id int, track_id long, seq long, x double, y double, z double, vx double, vy double, vz double, t_abs double")
    pairs = workload.converging(df.select("cluster_id", *(F.col(c).alias(f"a_{c}") for c in df.columns[1:])).join(df.select("cluster_id", *(F.col(c).alias(f"b_{c}") for c in df.columns[1:])), "cluster_id"))
    pairs = pairs.withColumn("bin", F.floor(F.col("a_t_abs") / 60))
    best = lambda p: {(r.cluster_id, r.bin, r.a_track_id, r.b_track_id): tuple(r.m) for r in p.groupBy("cluster_id", "bin", "a_track_id", "b_track_id").agg(F.min(F.struct("horizontal_ft", "time", "vertical_ft", "convergence")).alias("m")).collect()}
    want = {False: best(pairs.where("bin = floor(b_t_abs / 60)")), True: best(pairs.where("abs(bin - floor(b_t_abs / 60)) <= 1"))}
    assert len(want[False]) > 20 and len(want[True]) > len(want[False])
    for block, most, sliding in ((20_000, 1_000_000, False), (5, 40, False), (5, 40, True)):
        monkeypatch.setattr(workload.meetings, "__defaults__", (most,))
        found = workload.conflicts(df, sliding=sliding, block=block)
        got = {(r.cluster_id, r.bin, r.track_a, r.track_b): (r.horizontal_ft, r.time, r.vertical_ft, r.convergence) for r in found.collect()}
        assert got.keys() == want[sliding].keys() and all(np.allclose(got[k], want[sliding][k], rtol=1e-12) for k in got)
    assert "aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().lower().split("flatmapgroups")[0]


def test_stored_labels_are_merged_not_broadcast(spark):
    """A stored table looks small by its compressed size; components never broadcast one."""
    seen, own = [], graph.cut
    graph.cut = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1]
    try:
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()
    finally:
        graph.cut = own
    assert len(seen) > 2 and not any("Broadcast" in plan for plan in seen)
