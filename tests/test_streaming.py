"""Streams replayed from a table in many small files give the batch rows; late rows are counted."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import geometry as g
from trackweave.operators import runway, workload
from trackweave.streaming import conflicts as stream
from trackweave.streaming import landing

STEPS = "cluster_id int, track_id long, seq int, t_abs double, x double, y double, z double, v double, t double, ts timestamp"


def replay(spark, rows, schema, folder, batches, form, name, tmp_path, watch=None):
    """The rows of ``form`` over a stream that reads ``batches`` lists of rows, one a trigger."""
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{n:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = form(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    try:
        q.processAllAvailable()
        if watch is not None:
            watch.append(stream.late_rows(q))
        return spark.table(name).collect()
    finally:
        q.stop()


def dealt(rows, at, parts, jitter):
    """Rows in order of time, moved about by up to ``jitter`` seconds, in ``parts`` lists."""
    rng = random.Random(5)
    own = sorted(rows, key=lambda r: r[at] + rng.uniform(0, jitter))
    size = -(-len(own) // parts)
    return [own[i : i + size] for i in range(0, len(own), size)]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    rows = []
    for track in range(24):
        start, x, y = rng.uniform(0, 900), rng.uniform(-40_000, 40_000), rng.uniform(-40_000, 40_000)
        for k in range(12):
            t = round(start + 20 * k, 3)
            rows.append((track % 2, track, k, t, x * (1 - k / 8), y * (1 - k / 8), 3_000.0 + 10 * (track % 7), 200.0, 20.0 * k))
    return rows


def rounded(rows, places=6):
    return sorted(tuple(round(v, places) if isinstance(v, float) else v for v in r) for r in rows)


def test_stream_of_conflicts_is_the_batch_form(spark, samples, tmp_path):
    stamped = [(*r, None) for r in samples]
    table = spark.createDataFrame(stamped, STEPS).withColumn("ts", F.timestamp_micros(F.round(F.col("t_abs") * 1e6).cast("long")))
    moving = g.velocities(table, ("cluster_id", "track_id")).drop("seq", "v", "t")
    want = workload.conflicts(moving.drop("ts")).collect()
    assert len(want) > 10
    keep = ["cluster_id", "track_id", "ts", "t_abs", "x", "y", "z"]
    last = table.agg(F.max("ts").alias("m")).first().m
    far = lambda base, days: base.replace(year=2030, day=1 + days)
    rows = [tuple(r) for r in table.select(*keep).collect()]
    schema = table.select(*keep).schema
    pieces = [*dealt(rows, 3, 6, 30.0), [(9, 99, far(last, 1), far(last, 1).timestamp(), 9e9, 9e9, 0.0)], [(9, 98, far(last, 2), far(last, 2).timestamp(), 9e9, 9e9, 0.0)]]
    got = replay(spark, rows, schema, tmp_path / "points", pieces, stream.velocities, "velocities", tmp_path)
    got = [r for r in got if r.cluster_id < 9]
    batch = moving.select(*keep, "vx", "vy", "vz").collect()
    assert rounded([tuple(r)[:2] + tuple(r)[3:] for r in got]) == rounded([tuple(r)[:2] + tuple(r)[3:] for r in batch])
    rows = [tuple(r) for r in batch]
    schema = moving.select(*keep, "vx", "vy", "vz").schema
    pieces = [*dealt(rows, 3, 5, 60.0), [(9, 99, far(last, 1), far(last, 1).timestamp(), 9e9, 9e9, 0.0, 0.0, 0.0, 0.0)]]
    found = replay(spark, rows, schema, tmp_path / "moving", pieces, stream.conflicts, "conflicts", tmp_path)
    columns = sorted(want[0].asDict())
    assert sorted(found[0].asDict()) == columns
    assert rounded([tuple(r[c] for c in columns) for r in found]) == rounded([tuple(r[c] for c in columns) for r in want])


ARRIVALS = "track_id long, load_seq long, runway string, eta double, optimal_eta double, delay double, wake string, ts timestamp"


def test_stream_of_landings_is_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        eta = float(rng.randrange(0, 9_000))
        rows.append((i, i, ("28R" if i % 3 else "28L") if i % 11 else runway.NOT_SPECIFIED, eta, eta - rng.randrange(0, 400), 0.0, "heavy" if i % 5 == 0 else "medium"))
    rows += [(200, 200, "28R", rows[1][3], rows[1][4], 0.0, "heavy"), (201, 201, "28R", None, None, 0.0, "medium")]
    table = spark.createDataFrame([(*r, None) for r in rows], ARRIVALS).withColumn("ts", F.timestamp_micros(F.round(F.col("eta") * 1e6).cast("long")))
    want = runway.sequence(table.where("eta is not null").withColumn("cluster_id", F.lit(0)))
    own = [tuple(r) for r in table.collect()]
    last = max(r[-1] for r in own if r[-1]).replace(year=2030)
    done = [(999, 999, "zz", last.timestamp(), 0.0, 0.0, "medium", last)]
    known = [r for r in own if r[3] is not None]
    counts: list[int] = []
    got = replay(spark, own, table.schema, tmp_path / "in", [*dealt(known, 3, 6, 300.0), [r for r in own if r[3] is None], done], landing.sequence, "landings", tmp_path, counts)
    columns = ["runway", "track_id", "eta", "number", "spacing", "required", "violation", "overtaking", "scheduled", "sequence_delay"]
    left = [tuple(r[c] for c in columns) for r in got if r.runway != "zz"]
    right = [tuple(r[c] for c in columns) for r in want.collect()]
    plain = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows)
    assert len(right) > 100 and plain(left) == plain(right) and counts == [0]


def test_a_late_landing_is_dropped_and_counted(spark, tmp_path):
    schema = spark.createDataFrame([], ARRIVALS).schema
    at = lambda s: spark.sql(f"select timestamp_seconds({s}) as t").first().t
    row = lambda i, s: (i, i, "10", float(s), float(s), 0.0, "medium", at(s))
    counts: list[int] = []
    pieces = [[row(1, 1_000), row(2, 1_300)], [row(3, 9_000)], [row(6, 9_100)], [row(4, 1_100)], [row(5, 20_000)]]
    got = replay(spark, [], schema, tmp_path / "in", pieces, landing.sequence, "late", tmp_path, counts)
    assert sorted((r.number, r.track_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 6)] and counts == [1]
