"""Queries against their SQL on tracks longer than sf0.1 has: beyond the 100 points of alignment, and of lengths whose share of 70 percent is
rounded down as a double."""

import json

import pytest

from trackweave.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    rows = []
    for user in range(20):
        n = 90 if user == 3 else 130 + 7 * user if user % 4 == 0 else 60 + user
        for i in range(n):
            k = (99 if i == 62 else 1) if user == 3 else (user * 31 + i * i * 7 + i * 13) % 100
            rows.append((len(rows), f"2024-01-{1 + user:02d} {i // 60:02d}:{i % 60:02d}:{(i * 7) % 60:02d}", user, "view", (i * 37 + user * 11) % 900 / 7, json.dumps({"k": k})))
    text = ", ".join(f"({a}, timestamp '{b}', {c}, '{d}', {v!r}::double, '{p}')" for a, b, c, d, v, p in rows)
    con = duckdb.connect()
    path = folder / "events.parquet"
    con.execute(f"copy (select * from (values {text}) t(event_id, ts, user_id, event_type, value, props)) to '{path}' (format parquet)")
    con.execute(f"create view events as select * from '{path}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["speed_rule", "aligned_tracks", "centroid_median", "centroid_smooth", "track_deviation", "anomaly_rank", "anomaly_assessment", "anomaly_risks", "rf_segments", "pbn_issues", "top_cluster_anomalies"])
def test_query(spark, tables, name):
    folder, con = tables
    found = QUERIES[name](spark, folder)
    want = con.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple(str(v) for v in row if not isinstance(v, float))
    left = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    right = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert len(left) == len(right) > 0
    for x, y in zip(left, right, strict=True):
        assert all(abs(a - b) <= 2e-4 + 1e-9 * abs(a) if isinstance(a, float) else a == b for a, b in zip(x, y, strict=True))
