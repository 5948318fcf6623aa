"""Ranks of tracks that are copies of each other against their SQL: equal tracks tie, and ties go by track."""

import pytest

from trackweave.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def events(folder, copies):
    con = duckdb.connect()
    con.execute(f"""
        copy (
          select row_number() over (order by c, u, i) as event_id, timestamp '2024-01-01' + to_seconds(i * 61 + u) as ts, u + 100 * c as user_id, 'view' as event_type,
                 (i * 37 + u * 11 + i * i * (u + 3)) % 900 / 7 as value, '{{"k": ' || (u * 31 + i * i * 7 + i * 13) % 100 || '}}' as props
          from range(30) a(u), range({copies}) b(c), range(70) d(i) where i < 50 + u % 17) to '{folder}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    return events(tmp_path_factory.mktemp("tied"), 100)


def test_sql_ranks_copies_by_track(tmp_path):
    """So many copies that DuckDB's threads share a track's steps."""
    _, con = events(tmp_path, 1_500)
    rows = sorted((track % 100, track, rank) for track, rank in con.sql(f"select track_id, rank from ({ORACLES['anomaly_rank']})").fetchall())
    assert len(rows) == 45_000
    assert all(a[0] != b[0] or a[2] < b[2] for a, b in zip(rows[:-1], rows[1:], strict=True))


@pytest.mark.parametrize("name", ["anomaly_rank", "anomaly_assessment", "anomaly_risks"])
def test_copies_rank_by_track(spark, tables, name):
    folder, con = tables
    found, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    columns = [c for c in ("cluster_id", "track_id", "rank", "level", "finding", "rule_risks") if c in found.columns]
    at = [want.columns.index(c) for c in columns]
    left, right = sorted(tuple(r[c] for c in columns) for r in found.collect()), sorted(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(left) == 3_000
    assert left == right
