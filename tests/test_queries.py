"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from trackweave.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return f"{round(v, 4) + 0.0:.4f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, DATA)
    want = con.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    left = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    at = [want.columns.index(c) for c in columns]
    right = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert len(left) == len(right)
    close = lambda a, b: a == b or (a.replace(".", "").replace("-", "").isdigit() and b.replace(".", "").replace("-", "").isdigit() and abs(float(a) - float(b)) <= 2e-4 * max(1, abs(float(a)) * 1e-3))
    assert all(close(a, b) for x, y in zip(left, right, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"full_analysis", "algorithm_comparison", "feature_kmeans", "arinc", "geojson", "runway_reassignment"}))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
