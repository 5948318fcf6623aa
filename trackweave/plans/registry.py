"""Registration of queries: name, DataFrame function, SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_STEPS = """
st as (
  select *, x - px as dx, y - py as dy, z - pz as dz, t - pt as dt, v - pv as dv, fx - x as ex, fy - y as ey, fz - z as ez, ft - t as et
  from (
    select *, count(*) over (partition by track_id) as n,
           lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz, lag(t) over w as pt, lag(v) over w as pv,
           lead(x) over w as fx, lead(y) over w as fy, lead(z) over w as fz, lead(t) over w as ft
    from tp window w as (partition by track_id order by seq))),
ends as (
  select track_id, arg_min(x, seq) as ax, arg_min(y, seq) as ay, arg_min(z, seq) as az, arg_min(t, seq) as t0,
         arg_max(x, seq) as qx, arg_max(y, seq) as qy, arg_max(z, seq) as qz, arg_max(t, seq) as t1 from tp group by track_id)
"""
#: Common table expressions by name, in the order in which they need each other.
VIEWS = {"tp": adapters.SQL_TP, "st": SQL_STEPS, "flights": adapters.SQL_FLIGHTS, "member": adapters.SQL_MEMBER, "vec": adapters.SQL_VEC}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' sums compare; -0 becomes 0."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def register(name: str, sql: str | None = None, views: str = "tp st") -> Callable:
    """Decorator: the query's result is rounded; ``sql`` may use the named views."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            recursive = "recursive" if sql.strip().startswith("with recursive ") else ""
            prelude = ",".join(VIEWS[v].strip() for v in VIEWS if v in views.split())
            body = sql.strip().replace("with recursive ", "with ", 1)
            joined = f"{prelude},{body.removeprefix('with ')}" if body.startswith("with ") and prelude else f"{prelude} {body}" if prelude else body
            text = f"with {recursive} {joined}" if prelude else joined
            ORACLES[name] = f"select columns(*) from ({text})"
        return fn

    return add
