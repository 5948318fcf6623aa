"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions.lineage import shared_folder

#: Rows of one Arrow batch; with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared folder, which a lost executor cannot take along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH_BYTES`` at most; ``fn`` gets batches of ``rows`` rows at most."""
    spark = df.sparkSession
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= bound:
            spark.conf.set(key, str(bound))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return df.mapInArrow((lambda batches: fn(small(batches))) if rows < BATCH_ROWS else fn, schema)


def hash_share(column: str, seed: int = 17) -> F.Column:
    """A number in [0, 1) that depends on the column's value only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def bounded_ids(ids: DataFrame, column: str, bound: int) -> DataFrame:
    """A deterministic sample of about ``bound`` rows at most, chosen by the hash of ``column``."""
    total = ids.count()
    if total <= bound:
        return ids
    return ids.where(hash_share(column) < F.lit(bound / total))
