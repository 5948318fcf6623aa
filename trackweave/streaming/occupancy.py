"""Sector occupancy over a stream of points: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occupancy(points: DataFrame, *, late: str = "10 minutes", window: str = "300 seconds") -> DataFrame:
    """cluster_id, window, aircraft: distinct tracks of each closed window; points later than ``late`` are dropped.

    ``points`` has event time ``ts``, cluster_id and track_id.  A distinct count isn't possible in one streaming
    aggregation, so tracks are first made distinct by (cluster, window, track); the watermark frees that state.
    """
    own = points.withWatermark("ts", late).select("cluster_id", "track_id", F.window("ts", window).alias("window")).dropDuplicates(["cluster_id", "track_id", "window"])
    return own.groupBy("cluster_id", "window").agg(F.count("*").alias("aircraft"))
