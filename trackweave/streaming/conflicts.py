"""Conflicts of aircraft over a stream of samples: a self-join inside time bins, and velocities from the track's last sample."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.workload import CONFLICT_BIN, HORIZONTAL, VERTICAL, converging, severity

SAMPLE = ("track_id", "t_abs", "x", "y", "z", "vx", "vy", "vz")


def velocities(points: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``points`` (cluster_id, track_id, t_abs, x, y, z, with event time ``ts``) with vx, vy, vz as the batch form gives them.

    A track's samples are put in order of time as the watermark passes them; a sample's velocity comes from the one before, the first
    one's from the second, so a track's first sample waits for its second (or, for a lone one, comes with 0 once ``late`` has passed
    again).  The state of a track is what the watermark hasn't passed and one settled sample; it is dropped when none is left for two
    spans of ``late``, so a track that comes back later starts anew.  Samples of one time go by their position.  Samples behind the watermark are dropped and counted, see ``late_rows``.
    """
    wait = pd.Timedelta(late) // pd.Timedelta(milliseconds=1)
    kinds = dict(points.dtypes)
    schema = f"cluster_id {kinds['cluster_id']}, track_id {kinds['track_id']}, ts timestamp, t_abs double, x double, y double, z double, vx double, vy double, vz double"
    held = "pending array<array<double>>, last array<double>, velocity boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last, moving = (list(map(list, state.get[0])), list(state.get[1]), state.get[2]) if state.exists else ([], [], False)
        for pdf in batches:
            pending += pdf[["t_abs", "x", "y", "z"]].astype(float).to_numpy().tolist()
        mark = state.getCurrentWatermarkMs()
        pending.sort()
        ready = [p for p in pending if p[0] * 1000 <= mark]
        pending = pending[len(ready) :]
        out = []
        for p in ready:
            if last:
                v = [(b - a) / ((p[0] - last[0]) or 1e-8) for a, b in zip(last[1:], p[1:], strict=True)]
                if not moving:
                    out.append([*last, *v])
                out.append([*p, *v])
                moving = True
            last = p
        if last and not moving and not pending and last[0] * 1000 + wait < mark:
            out.append([*last, 0.0, 0.0, 0.0])
            moving = True
        if pending or (last and last[0] * 1000 + 2 * wait >= mark):
            state.update((pending, last, moving))
            # Woken when the watermark has passed the next sample, a lone one's wait, or the end of the track's state.
            state.setTimeoutTimestamp(max(mark + 1, int(pending[0][0] * 1000) if pending else int(last[0] * 1000) + (2 if moving else 1) * wait + 1))
        elif state.exists:
            state.remove()
        if out:
            pdf = pd.DataFrame(out, columns=["t_abs", "x", "y", "z", "vx", "vy", "vz"])
            pdf.insert(0, "ts", pd.to_datetime((pdf["t_abs"] * 1e6).round().astype("int64"), unit="us"))
            pdf.insert(0, "track_id", key[1])
            pdf.insert(0, "cluster_id", key[0])
            yield pdf

    own = points.withWatermark("ts", late).select("cluster_id", "track_id", "ts", "t_abs", "x", "y", "z")
    return own.groupBy("cluster_id", "track_id").applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def conflicts(inside: DataFrame, *, late: str = "10 minutes", horizontal: float = HORIZONTAL, vertical: float = VERTICAL, window: float = CONFLICT_BIN) -> DataFrame:
    """The rows of ``workload.conflicts``, each once the watermark has passed its bin.

    ``inside`` has cluster_id, the ``SAMPLE`` columns and event time ``ts`` (that of t_abs), as a stream of samples inside sectors, such as a
    stored stream of ``velocities``.  Both sides of the join and the best sample pair by bin are freed by the watermark; a bin is
    joined by grid cells of the separation, so only near samples meet.
    """
    base = inside.withWatermark("ts", late).withColumns({"bin": F.window("ts", f"{window} seconds"), "gx": F.floor(F.col("x") / horizontal), "gy": F.floor(F.col("y") / horizontal)})
    left = base.select("cluster_id", "bin", "gx", "gy", *(F.col(c).alias(f"a_{c}") for c in SAMPLE))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    right = base.withColumn("s", F.explode(near)).withColumn("gx", F.col("gx") + F.col("s")).drop("s")
    right = right.withColumn("s", F.explode(near)).withColumn("gy", F.col("gy") + F.col("s")).drop("s")
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in ("cluster_id", "bin", "gx", "gy")), *(F.col(c).alias(f"b_{c}") for c in SAMPLE))
    met = left.join(right, F.expr("cluster_id = r_cluster_id and bin = r_bin and gx = r_gx and gy = r_gy")).drop("r_cluster_id", "r_bin", "r_gx", "r_gy")
    best = converging(met, horizontal, vertical, window).groupBy("bin", "cluster_id", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"))
    best = best.agg(F.min(F.struct("horizontal_ft", "time", "vertical_ft", "convergence")).alias("m"))
    out = best.select("cluster_id", F.floor(F.unix_micros("bin.start") / (window * 1e6)).alias("bin"), "track_a", "track_b", "m.*")
    return out.withColumn("severity", severity(horizontal, vertical))


def late_rows(query) -> int:
    """Rows that a streaming query's operators have dropped behind the watermark, over its kept progress reports; a row that two
    operators would have read is counted by each."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
