"""Controller workload of sectors: occupancy, conflicts, track metrics and the index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut

from . import geometry as g
from .sector import XY_BUFFER

BIN, CONFLICT_BIN, HORIZONTAL, VERTICAL = 300.0, 60.0, 18228.0, 1000.0
#: Markers of aircraft that need more attention.
ATTENTION = "heavy|b747|b777|a340|a380|mil|military|ввс"

e = F.expr


def samples(points: DataFrame, boxes: DataFrame, hull: DataFrame | None = None, buffer: float = XY_BUFFER) -> DataFrame:
    """Points (with cluster_id) inside their sector, with velocities over the whole track.

    Inside is inside the box and, with ``hull`` (cluster_id, equations), no further than ``buffer`` outside any face; a cluster
    without a box has no points inside, one without a hull or with a degenerate one is its box.
    """
    v = g.velocities(points, ("cluster_id", "track_id"))
    sector = boxes.select("cluster_id", *(f"{m}_{c}" for c in "xyz" for m in ("min", "max")))
    inside = v.join(sector, "cluster_id").where("x between min_x and max_x and y between min_y and max_y and z between min_z and max_z")
    if hull is None:
        return inside
    faces = hull.select("cluster_id", "equations")
    return inside.join(faces, "cluster_id", "left").where(f"equations is null or forall(equations, q -> q[0] * x + q[1] * y + q[2] * z + q[3] <= {buffer})").drop("equations")


def occupancy(inside: DataFrame, bin_seconds: float = BIN) -> DataFrame:
    """cluster_id, bin, aircraft: distinct tracks in each time bin."""
    return inside.withColumn("bin", F.floor(F.col("t_abs") / bin_seconds)).groupBy("cluster_id", "bin").agg(F.countDistinct("track_id").alias("aircraft"))


def track_metrics(inside: DataFrame, tracks: DataFrame) -> DataFrame:
    """Dwell, curvature, gradient and complexity of every track with points inside."""
    keys = ("cluster_id", "track_id")
    s = g.steps(inside.select(*keys, "seq", "x", "y", "z", "v", "t", "t_abs"), keys)
    agg = s.groupBy(*keys).agg(
        (F.max_by("t", "seq") - F.min_by("t", "seq")).alias("dwell"),
        F.coalesce(F.avg(F.when(e(g.INNER), e(g.TURN_3D))), F.lit(0.0)).alias("curvature"),
        *(F.min_by(c, "seq").alias(f"a{c}") for c in "xyz"),
        *(F.max_by(c, "seq").alias(f"b{c}") for c in "xyz"),
        F.min_by("t_abs", "seq").alias("entry_time"),
        F.max_by("t_abs", "seq").alias("exit_time"),
    )
    flag = F.lower(F.concat_ws(" ", F.coalesce("aircrafttype", F.lit("")), F.coalesce("aircraft_category", F.lit("")))).rlike(ATTENTION)
    out = agg.withColumn("gradient", e("(az - bz) / (sqrt(pow(bx - ax, 2) + pow(by - ay, 2)) + 1e-8D)")).join(tracks.select("track_id", flag.cast("double").alias("flag")), "track_id")
    return out.select(*keys, F.greatest(F.lit(0.0), "dwell").alias("dwell"), "curvature", "gradient", e("1 + 0.7D * least(1D, curvature / 0.25D) + 0.5D * least(1D, abs(gradient) / 0.12D) + 0.2D * flag").alias("complexity"), "entry_time", "exit_time")


def weighted_occupancy(inside: DataFrame, metrics: DataFrame, bin_seconds: float = BIN) -> DataFrame:
    """cluster_id, weighted: over bins, the count times the mean complexity (1 for tracks without metrics)."""
    present = inside.withColumn("bin", F.floor(F.col("t_abs") / bin_seconds)).select("cluster_id", "bin", "track_id").distinct()
    own = present.join(metrics.select("cluster_id", "track_id", "complexity"), ["cluster_id", "track_id"], "left")
    bins = own.groupBy("cluster_id", "bin").agg((F.count("*") * F.avg(F.coalesce("complexity", F.lit(1.0)))).alias("w"))
    return bins.groupBy("cluster_id").agg(F.sum("w").alias("weighted"))


def converging(met: DataFrame, horizontal: float = HORIZONTAL, vertical: float = VERTICAL, window: float = CONFLICT_BIN) -> DataFrame:
    """Of pairs of samples (a_.., b_..), those closer than the separations and approaching, with distances, time and convergence."""
    p = met.where("a_track_id < b_track_id").where(f"abs(a_z - b_z) <= {vertical} and abs(a_t_abs - b_t_abs) <= {window}")
    p = p.withColumn("horizontal_ft", e("sqrt(pow(a_x - b_x, 2) + pow(a_y - b_y, 2))")).where(F.col("horizontal_ft") <= horizontal)
    closing = "-((b_x - a_x) * (b_vx - a_vx) + (b_y - a_y) * (b_vy - a_vy) + (b_z - a_z) * (b_vz - a_vz))"
    cosine = "(a_vx * b_vx + a_vy * b_vy + a_vz * b_vz) / (sqrt(a_vx * a_vx + a_vy * a_vy + a_vz * a_vz) * sqrt(b_vx * b_vx + b_vy * b_vy + b_vz * b_vz) + 1e-8D)"
    p = p.withColumn("convergence", e(f"if({closing} <= 0, 0D, least(1D, {closing} / 10000D) * (0.5D + 0.5D * greatest(0D, -({cosine}))))")).where("convergence > 0")
    return p.withColumns({"time": e("(a_t_abs + b_t_abs) / 2"), "vertical_ft": e("abs(a_z - b_z)")})


def severity(horizontal: float = HORIZONTAL, vertical: float = VERTICAL) -> Column:
    h, v = f"horizontal_ft / {horizontal}D", f"vertical_ft / {vertical}D"
    return e(f"case when {h} < 0.5D and {v} < 0.5D and convergence > 0.6D then 'HIGH' when {h} < 0.8D and {v} < 0.8D then 'MEDIUM' else 'LOW' end")


def conflicts(inside: DataFrame, horizontal: float = HORIZONTAL, vertical: float = VERTICAL, window: float = CONFLICT_BIN, sliding: bool = False, block: int = 20_000) -> DataFrame:
    """One row for each pair of tracks and bin with a converging pair of samples closer than the separations.

    The samples of a cluster's bin are dealt by track into blocks of about ``block``; two blocks meet in a task as arrays, where only
    neighbouring cells of a grid of the separation are compared.  All samples of two tracks meet in one task, so no pair is shuffled
    but the samples only.  Of several sample pairs the nearest counts, then the earliest.
    ``sliding`` also compares with the next bin, at most ``window`` seconds apart.
    """
    kinds = dict(inside.dtypes)
    columns = ("t_abs", "x", "y", "z", "vx", "vy", "vz")
    base = inside.select("cluster_id", F.floor(F.col("t_abs") / window).cast("long").alias("bin"), "track_id", *(F.col(c).cast("double").alias(c) for c in columns))
    base = cut(base.where(" and ".join(f"{c} is not null" for c in base.columns)))
    rows = base.withColumn("late", F.lit(0))
    if sliding:
        rows = rows.withColumn("late", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn("bin", F.col("bin") + F.col("late"))
    parts = rows.groupBy("cluster_id", "bin").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = rows.join(parts, ["cluster_id", "bin"]).withColumn("own", F.pmod(F.xxhash64("track_id"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("parts", "other")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        names, track = np.unique(table["track_id"].to_numpy(), return_inverse=True)
        own = {c: table[c].to_numpy() for c in (*columns, "own", "late")} | {"track": track}
        for found in meetings(own, key[2].as_py() == key[3].as_py(), horizontal, vertical, window):
            ids = {f"track_{k}": names[found.pop(k)] for k in "ab"}
            yield pa.RecordBatch.from_pydict({"cluster_id": pa.repeat(key[0], len(ids["track_a"])), "bin": pa.repeat(key[1], len(ids["track_a"])), **ids, **found})

    schema = f"cluster_id {kinds['cluster_id']}, bin long, track_a {kinds['track_id']}, track_b {kinds['track_id']}, horizontal_ft double, time double, vertical_ft double, convergence double"
    return rows.groupBy("cluster_id", "bin", "low", "high").applyInArrow(meet, schema).withColumn("severity", severity(horizontal, vertical))


def meetings(s: dict[str, np.ndarray], alone: bool, horizontal: float, vertical: float, window: float, most: int = 1_000_000) -> Iterator[dict[str, np.ndarray]]:
    """Nearest converging samples of each pair of tracks, some whole tracks at a time; from two blocks (not ``alone``) only pairs across.

    Cells are numbered along y inside x, so a sample's three neighbours on one x are one stretch of the sorted samples."""
    gx, gy = (np.floor(s[c] / horizontal) for c in "xy")
    fine = np.isfinite(gx) & np.isfinite(gy)
    gx, gy = (g - g[fine].min(initial=0) for g in (gx, gy))
    right = np.flatnonzero(fine)
    right = right[np.lexsort((gy[right], gx[right]))]
    left = np.flatnonzero(fine & (s["late"] == 0))
    left = left[np.argsort(s["track"][left], kind="stable")]
    columns, starts = np.unique(gx[right], return_index=True)
    ends = np.append(starts, len(right))[1:]
    stretches = []
    for step in (-1, 0, 1):
        at = np.searchsorted(columns, gx[left] + step)
        there = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == gx[left] + step) if len(columns) else np.zeros(len(left), bool)
        low, high = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for c in np.unique(at[there]):
            mine = np.flatnonzero(there & (at == c))
            line = gy[right[starts[c] : ends[c]]]
            low[mine] = starts[c] + np.searchsorted(line, gy[left[mine]] - 1, "left")
            high[mine] = starts[c] + np.searchsorted(line, gy[left[mine]] + 1, "right")
        stretches.append((low, high - low))
    upto = np.cumsum(sum(n for _, n in stretches)) if len(left) else np.zeros(0)
    begin = 0
    while begin < len(left):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
        stop = int(np.searchsorted(s["track"][left], s["track"][left[stop - 1]], "right"))
        pairs = []
        for low, n in stretches:
            low, n = low[begin:stop], n[begin:stop]
            pairs.append((np.repeat(left[begin:stop], n), right[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        begin = stop
        take = (s["track"][a] < s["track"][b]) & (np.abs(s["z"][a] - s["z"][b]) <= vertical) & (np.abs(s["t_abs"][a] - s["t_abs"][b]) <= window)
        if not alone:
            take &= s["own"][a] != s["own"][b]
        a, b = a[take], b[take]
        dx, dy, dz = (s[c][b] - s[c][a] for c in "xyz")
        far = np.sqrt(dx * dx + dy * dy)
        take = far <= horizontal
        a, b, dx, dy, dz, far = (v[take] for v in (a, b, dx, dy, dz, far))
        va, vb = ([s[f"v{c}"][k] for c in "xyz"] for k in (a, b))
        closing = -(dx * (vb[0] - va[0]) + dy * (vb[1] - va[1]) + dz * (vb[2] - va[2]))
        size = [np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) for v in (va, vb)]
        cosine = (va[0] * vb[0] + va[1] * vb[1] + va[2] * vb[2]) / (size[0] * size[1] + 1e-8)
        towards = np.where(closing <= 0, 0.0, np.minimum(1.0, closing / 10000) * (0.5 + 0.5 * np.maximum(0.0, -cosine)))
        found = {"horizontal_ft": far, "time": (s["t_abs"][a] + s["t_abs"][b]) / 2, "vertical_ft": np.abs(dz), "convergence": towards}
        track = {"a": s["track"][a], "b": s["track"][b]}
        order = np.lexsort((*list(found.values())[::-1], track["b"], track["a"]))
        order = order[towards[order] > 0]
        ids = [track[k][order] for k in "ab"]
        first = np.ones(len(order), bool)
        first[1:] = (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])
        order = order[first]
        if len(order):
            yield {k: v[order] for k, v in (track | found).items()}


def index(boxes: DataFrame, inside: DataFrame, metrics: DataFrame, found: DataFrame) -> DataFrame:
    """cluster_id, weighted, peak, conflicts, complexity, dwell, workload: W = weighted + 5 conflicts + 1.5 peak; ``found`` are conflicts or
    their numbers (cluster_id, conflicts)."""
    counts = found if "conflicts" in found.columns else found.groupBy("cluster_id").agg(F.count("*").alias("conflicts"))
    peak = occupancy(inside).groupBy("cluster_id").agg(F.max("aircraft").alias("peak"))
    parts = boxes.select("cluster_id").join(weighted_occupancy(inside, metrics), "cluster_id", "left").join(peak, "cluster_id", "left")
    parts = parts.join(counts, "cluster_id", "left")
    parts = parts.join(metrics.groupBy("cluster_id").agg(F.avg("complexity").alias("complexity"), F.avg("dwell").alias("dwell")), "cluster_id", "left")
    out = parts.fillna(0.0, ["weighted", "complexity", "dwell"]).fillna(0, ["peak", "conflicts"])
    return out.withColumn("workload", e("weighted + 5D * conflicts + 1.5D * peak"))
