"""Bundles of tracks along common lines, for groups of any size at once.

A round lets all points of the tracks that are left vote, in an accumulator by group, for the lines through them: an angle and an offset
in z-scores of the group.  The lines with the highest scores, of which none is a weaker neighbour of another, are the round's peaks, and every
track goes to the first peak that it follows.  Rounds end when no peak is followed by enough tracks; what is left are bundles of
one.  The number of rounds doesn't depend on the number of bundles, groups go through them together, and nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.functions.ranks import placed

from .cluster_kernels import EPS, unit

#: Angles of lines, the width of a cell of offsets, and the last cell on either side; votes further out, where at most one point in
#: 160 can lie, don't count.  A weaker line is a peak's neighbour within so many cells.
ANGLES, STEP, CELLS = 60, 0.1, 128
NEAR_ANGLES, NEAR_CELLS = 3, 5
#: Groups whose votes a task holds before it sends them on.
HELD = 64
e = F.expr

_THETA = np.arange(ANGLES) * np.pi / ANGLES
_COS, _SIN = np.cos(_THETA), np.sin(_THETA)


def packed(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, track_id, xs, ys, zs, ux, uy, uz): a track's points in order and its direction, zeros for one that ends where it
    starts."""
    p = points.groupBy(*keys, "track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    p = p.select(*keys, "track_id", *(e(f"transform(p, q -> cast(q.{c} as double))").alias(f"{c}s") for c in "xyz"))
    p = p.withColumns({f"d{c}": e(f"element_at({c}s, -1) - {c}s[0]") for c in "xyz"}).withColumn("len", e("sqrt(dx * dx + dy * dy + dz * dz)"))
    return p.select(*keys, "track_id", "xs", "ys", "zs", *(e(f"if(len < {EPS}D, 0D, d{c} / len)").alias(f"u{c}") for c in "xyz"))


def kernel(likelihood: bool, threshold: float) -> np.ndarray:
    """What a point adds to the score of lines so many cells away: one within ``threshold``, or the likelihood's gain over an outlier's."""
    if not likelihood:
        reach = int(round(threshold / STEP))
        return np.ones(2 * reach + 1)
    far = np.arange(-int(4 * threshold / STEP), int(4 * threshold / STEP) + 1) * STEP
    return np.log((0.7 * np.exp(-(far**2) / (2 * threshold**2 + EPS)) + 0.03 + EPS) / (0.03 + EPS))


def votes(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Points by angle and cell of their offset from the line of that angle through the centre."""
    out = np.zeros((ANGLES, 2 * CELLS + 1), dtype=np.int64)
    for a in range(ANGLES):
        cell = np.rint((ys * _COS[a] - xs * _SIN[a]) / STEP)
        cell = cell[np.abs(cell) <= CELLS].astype(np.int64) + CELLS
        out[a] = np.bincount(cell, minlength=2 * CELLS + 1)
    return out


def peaks(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(angle, offset, score) of the lines that no line near them beats, by falling score; equal ones by angle and offset.

    An angle beyond the last is the first with offsets turned round.
    """
    score = np.array([np.convolve(row, weights, "full")[len(weights) // 2 :][: len(row)] for row in counts])
    # Equal scores are told apart by their order, so that one of several equal neighbours stays.
    rank = np.empty(score.size)
    rank[np.lexsort((np.arange(score.size), -score.ravel()))] = np.arange(score.size, 0, -1)
    rank = rank.reshape(score.shape)
    best = rank.copy()
    for turn in range(-NEAR_ANGLES, NEAR_ANGLES + 1):
        rows = np.arange(ANGLES) + turn
        other = rank[rows % ANGLES]
        flip = (rows < 0) | (rows >= ANGLES)
        other[flip] = other[flip][:, ::-1]
        padded = np.pad(other, ((0, 0), (NEAR_CELLS, NEAR_CELLS)))
        for shift in range(2 * NEAR_CELLS + 1):
            best = np.maximum(best, padded[:, shift : shift + score.shape[1]])
    angle, cell = np.nonzero((rank == best) & (score > 0))
    order = np.argsort(-rank[angle, cell])
    return np.column_stack((_THETA[angle], (cell - CELLS) * STEP, score[angle, cell]))[order]


def followed(x: np.ndarray, y: np.ndarray, direction: np.ndarray, lines: np.ndarray, climb: float, threshold: float, cosine: float) -> int:
    """2 * the number of the first line (angle, offset, main sense) that the track follows, plus 1 if against its main sense; -1 for
    none."""
    sin, cos = np.sin(lines[:, 0]), np.cos(lines[:, 0])
    off = np.median(np.abs(y[:, None] * cos - x[:, None] * sin - lines[:, 1]), axis=0)
    near = np.flatnonzero(off <= threshold)
    if not len(near):
        return -1
    sense = lines[near, 2]
    ref = np.column_stack((sense * cos[near], sense * sin[near], np.full(len(near), climb)))
    like = np.column_stack([unit(ref) @ unit(direction), unit(ref * (-1, -1, 1)) @ unit(direction)])
    hit = np.flatnonzero((1 - like <= cosine).ravel())
    return 2 * int(near[hit[0] // 2]) + int(hit[0] % 2) if len(hit) else -1


def bundles(points: DataFrame, group: str, *, likelihood: bool = False, threshold: float = 0.5, cosine: float = 0.3, least: int = 2) -> DataFrame:
    """(group, track_id, cluster_id): bundles of every group, numbered by round and score, then tracks alone by id.

    A track follows a line if the median of its points' distances is at most ``threshold`` z-scores and its direction is within
    ``cosine`` of the line's, turned along most tracks of the group or else against them, and tilted by the group's median climb.
    ``likelihood`` scores lines by the points' log likelihood instead of their number.  Tracks of one point or without a direction get
    -1.  A null group is a group of its own.
    """
    tracks = cut(packed(points, group))
    kind, name = dict(tracks.dtypes)[group], dict(tracks.dtypes)["track_id"]
    weights = kernel(likelihood, threshold)
    left = tracks.where("size(xs) >= 2 and (ux != 0 or uy != 0 or uz != 0)").withColumnRenamed(group, "g")
    store: DataFrame | None = None

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            parts = []
            for g, n in held.items():
                a, c = np.nonzero(n)
                parts.append(pd.DataFrame({"g": [g] * len(a), "angle": a.astype(np.int32), "cell": c.astype(np.int32), "n": n[a, c]}))
            held.clear()
            return pd.concat(parts)

        for pdf in batches:
            for g, own in pdf.groupby("g", dropna=False, sort=False):
                g = None if pd.isna(g) else g
                size = own["xs"].map(len).to_numpy()
                spread = lambda c: np.repeat(own[c].to_numpy(), size)  # noqa: E731, B023
                x, y = (np.concatenate(own[f"{c}s"].to_numpy()) for c in "xy")
                u, v = own["ux"].to_numpy()[:, None], own["uy"].to_numpy()[:, None]
                with_line = (u * _COS + v * _SIN >= 0).sum(axis=0)[:, None]
                every = np.hstack((votes((x - spread("cx")) / spread("sx"), (y - spread("cy")) / spread("sy")), with_line, len(own) - with_line))
                held[g] = held.get(g, 0) + every
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((ANGLES, 2 * CELLS + 3))
        n[pdf["angle"], pdf["cell"]] = pdf["n"]
        found = peaks(n[:, :-2], weights)
        sense = np.where(n[:, -2] >= n[:, -1], 1.0, -1.0)[np.rint(found[:, 0] * ANGLES / np.pi).astype(int)]
        return pd.DataFrame({"g": pdf["g"].iloc[:1].to_numpy(), "lines": [np.column_stack((found[:, :2], sense)).ravel()]})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                lines = np.asarray(r.lines).reshape(-1, 3)
                x, y = (np.asarray(r.xs) - r.cx) / r.sx, (np.asarray(r.ys) - r.cy) / r.sy
                found.append(followed(x, y, np.array([r.ux, r.uy, r.uz]), lines, r.climb, threshold, cosine))
            yield pd.DataFrame({"g": pdf["g"], "track_id": pdf["track_id"], "line": np.array(found, dtype=np.int32)})

    number = 0
    while True:
        place = left.select("g", "uz", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p")).groupBy(F.col("g").alias("h"))
        place = place.agg(F.avg("p.xs").alias("cx"), F.avg("p.ys").alias("cy"), (F.stddev_pop("p.xs") + EPS).alias("sx"), (F.stddev_pop("p.ys") + EPS).alias("sy"), F.percentile_approx(e("if(i = 0, uz, null)"), 0.5, 10_000).alias("climb"))
        framed = left.join(place, F.col("g").eqNullSafe(F.col("h"))).drop("h")
        cells = framed.select("g", "xs", "ys", "ux", "uy", "cx", "cy", "sx", "sy").mapInPandas(counted, f"g {kind}, angle int, cell int, n long")
        top_lines = cells.groupBy("g", "angle", "cell").agg(F.sum("n").alias("n")).groupBy("g").applyInPandas(top, f"g {kind}, lines array<double>")
        lines = cut(top_lines.join(place, F.col("g").eqNullSafe(F.col("h"))).drop("g"))
        found = left.join(lines, F.col("g").eqNullSafe(F.col("h"))).select("g", "track_id", "xs", "ys", "ux", "uy", "uz", "cx", "cy", "sx", "sy", "climb", "lines")
        found = cut(found.mapInPandas(assign, f"g {kind}, track_id {name}, line int"))
        full = found.where("line >= 0").groupBy(F.col("g").alias("h"), F.col("line").alias("l")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        taken = cut(found.join(full, F.col("g").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).select("g", "track_id", F.lit(number).alias("round"), "line"))
        if taken.isEmpty():
            break
        store, number = taken if store is None else store.unionByName(taken), number + 1
        gone = taken.select(F.col("g").alias("h"), F.col("track_id").alias("t"))
        left = cut(left.join(gone, F.col("g").eqNullSafe(F.col("h")) & (F.col("track_id") == F.col("t")), "left_anti"))
    alone = placed(left.select("g", "track_id"), "g", "track_id")
    if store is None:
        labels = alone.select("g", "track_id", F.col("__place").cast("int").alias("cluster_id"))
    else:
        numbers = store.select("g", "round", "line").distinct().withColumn("number", F.row_number().over(Window.partitionBy("g").orderBy("round", "line")) - 1)
        numbers = cut(numbers.select(F.col("g").alias("h"), F.col("round").alias("r"), F.col("line").alias("l"), "number"))
        bundled = store.join(numbers, F.col("g").eqNullSafe(F.col("h")) & (F.col("round") == F.col("r")) & (F.col("line") == F.col("l")))
        last = numbers.groupBy("h").agg((F.max("number") + 1).alias("first"))
        single = alone.join(last, F.col("g").eqNullSafe(F.col("h")), "left").select("g", "track_id", (F.col("__place") + F.coalesce("first", F.lit(0))).cast("int").alias("cluster_id"))
        labels = bundled.select("g", "track_id", F.col("number").cast("int").alias("cluster_id")).unionByName(single)
    labels = labels.select(F.col("g").alias("h"), F.col("track_id").alias("t"), "cluster_id")
    out = tracks.select(group, "track_id").join(labels, F.col(group).eqNullSafe(F.col("h")) & (F.col("track_id") == F.col("t")), "left")
    return out.select(group, "track_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
