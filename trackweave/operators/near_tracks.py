"""Threshold join of tracks by their mean distance: bounds by boxes leave out most pairs before a point is compared.

Tracks are dealt into blocks that lie together on one end; two blocks whose boxes are near meet in a task as arrays, so a pair is
never a row before it is a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut

from .pair_kernels import SCALE

#: Pieces of a track, those of an end, and the share of a pair's points that the first and the last end have at least.
PIECES, END, FIRST, LAST = 8, 2, 1 / 5, 1 / 4
#: Points of a block, strips of a group at most, rows of a batch of results, and distances that are worked on at once.
POINTS, STRIPS, ROWS, AT_ONCE = 100_000, 64, 500_000, 32_768
e = F.expr
_BOUNDS = tuple(f"{m}_{c}" for c in "xyz" for m in ("min", "max"))


def lines(points: DataFrame, group: str) -> DataFrame:
    """(group, track_id, p, n, pieces): points in order, their number, and the boxes of the parts that a pair's points may come from.

    A pair is measured at evenly picked points, which for both tracks lie in the same piece, give or take a place by rounding.
    """
    whole = points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz"))
    p = whole.groupBy(group, "track_id").agg(F.array_sort(F.collect_list(F.struct("seq", *(F.col(c).cast("double").alias(c) for c in "xyz")))).alias("p")).withColumn("n", F.size("p"))
    part = f"slice(p, greatest(0, cast(floor(s * (n - 1) / {PIECES}) as int) - 1) + 1, 2 + cast(ceil((s + 1) * (n - 1) / {PIECES}) as int) - cast(floor(s * (n - 1) / {PIECES}) as int))"
    box = ", ".join(f"array_{m}(transform({part}, q -> q.{c})) as {m}_{c}" for c in "xyz" for m in ("min", "max"))
    return p.withColumn("pieces", e(f"transform(sequence(0, {PIECES - 1}), s -> struct({box}))"))


def blocks(own: DataFrame, within: float, group: str, most: int = POINTS) -> DataFrame:
    """(group, low, high, block, track_id, p, n, pieces): tracks of ``lines`` in blocks of about ``most`` points, once for each pair of
    blocks of a group, low <= high, that may hold a pair within the distance.

    If the mean is within a distance, the mean over an end is within it over the end's share of points.  So each group is cut into
    strips on the end where its places spread wider (tracks of one airport share the other end), along the wider axis; a
    strip with too many points is dealt by hash.
    """
    centre = lambda s, c: f"(pieces[{s}].min_{c} + pieces[{s}].max_{c}) / 2"
    spread = {(s, c): F.coalesce(F.var_pop(e(centre(s, c))), F.lit(0.0)) for s in (0, PIECES - 1) for c in "xy"}
    last = (F.min("n") > 1) & (spread[PIECES - 1, "x"] + spread[PIECES - 1, "y"] > spread[0, "x"] + spread[0, "y"])
    wide = F.when(last, spread[PIECES - 1, "y"] > spread[PIECES - 1, "x"]).otherwise(spread[0, "y"] > spread[0, "x"])
    end = own.groupBy(group).agg(F.when(last, F.lit(PIECES - END)).otherwise(F.lit(0)).alias("end"), wide.alias("turned"), F.ceil(F.sum("n") / most).alias("parts"))
    box = lambda b: f"array_{b[:3]}(transform(slice(pieces, end + 1, {END}), q -> q.{b}))"
    chosen = own.join(end, group).withColumns({b: e(box(b)) for b in _BOUNDS}).withColumn("at", e("if(turned, min_y + max_y, min_x + max_x) / 2"))
    cuts = chosen.groupBy(group).agg(F.percentile_approx("at", [k / STRIPS for k in range(1, STRIPS)], 1000).alias("cuts"))
    strip = e(f"cast(floor(size(filter(cuts, v -> v < at)) * least({STRIPS}, parts) / {STRIPS}) as long)")
    placed = cut(chosen.join(cuts, group).select(group, "track_id", "p", "n", "pieces", "end", *_BOUNDS, strip.alias("strip")))
    shares = placed.groupBy(group, "strip").agg(F.ceil(F.sum("n") / (2 * most)).alias("shares"))
    dealt = cut(placed.join(shares, [group, "strip"]).withColumn("block", F.col("strip") * (1 << 32) + F.pmod(F.xxhash64("track_id"), "shares")).drop("strip", "shares"))
    side = dealt.groupBy(group, "block").agg(F.max("end").alias("end"), *((F.min if b.startswith("min") else F.max)(b).alias(b) for b in _BOUNDS))
    side = cut(side)
    gap = " + ".join(f"pow(greatest(0D, a.min_{c} - b.max_{c}, b.min_{c} - a.max_{c}), 2)" for c in "xyz")
    reach = f"if(a.end = 0, {within / FIRST}D, {within / LAST}D) * (1 + 1e-9D)"
    met = side.alias("a").join(side.alias("b"), e(f"a.{group} = b.{group} and a.block <= b.block")).where(f"sqrt({gap}) <= {reach}")
    met = met.select(F.col(f"a.{group}").alias(group), F.col("a.block").alias("low"), F.col("b.block").alias("high"))
    met = cut(met)
    each = met.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    # A pair of blocks is small to store and long to compare, so the number of parts goes by pairs, not by bytes.
    parts = max(own.sparkSession.sparkContext.defaultParallelism, met.count())
    return dealt.select(group, "block", "track_id", "p", "n", "pieces").join(each, [group, "block"]).repartition(parts, group, "low", "high")


class Side:
    """Tracks of a block: ids, numbers of points, the points of all one after the other, and the pieces' boxes as (bound, piece, track)."""

    def __init__(self, table: pa.Table):
        self.id = table["track_id"].to_numpy()
        self.n = table["n"].to_numpy().astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        points = table["p"].combine_chunks().flatten()
        self.xyz = [points.field(c).to_numpy() for c in "xyz"]
        boxes = table["pieces"].combine_chunks().flatten()
        self.box = {b: boxes.field(b).to_numpy().reshape(-1, PIECES).T for b in _BOUNDS}

    def picked(self, tracks: np.ndarray, m: int) -> list[np.ndarray]:
        """x, y, z of ``m`` evenly picked points of each of ``tracks``, as (point, track)."""
        n = self.n[tracks]
        at = np.zeros((1, len(tracks)), np.int64) if m == 1 else np.floor(np.arange(m)[:, None] * ((n - 1) / (m - 1))).astype(np.int64)
        if m > 1:
            at[-1] = n - 1
        return [c[self.start[tracks] + at] for c in self.xyz]


def _least(a: Side, k: int, boxes: dict[str, np.ndarray], count: np.ndarray) -> np.ndarray:
    """Sum of distances at least of track ``k`` of ``a`` to others with ``boxes``, of which ``count`` points lie in each piece."""
    far = 0.0
    for c in "xyz":
        gap = a.box[f"min_{c}"][:, [k]] - boxes[f"max_{c}"]
        np.maximum(gap, boxes[f"min_{c}"] - a.box[f"max_{c}"][:, [k]], out=gap)
        far = far + np.square(np.maximum(0.0, gap, out=gap), out=gap)
    return count @ np.sqrt(far)


def _compared(a: Side, b: Side, within: float, exact: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(places in a, places in b, distances) of the pairs within the distance, or without ``exact`` of those that the boxes leave.

    The tracks of one length meet all longer ones of the other side at their own number of points."""
    for m in np.unique(np.concatenate((a.n, b.n))):
        count = np.diff([*(-(-s * (m - 1) // PIECES) for s in range(PIECES)), m]) if m > 1 else np.eye(1, PIECES)[0]
        for own, other, equal in ((a, b, True), (b, a, False)):
            left, right = np.flatnonzero(own.n == m), np.flatnonzero(other.n >= m if equal else other.n > m)
            if not len(left) or not len(right) or (own is other and not equal):
                continue
            boxes = {k: v[:, right] for k, v in other.box.items()}
            cuts = range(0, len(right), max(1, AT_ONCE // m))
            parts = [slice(c, c + cuts.step) for c in cuts] if exact else []
            lines, others = own.picked(left, m) if exact else [], [other.picked(right[part], m) for part in parts]
            for place, k in enumerate(left):
                take = _least(own, k, boxes, count) <= within * m * (1 + 1e-9)
                if own is other:
                    take &= (other.n[right] > m) | (other.id[right] > own.id[k])
                far = np.zeros(len(right))
                for part, cross in zip(parts, others, strict=True):
                    some = int(take[part].sum())
                    if not some:
                        continue
                    few, total = 2 * some < len(take[part]), None
                    for line, at in zip(lines, cross, strict=True):
                        step = (at[:, take[part]] if few else at) - line[:, [place]]
                        step *= step
                        total = step if total is None else np.add(total, step, out=total)
                    far[part][take[part] if few else slice(None)] = np.sqrt(total, out=total).sum(axis=0) / m
                met = np.flatnonzero(take & (far <= within))
                if len(met):
                    mine = np.full(len(met), k)
                    yield (mine, right[met], far[met]) if equal else (right[met], mine, far[met])


def _joined(own: DataFrame, within: float, group: str, exact: bool) -> DataFrame:
    kinds = dict(own.dtypes)
    names = ("distance",) if exact else ("n_i", "n_j")

    def rows(key: dict, a: Side, b: Side, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        i, j, far = (np.concatenate(f) for f in zip(*found, strict=True))
        turn = a.id[i] > b.id[j]
        ids = {"i": np.where(turn, b.id[j], a.id[i]), "j": np.where(turn, a.id[i], b.id[j])}
        more = {"distance": far} if exact else {"n_i": np.where(turn, b.n[j], a.n[i]), "n_j": np.where(turn, a.n[i], b.n[j])}
        return pa.RecordBatch.from_pydict({group: pa.repeat(key[group], len(i)), **ids, **more})

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        low, high = key[1], key[2]
        a = Side(table.filter(pc.equal(table["block"], low)))
        b = a if low == high else Side(table.filter(pc.equal(table["block"], high)))
        del table
        found, size = [], 0
        for pairs in _compared(a, b, within, exact):
            found.append(pairs if exact else (*pairs[:2], pairs[0]))
            size += len(pairs[0])
            if size >= ROWS:
                yield rows({group: key[0]}, a, b, found)
                found, size = [], 0
        if found:
            yield rows({group: key[0]}, a, b, found)

    met = blocks(own, within, group)
    schema = f"{group} {kinds[group]}, i {kinds['track_id']}, j {kinds['track_id']}, " + ", ".join(f"{n} {'double' if exact else 'long'}" for n in names)
    return met.groupBy(group, "low", "high").applyInArrow(meet, schema)


def bounded(own: DataFrame, within: float, group: str) -> DataFrame:
    """(group, i, j, n_i, n_j) of pairs of ``lines``, i < j, whose mean distance may be ``within`` by the boxes of all pieces."""
    return _joined(own, within, group, False)


def near_tracks(points: DataFrame, within: float, *, group: str = "cluster_id") -> DataFrame:
    """(group, i, j, distance, spatial): all pairs of tracks of a group, i < j, with a mean distance of ``within`` feet at most.

    The measure is that of the spatial likeness: points evenly picked from the longer track at the shorter one's number, and
    ``spatial`` = exp(-distance / 100).  Points without a place don't count, tracks without any are in no pair, nor are those without a
    group; repeated points of a place in the track go by their position; an empty table gives no row.  What is compared grows with the
    pairs near each other at one end, not with the square of a group.
    """
    own = cut(lines(points.where(F.col(group).isNotNull()), group))
    found = _joined(own, within, group, True)
    return found.select(group, "i", "j", "distance", F.exp(-F.col("distance") / SCALE).alias("spatial"))
