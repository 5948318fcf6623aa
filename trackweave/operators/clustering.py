"""Clustering of tracks: a registry of algorithms that run per group (an airport, a day), and the form for groups of any size.

Consensus lines and spectral clustering take groups of any size, all together.  For mean shift a group of at most ``EXACT`` tracks is
one task's work; larger ones go through rounds of jobs (``large_clusters``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut

from . import cluster_kernels as k
from . import large_clusters as lc
from . import lines
from . import pair_kernels as pk
from . import similarity as s
from . import spectral

#: Tracks in a group at most that one task takes.
EXACT = 700
#: Tracks of two pieces that are compared at once and points of one at most, rows of a batch of results, and partitions of meetings at most.
PAIRED, POINTS, ROWS, MEETINGS = 1_600, 100_000, 250_000, 20_000
#: Tracks and points of a block that a task holds at most, and blocks into which a group of several pieces is dealt at least, if it has
#: as many pieces.  Each track goes to all blocks of its group, so blocks are large.
HELD, HELD_POINTS, FEW = 12_000, 800_000, 6
#: Rows of likenesses of two tracks.
LIKENESS = "i long, j long, " + ", ".join(f"{m} double" for m in pk.MEASURES)

#: Algorithms with one form for groups of any size, all groups together: (group, track_id, cluster_id) from points and the group.
WHOLE: dict[str, Callable] = {
    "RANSAC": lines.bundles,
    "MLESAC": lambda points, group: lines.bundles(points, group, likelihood=True),
    "SCC": spectral.spectral,
    "LSCC": spectral.laplacian,
}
#: Algorithms that leave groups above ``EXACT`` tracks to k-means on features, as the ones they follow do.
BOUNDED = {"SCC", "LSCC"}
ALGORITHMS: dict[str, Callable] = {"MeanShift": lambda ids, tracks: k.mean_shift(tracks)}


def _feature_clusters(points: DataFrame) -> DataFrame:
    """Only places count, so speeds and times may be missing."""
    return features_kmeans(points.select("track_id", "seq", "x", "y", "z", F.lit(0.0).alias("v"), F.col("seq").cast("double").alias("t")))


def _by_size(points: DataFrame, group: str, most: int) -> tuple[DataFrame, list[tuple[object, DataFrame]], DataFrame]:
    """Points of the groups of at most ``most`` tracks, each larger group with its points, and all points of these with the place g of
    their group among the larger ones."""
    sizes = points.groupBy(group).agg(F.countDistinct("track_id").alias("n"))
    values = [r[group] for r in sizes.where(F.col("n") > most).collect()]
    large = [(v, points.where(F.col(group).eqNullSafe(F.lit(v)))) for v in values]
    number = F.lit(None).cast("int")
    for i, v in enumerate(values):
        number = F.when(F.col(group).eqNullSafe(F.lit(v)), i).otherwise(number)
    placed = points.withColumn("g", number)
    return placed.where("g is null").drop("g"), large, placed.where("g is not null")


def _named(found: DataFrame, group: str, kind: str, large: list[tuple[object, DataFrame]], *columns: str) -> DataFrame:
    """Rows by g with their group instead."""
    names = found.sparkSession.createDataFrame([(i, v) for i, (v, _) in enumerate(large)], f"g int, {group} {kind}")
    return found.join(F.broadcast(names), "g").select(group, F.col("track_id").cast("long").alias("track_id"), F.col("cluster_id").cast("int").alias("cluster_id"), *columns)


def cluster(points: DataFrame, algorithm: str, group: str = "grp", most: int | None = EXACT) -> DataFrame:
    """(group, algorithm, track_id, cluster_id, is_noise): the named algorithm on every group of points (track_id, seq, x, y, z).

    Groups above ``most`` tracks go to k-means on features for the spectral algorithms, one after the other, and to rounds of jobs
    for mean shift, all together; without ``most`` the spectral algorithms take groups of any size themselves.
    """
    if algorithm not in WHOLE and algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    kind = dict(points.dtypes)[group]
    points = points.select(group, "track_id", "seq", "x", "y", "z")
    large, together = [], None
    if most is not None and (algorithm in BOUNDED or algorithm in ALGORITHMS):
        points, large, together = _by_size(points, group, most)
    if algorithm in WHOLE:
        out = WHOLE[algorithm](points, group)
    else:
        run_ = ALGORITHMS[algorithm]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["track_id", "seq"])
            ids, tracks = zip(*((i, t[["x", "y", "z"]].to_numpy(dtype=float)) for i, t in pdf.groupby("track_id")), strict=True)
            return pd.DataFrame({group: pdf[group].iloc[0], "track_id": ids, "cluster_id": np.asarray(run_(list(ids), list(tracks))).astype("int32")})

        out = points.groupBy(group).applyInPandas(run, f"{group} {kind}, track_id long, cluster_id int")
    if large and algorithm not in BOUNDED:
        out, large = out.unionByName(_named(lc.mean_shift(together), group, kind, large)), []
    for v, p in large:
        found = _feature_clusters(p)
        out = out.unionByName(found.select(F.lit(v).cast(kind).alias(group), "track_id", F.col("cluster_id").cast("int").alias("cluster_id")))
    return out.select(group, F.lit(algorithm).alias("algorithm"), F.col("track_id").cast("long").alias("track_id"), "cluster_id", (F.col("cluster_id") < 0).alias("is_noise"))


def features_kmeans(points: DataFrame, seed: int = 42) -> DataFrame:
    """(track_id, cluster_id) by k-means on the 17 track features without the number of points, each track's vector brought to length
    1, for any number of tracks: k = sqrt(n / 2) in 2 to 12."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    f = cut(s.track_features(points).drop("points"))
    columns = [c for c in f.columns if c != "track_id"]
    n = f.count()
    if n < 2:
        return f.select("track_id", F.lit(0).alias("cluster_id"))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))) + s.EPS
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(f.select("track_id", *((F.col(c) / size).alias(c) for c in columns)))
    model = KMeans(k=int(min(12, max(2, (n / 2) ** 0.5))), seed=seed, maxIter=100).fit(x)
    return model.transform(x).select("track_id", F.col("prediction").alias("cluster_id"))


def compare(points: DataFrame, names: tuple[str, ...] = (*WHOLE, *ALGORITHMS), group: str = "grp") -> DataFrame:
    """algorithm, clusters, tracks, mean_size, quality, error: all algorithms on the same tracks; quality is the mean cosine likeness of
    the tracks to their cluster's direction.  An algorithm that fails is a row with its error and no numbers."""
    from functools import reduce

    from .geometry import direction

    found, errors = [], []
    for name in names:
        try:
            found.append(cut(cluster(points, name, group).where("not is_noise")))
        except Exception as failure:  # noqa: BLE001 - whatever goes wrong in one algorithm is its row
            errors.append((name, str(failure).splitlines()[0] if str(failure) else type(failure).__name__))
    failed = points.sparkSession.createDataFrame(errors, "algorithm string, error string")
    failed = failed.select("algorithm", *(F.lit(None).cast(t).alias(c) for c, t in (("clusters", "long"), ("tracks", "long"), ("mean_size", "double"), ("quality", "double"))), "error")
    if not found:
        return failed
    vec = reduce(DataFrame.unionByName, found).join(direction(points), "track_id").select("algorithm", F.concat_ws("/", "algorithm", group, "cluster_id").alias("label"), F.col("track_id").alias("vec_id"), F.array("ux", "uy", "uz").alias("vector"))
    q = s.quality(vec.select("label", "vec_id", "vector"), s.reference_direction(vec.select("label", "vec_id", "vector")))
    sizes = vec.groupBy("algorithm", "label").agg(F.count("*").alias("n")).join(q, "label")
    out = sizes.groupBy("algorithm").agg(F.count("*").alias("clusters"), F.sum("n").alias("tracks"), F.avg("n").alias("mean_size"), F.avg("quality").alias("quality"))
    return out.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def best_algorithm(compared: DataFrame, metric: str = "quality", largest: bool = True) -> DataFrame:
    pick = F.max_by if largest else F.min_by
    return compared.agg(pick("algorithm", metric).alias("algorithm"), (F.max if largest else F.min)(metric).alias(metric))


def merge_small(members: DataFrame, centres: DataFrame, most: int = 10) -> DataFrame:
    """(cluster_id, merged_id, size): the ``most`` largest clusters keep their id; the others, largest first, each go to the kept one
    whose centre is nearest, and move that centre by their tracks.

    A fold in order over the clusters' sizes and centres, one row of a few numbers a cluster; ties go to the smaller id, clusters
    without a centre to the largest.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size")).join(centres.select("cluster_id", "x", "y", "z"), "cluster_id", "left")
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "cluster_id", "size", "x", "y", "z"))).alias("c"))
    far = "if(r.x is null, 0D, coalesce(pow(s.x - r.x, 2) + pow(s.y - r.y, 2) + pow(s.z - r.z, 2), double('inf')))"
    near = f"array_min(transform(acc.kept, (s, i) -> struct({far} as d, i as at))).at"
    mean = ", ".join(f"'{c}', (s.{c} * s.size + coalesce(r.{c}, s.{c}) * r.size) / (s.size + r.size)" for c in "xyz")
    step = f"""transform(array({near}), k -> named_struct(
        'kept', transform(acc.kept, (s, i) -> if(i = k, named_struct('less', s.less, 'cluster_id', s.cluster_id, 'size', s.size + r.size, {mean}), s)),
        'out', concat(acc.out, array(named_struct('cluster_id', r.cluster_id, 'merged_id', acc.kept[k].cluster_id, 'size', r.size)))))[0]"""
    kept = f"transform(slice(c, 1, {most}), s -> named_struct('cluster_id', s.cluster_id, 'merged_id', s.cluster_id, 'size', s.size))"
    fold = f"aggregate(slice(c, {most + 1}, greatest(0, size(c) - {most})), named_struct('kept', slice(c, 1, {most}), 'out', {kept}), (acc, r) -> {step}, acc -> acc.out)"
    return listed.select(F.inline(F.expr(fold)))


def centres(points: DataFrame) -> DataFrame:
    """Mean of the tracks' means by cluster (points with cluster_id)."""
    per = points.groupBy("cluster_id", "track_id").agg(*(F.avg(c).alias(c) for c in "xyz"))
    return per.groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in "xyz"))


def _tracks(points: DataFrame, group: str) -> DataFrame:
    """(group, track_id, n, xs, ys, zs): a track's places in order and their number; null ones are NaN."""
    p = points.groupBy(group, "track_id").agg(F.array_sort(F.collect_list(F.struct("seq", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xyz")))).alias("p"))
    return p.select(group, "track_id", F.size("p").alias("n"), *(F.expr(f"transform(p, q -> q.{c})").alias(f"{c}s") for c in "xyz"))


def _arrays(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and places of tracks."""
    columns = [[v.values.to_numpy() for v in table[f"{c}s"]] for c in "xyz"]
    return table["track_id"].to_numpy(), [np.column_stack(p) for p in zip(*columns, strict=True)]


def _pieces(tracks: list[np.ndarray], most: int) -> list[slice]:
    """Even pieces of at most ``most`` tracks, as short as ``POINTS`` asks for."""
    many = max(1, -(-len(tracks) // most), -(-sum(map(len, tracks)) // POINTS))
    ends = [len(tracks) * k // many for k in range(many + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def _dealt(tracks: DataFrame, group: str, most: int, held: int) -> tuple[DataFrame, int]:
    """``_tracks`` with the pairs of blocks (left, right) in which each takes part, as ``own``, and the number of these pairs.  Blocks have
    about ``held`` tracks and ``HELD_POINTS`` points; a group of more than one piece has ``FEW`` blocks, if it has as many pieces."""
    pieces = F.greatest(F.ceil(2 * F.count("*") / F.lit(max(1, most))), F.ceil(F.sum("n") / POINTS))
    large = F.greatest(F.ceil(F.count("*") / F.lit(held)), F.ceil(F.sum("n") / HELD_POINTS))
    parts = tracks.groupBy(F.col(group).alias("__group")).agg(F.greatest(large, F.least(pieces, F.lit(FEW).cast("long"))).alias("parts"))
    dealt = tracks.join(F.broadcast(parts), F.col(group).eqNullSafe(F.col("__group"))).withColumn("own", F.pmod(F.xxhash64("track_id"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(group, "track_id", "xs", "ys", "zs", "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    return dealt, parts.agg(F.sum(F.expr("parts * (parts + 1) / 2")).cast("long").alias("n")).first().n or 1


def _measured(tracks: DataFrame, group: str, most: int, held: int = HELD) -> DataFrame:
    """(i, j, measures) of all pairs of ``_tracks`` in each group, i < j: two blocks meet in a task, and there pieces of ``most`` / 2 tracks
    as arrays."""
    dealt, pairs = _dealt(tracks, group, most, held)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        low, high = key[1], key[2]
        ids, tracks = _arrays(table.filter(pc.equal(table["own"], low)))
        others, far = (ids, tracks) if low == high else _arrays(table.filter(pc.equal(table["own"], high)))
        del table
        step = max(1, most // 2)
        for p in _pieces(tracks, step):
            for q in _pieces(far, step):
                if low == high and q.start < p.start:
                    continue
                found = pk.measured(tracks[p], far[q])
                i, j = np.nonzero(ids[p, None] < others[q] if low == high and p == q else np.ones((p.stop - p.start, q.stop - q.start), bool))
                for first in range(0, len(i), ROWS):
                    a, b = i[first : first + ROWS], j[first : first + ROWS]
                    left, right = ids[p][a], others[q][b]
                    yield pa.RecordBatch.from_pydict({"i": np.minimum(left, right), "j": np.maximum(left, right), **{name: f[a, b] for name, f in found.items()}})

    # A pair of blocks is small to store and long to compare, so the number of parts goes by pairs of blocks, not by bytes; several
    # parts a pair, so that few share one.
    dealt = dealt.repartition(min(MEETINGS, max(tracks.sparkSession.sparkContext.defaultParallelism, 4 * pairs)), group, "left", "right")
    return dealt.groupBy(group, "left", "right").applyInArrow(meet, LIKENESS)


def similarities(points: DataFrame, group: str = "grp", most: int = PAIRED) -> DataFrame:
    """(i, j, curvature, spatial, shape, polar, multiscale) of all pairs of tracks in each group, i < j."""
    return _measured(cut(_tracks(points, group)), group, most)


def similarity_classes(points: DataFrame, group: str = "grp", most: int = PAIRED) -> DataFrame:
    """(i, j, curvature, spatial, shape, polar, multiscale, copy): rows of ``similarities`` for all pairs of different tracks, each class
    of equal tracks of a group standing under its smallest id, and with ``copy`` one row from that id to every other member of its class.

    Equal tracks have the same places in the same order, so any pair of ``similarities`` has the measures of its classes' pair, or of
    its class's own row.
    """
    tracks = _tracks(points, group)
    tracks = cut(tracks.withColumn("__key", F.sha2(F.concat_ws(";", *(F.col(f"{c}s").cast("string") for c in "xyz")), 256)))
    classes = cut(tracks.groupBy(F.col(group).alias("__group"), F.col("__key").alias("__same")).agg(F.min("track_id").alias("first"), F.count("*").alias("size")))
    held = tracks.join(classes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__key") == F.col("__same")))
    first = cut(held.where("track_id = first").select(group, "track_id", "n", "xs", "ys", "zs", "size"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _arrays(pa.Table.from_batches([batch]))
            rows = [pk.measured([t], [t]) for t in found]
            yield pa.RecordBatch.from_pydict({"__first": ids, **{m: np.array([r[m][0, 0] for r in rows], dtype=float) for m in pk.MEASURES}})

    names = list(pk.MEASURES)
    itself = first.where("size > 1").select("track_id", "xs", "ys", "zs").mapInArrow(own, "__first long, " + ", ".join(f"{m} double" for m in names))
    copies = held.where("track_id > first").select(F.col("first").alias("i"), F.col("track_id").alias("j")).join(itself, F.col("i") == F.col("__first"))
    pairs = _measured(first.drop("size"), group, most)
    return pairs.withColumn("copy", F.lit(False)).unionByName(copies.select("i", "j", *names, F.lit(True).alias("copy")))


def representative_lines(points: DataFrame, tracks: int = 30, steps: int = 60) -> DataFrame:
    """(cluster_id, step, x, y, z): the mean of each cluster's first ``tracks`` tracks brought to ``steps`` points."""
    from pyspark.sql import Window

    from .geometry import resample

    own = points.select("cluster_id", "track_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("track_id"))).where(F.col("r") <= tracks)
    return resample(points.join(own, ["cluster_id", "track_id"], "left_semi"), steps, ("cluster_id", "track_id")).groupBy("cluster_id", "step").agg(*(F.avg(c).alias(c) for c in "xyz"))


def zones_of(centre: DataFrame, cells: int = 20) -> DataFrame:
    """(gx, gy, cluster_id): the nearest centre of every cell of a grid over the centres' extent; the grid is broadcast."""
    box = centre.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    axis = F.sequence(F.lit(0), F.lit(cells - 1))
    grid = box.select("*", F.explode(axis).alias("gx")).select("*", F.explode(axis).alias("gy"))
    grid = grid.select("gx", "gy", F.expr(f"x0 + (x1 - x0) * (gx + 0.5D) / {cells}").alias("px"), F.expr(f"y0 + (y1 - y0) * (gy + 0.5D) / {cells}").alias("py"))
    near = centre.select("cluster_id", "x", "y").join(F.broadcast(grid))
    return near.groupBy("gx", "gy").agg(F.min_by("cluster_id", F.struct(F.expr("pow(x - px, 2) + pow(y - py, 2)"), "cluster_id")).alias("cluster_id"))


def adaptive_mean_shift(points: DataFrame, group: str = "grp", widths: tuple[float, ...] = tuple(k / 20 for k in range(1, 11)), clusters: int = 10, most: int = EXACT) -> DataFrame:
    """The mean-shift labels of the bandwidth in ``widths`` with the best 0.6 * mean share + 0.4 / (1 + var(size) / clusters), by
    group; bandwidths without a cluster or with more than ``clusters`` don't count, and if none is left all tracks are noise.  Groups above
    ``most`` tracks go by rounds of jobs, all together."""
    points, large, together = _by_size(points, group, most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tracks = zip(*((i, t[["x", "y", "z"]].to_numpy(dtype=float)) for i, t in pdf.sort_values(["track_id", "seq"]).groupby("track_id")), strict=True)
        best = (0.0, np.full(len(tracks), -1))
        for w in widths:
            label = k.mean_shift(list(tracks), width=w)
            sizes = np.bincount(label[label >= 0])
            sizes = sizes[sizes > 0]
            if not 0 < len(sizes) <= clusters:
                continue
            score = 0.6 * float((sizes / len(label)).mean()) + 0.4 / (1 + float(sizes.var()) / len(sizes))
            if score > best[0]:
                best = (score, label)
        return pd.DataFrame({group: pdf[group].iloc[0], "track_id": ids, "cluster_id": best[1].astype("int32"), "score": best[0]})

    kind = dict(points.dtypes)[group]
    out = points.select(group, "track_id", "seq", "x", "y", "z").groupBy(group).applyInPandas(run, f"{group} {kind}, track_id long, cluster_id int, score double")
    if large:
        out = out.unionByName(_named(lc.adaptive(together, widths, clusters), group, kind, large, "score"))
    return out


def merged_sums(values: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """merged_id, total: a column summed over the clusters that were merged."""
    return values.join(merged.select("cluster_id", "merged_id"), "cluster_id").groupBy("merged_id").agg(F.sum(column).alias("total"))


def representative_track(members: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: the top anomaly of the first cluster that has one, else the first track of the largest cluster."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("track_id").alias("track_id"))
    first = anomalies.where("rank = 1").select(F.lit(0).alias("turn"), F.col("cluster_id").cast("long").alias("place"), "track_id")
    return first.unionByName(sizes.select(F.lit(1).alias("turn"), (-F.col("size")).alias("place"), "track_id")).orderBy("turn", "place", "track_id").limit(1).select("track_id")
