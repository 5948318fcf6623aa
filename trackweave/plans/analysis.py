"""The full analysis of a set of tracks: clusters, sectors, workload, runways, centroids, checks, anomalies and totals."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.operators import clustering as cl
from trackweave.operators import procedure as pr
from trackweave.operators import rules as ru
from trackweave.operators import runway as rw
from trackweave.operators import sector as sc
from trackweave.operators import workload as wl


@dataclass(frozen=True)
class Analysis:
    members: DataFrame
    sectors: DataFrame
    hulls: DataFrame
    fixes: DataFrame
    occupancy: DataFrame
    metrics: DataFrame
    conflicts: DataFrame
    workload: DataFrame
    arrivals: DataFrame
    sequence: DataFrame
    runways: DataFrame
    routes: DataFrame
    centroids: DataFrame
    pbn: DataFrame
    quality: DataFrame
    waypoints: DataFrame
    geojson: DataFrame
    anomalies: DataFrame
    anomaly_statistics: DataFrame
    overall_risk: DataFrame
    risks: DataFrame
    risk_totals: DataFrame
    what_if: DataFrame
    statistics: DataFrame
    #: Sums of a table that isn't stored, by cluster: conflicts grow with the square of the traffic.
    conflict_sums: DataFrame = field(metadata={"sums": "conflicts"})


def clustered_members(points: DataFrame, algorithm: str = "MLESAC", group: str = "grp") -> DataFrame:
    """(cluster_id, track_id): the clusters of every group, numbered through all groups."""
    found = cut(cl.cluster(points, algorithm, group).where("not is_noise").select(group, "cluster_id", "track_id"))
    numbers = found.select(group, "cluster_id").distinct().groupBy().agg(F.sort_array(F.collect_list(F.struct(group, "cluster_id"))).alias("c")).select(F.posexplode("c").alias("number", "c"))
    return found.join(F.broadcast(numbers.select("number", f"c.{group}", "c.cluster_id")), [group, "cluster_id"]).select(F.col("number").cast("int").alias("cluster_id"), "track_id")


def analyse(points: DataFrame, tracks: DataFrame, members: DataFrame, zones: DataFrame | None = None, *, conflict_window: float = 60.0, sigma: float | None = None) -> Analysis:
    """All result tables, lazily, from points, track headers and cluster members.

    Points, sectors, their samples, centroids and the tables that several others read are cut once.  Conflicts aren't stored: one pass
    over them leaves the sums that workload and digest need.
    """
    grouped = cut(sc.cluster_points(points, members))
    boxes = sc.sector_bounds(grouped)
    if zones is not None:
        limits = boxes.select("cluster_id", "floor_ft", "ceiling_ft", "volume")
        boxes = sc.trimmed(boxes, zones.dropna(subset=[f"{m}_{c}" for c in "xyz" for m in ("min", "max")])).join(limits, "cluster_id")
    boxes, hulls = cut(boxes), cut(sc.hulls(grouped, None))
    # The hull of all points of a cluster holds each of them, so no point of it is outside a face.
    inside = cut(wl.samples(grouped, boxes))
    metrics = cut(wl.track_metrics(inside, tracks))
    conflicts = wl.conflicts(inside, window=conflict_window)
    summed = cut(conflicts.groupBy("cluster_id").agg(*_sums(conflicts)))
    load = cut(wl.index(boxes, inside, metrics, summed.select("cluster_id", F.col("rows").alias("conflicts"))))
    arrived = cut(rw.arrivals(points, tracks, members))
    ordered = cut(rw.sequence(arrived))
    centroid = cut(pr.modelled(pr.aligned(grouped), sigma))
    fixes = cut(sc.fixes(sc.boundary_points(grouped, boxes)))
    found = cut(pr.anomalies(pr.deviations(grouped, centroid)))
    risk = cut(ru.risks(points, tracks))
    way = cut(pr.waypoints(centroid, fixes, grouped))
    statistics = load.agg(F.count("*").alias("clusters"), F.sum("conflicts").alias("conflicts"), F.max("workload").alias("max_workload")).crossJoin(found.agg(F.count("*").alias("tracks"), F.sum(F.col("is_anomaly").cast("long")).alias("anomalies"))).crossJoin(risk.agg(F.count("*").alias("risks"), F.countDistinct("track_id").alias("risky_tracks")))
    return Analysis(
        members=members,
        sectors=boxes,
        hulls=hulls,
        fixes=fixes,
        occupancy=wl.occupancy(inside),
        metrics=metrics,
        conflicts=conflicts,
        workload=load,
        arrivals=arrived,
        sequence=ordered,
        runways=rw.summary(arrived, ordered),
        routes=rw.recovery_routes(points, arrived, ordered),
        centroids=centroid,
        pbn=pr.pbn_checks(centroid),
        quality=pr.quality(grouped, centroid),
        waypoints=way,
        geojson=pr.geojson(way),
        anomalies=found,
        anomaly_statistics=pr.anomaly_statistics(found),
        overall_risk=pr.overall_risk(found),
        risks=risk,
        risk_totals=ru.totals(risk, members),
        what_if=pr.what_if(load),
        statistics=statistics,
        conflict_sums=summed,
    )


def _sums(frame: DataFrame) -> list[Column]:
    """rows, numbers, total, characters: rows of a table, its numbers that aren't null, their sum, and the length of everything else."""
    numbers = [c for c, kind in frame.dtypes if kind in ("double", "int", "bigint")]
    finite = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < 1e300), F.col(c).cast("double")) for c in numbers]
    others = [F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) for c in frame.columns if c not in numbers]
    total = reduce(lambda a, b: a + b, (F.coalesce(F.sum(c), F.lit(0.0)) for c in finite), F.lit(0.0))
    count = reduce(lambda a, b: a + b, (F.count(c) for c in finite), F.lit(0))
    text = reduce(lambda a, b: a + b, others, F.lit(0))
    return [F.count("*").alias("rows"), count.cast("long").alias("numbers"), total.alias("total"), text.cast("long").alias("characters")]


def digest(analysis: Analysis) -> DataFrame:
    """(result, rows, numbers, total, characters): every table's rows, its numbers that aren't null, and their sum, so all are computed."""
    summed = {f.metadata["sums"]: getattr(analysis, f.name) for f in fields(analysis) if "sums" in f.metadata}
    parts = []
    for f in (f for f in fields(analysis) if "sums" not in f.metadata):
        if f.name in summed:
            found = summed[f.name].agg(*(F.coalesce(F.sum(c), F.lit(zero)).alias(c) for c, zero in (("rows", 0), ("numbers", 0), ("total", 0.0), ("characters", 0))))
        else:
            frame = getattr(analysis, f.name)
            found = frame.agg(*_sums(frame))
        parts.append(found.select(F.lit(f.name).alias("result"), "rows", "numbers", F.round("total", 2).alias("total"), "characters"))
    return reduce(DataFrame.unionByName, parts)
