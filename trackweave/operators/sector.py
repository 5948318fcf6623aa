"""Sectors around clusters: boxes, altitude limits, entry and exit fixes, zone conflicts, and hulls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.functions.quantiles import quantiles

from . import kernels
from .boxes import touching

XY_BUFFER, Z_BUFFER = 1215.2, 300.0

e = F.expr


def cluster_points(points: DataFrame, members: DataFrame) -> DataFrame:
    return points.join(members, "track_id")


def sector_bounds(points: DataFrame, least: int = 4) -> DataFrame:
    """Buffered box, floor and ceiling of clusters (points with cluster_id) of ``least`` points or more."""
    g = points.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        *((F.min(c) - b).alias(f"min_{c}") for c, b in (("x", XY_BUFFER), ("y", XY_BUFFER), ("z", Z_BUFFER))),
        *((F.max(c) + b).alias(f"max_{c}") for c, b in (("x", XY_BUFFER), ("y", XY_BUFFER), ("z", Z_BUFFER))),
    )
    limits = quantiles(points, ["cluster_id"], {"low": (F.col("z"), 0.02), "high": (F.col("z"), 0.98)})
    limits = limits.select("cluster_id", F.greatest(F.lit(0.0), F.col("low") - Z_BUFFER).alias("floor_ft"), (F.col("high") + Z_BUFFER).alias("ceiling_ft"))
    return g.where(F.col("n") >= least).drop("n").join(limits, "cluster_id").withColumn("volume", e("(max_x - min_x) * (max_y - min_y) * (max_z - min_z)"))


def boundary_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """kind, track_id, cluster_id, x, y, z: each track's first and last point inside its cluster's box."""
    inside = points.join(boxes, "cluster_id").where("x between min_x and max_x and y between min_y and max_y and z between min_z and max_z")
    g = inside.groupBy("cluster_id", "track_id").agg(*(F.min_by(c, "seq").alias(f"a{c}") for c in "xyz"), *(F.max_by(c, "seq").alias(f"b{c}") for c in "xyz"))
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), *(F.col(f"{p}{c}").alias(c) for c in "xyz")) for kind, p in (("ENTRY", "a"), ("EXIT", "b"))))
    return g.select("cluster_id", "track_id", F.inline(rows))


def fixes(boundary: DataFrame, eps: float = 2500.0) -> DataFrame:
    """One row for each group of boundary points that are linked by steps of ``eps`` at most (two points or more); all of a
    cluster's points make one fix if there is no such group.  Groups are components of a graph of grid cells."""
    linked = eps_components(boundary.withColumn("node", F.concat_ws("/", "cluster_id", "kind", "track_id")), ["cluster_id", "kind"], eps)
    sizes = linked.groupBy("cluster_id", "kind", "comp").agg(F.count("*").alias("n"))
    several = sizes.groupBy("cluster_id", "kind").agg(F.max((F.col("n") > 1).cast("int")).alias("any"))
    own = linked.join(sizes.join(several, ["cluster_id", "kind"]).hint("merge"), ["cluster_id", "kind", "comp"])
    kept = own.where("n > 1 or any = 0").withColumn("group", e("if(any = 0, '', comp)"))
    centre = kept.groupBy("cluster_id", "kind", "group").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"), F.countDistinct("track_id").alias("track_count"))
    far = kept.join(centre.hint("merge"), ["cluster_id", "kind", "group"]).groupBy("cluster_id", "kind", "group").agg(F.max(e("sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))")).alias("radius_ft"))
    named = centre.join(far.hint("merge"), ["cluster_id", "kind", "group"]).withColumn("k", F.row_number().over(Window.partitionBy("cluster_id", "kind").orderBy(F.desc("track_count"), "group")))
    return named.select("cluster_id", "kind", F.concat("kind", F.lit("-"), F.col("cluster_id"), F.lit("-"), F.col("k")).alias("name"), *(F.col(f"c{c}").alias(c) for c in "xyz"), "radius_ft", "track_count")


def _boxed(rows: DataFrame, keys: list[str], side: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the cell (gx, gy, gz) of a grid of ``side``, and one row a cell with its points' box and smallest node."""
    cell = rows.withColumns({f"g{c}": F.floor(F.col(c) / side) for c in "xyz"})
    return cell, cell.groupBy(*keys, "gx", "gy", "gz").agg(F.min("node").alias("name"), *(f(c).alias(f"{m}{c}") for c in "xyz" for m, f in (("l", F.min), ("h", F.max))))


def _gap(a: str, b: str) -> str:
    """Squared distance between two boxes."""
    return " + ".join(f"pow(greatest(0D, {a}.l{c} - {b}.h{c}, {b}.l{c} - {a}.h{c}), 2)" for c in "xyz")


def _span(a: str, b: str) -> str:
    """Squared distance at most between points of two boxes."""
    return " + ".join(f"pow(greatest({a}.h{c} - {b}.l{c}, {b}.h{c} - {a}.l{c}), 2)" for c in "xyz")


def eps_edges(rows: DataFrame, keys: list[str], eps: float, parts: int = 4) -> DataFrame:
    """(a, b) of smallest nodes of cells, which link the same rows as all pairs closer than ``eps`` would.

    All rows of a cell of diagonal ``eps`` are linked, so only cells need edges, each with its 62 later neighbours.  Boxes of
    the rows decide most: too far apart, or near at any two rows.  The undecided are split into ``parts`` a side; only where these
    don't decide either, rows near the other's box are compared one by one.  So a crowded place never makes all of its pairs.
    """
    near, most = range(-2, 3), eps * eps
    marked, boxes = _boxed(rows, keys, eps / 3**0.5 * (1 - 1e-9))
    boxes = cut(boxes)
    later = [(i, j, k) for i in near for j in near for k in near if (i, j, k) > (0, 0, 0)]
    steps = F.array(*(F.struct(*(F.lit(v).alias(f"s{c}") for c, v in zip("xyz", s, strict=True))) for s in later))
    left = boxes.withColumn("step", F.explode(steps)).withColumns({f"g{c}": F.col(f"g{c}") + F.col(f"step.s{c}") for c in "xyz"}).drop("step")
    same = " and ".join(f"a.{c} = b.{c}" for c in (*keys, "gx", "gy", "gz"))
    met = cut(left.alias("a").join(boxes.hint("merge").alias("b"), e(same)).where(f"{_gap('a', 'b')} <= {most}").selectExpr("a.name as a", "b.name as b", f"{_span('a', 'b')} <= {most} as sure"))
    sure = met.where("sure").select("a", "b")
    open_ = met.where("not sure").select("a", "b")
    if not open_.limit(1).count():
        return sure
    own = marked.join(boxes.select(*keys, "gx", "gy", "gz", "name").hint("merge"), [*keys, "gx", "gy", "gz"]).select("name", "node", "x", "y", "z")
    own = own.join(open_.selectExpr("explode(array(a, b)) as name").distinct().hint("merge"), "name")
    small, fine = _boxed(own.withColumnRenamed("name", "cell"), ["cell"], eps / 3**0.5 / parts)
    fine, small = cut(fine), small.select("cell", "node", "x", "y", "z", "gx", "gy", "gz")
    split = open_.alias("p").join(fine.hint("merge").alias("a"), e("p.a = a.cell")).join(fine.hint("merge").alias("b"), e("p.b = b.cell")).where(f"{_gap('a', 'b')} <= {most}")
    split = cut(split.selectExpr("p.a", "p.b", "a.name as fa", "b.name as fb", f"{_span('a', 'b')} <= {most} as sure"))
    certain = split.where("sure").select("a", "b").distinct()
    rest = split.where("not sure").join(certain.hint("merge"), ["a", "b"], "left_anti")
    points = small.join(fine.select("cell", "gx", "gy", "gz", "name").hint("merge"), ["cell", "gx", "gy", "gz"]).select("name", "node", "x", "y", "z")
    box = fine.select("name", *(f"{m}{c}" for c in "xyz" for m in "lh"))
    outside = " + ".join(f"pow(greatest(0D, q.l{c} - r.{c}, r.{c} - q.h{c}), 2)" for c in "xyz")

    def side(mine: str, other: str) -> DataFrame:
        """Rows of one side of the open pairs that are near the other side's box."""
        at = rest.alias("p").join(points.hint("merge").alias("r"), e(f"p.{mine} = r.name")).join(box.hint("merge").alias("q"), e(f"p.{other} = q.name")).where(f"{outside} <= {most}")
        return at.select("p.a", "p.b", "fa", "fb", "r.x", "r.y", "r.z")

    same = " and ".join(f"u.{c} = v.{c}" for c in ("a", "b", "fa", "fb"))
    close = side("fa", "fb").alias("u").join(side("fb", "fa").hint("merge").alias("v"), e(same)).where(" + ".join(f"pow(u.{c} - v.{c}, 2)" for c in "xyz") + f" <= {most}")
    return sure.unionByName(certain).unionByName(close.select("u.a", "u.b").distinct())


def eps_components(rows: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """``rows`` (node, x, y, z) with ``comp``, the smallest node of its connected part of the graph of steps of ``eps``; a row without a
    place is alone."""
    from .graph import components

    rows = cut(rows)
    placed = rows.where("x is not null and y is not null and z is not null")
    marked, boxes = _boxed(placed, keys, eps / 3**0.5 * (1 - 1e-9))
    comps = components(eps_edges(placed, keys, eps)).withColumnRenamed("node", "name")
    own = marked.join(boxes.select(*keys, "gx", "gy", "gz", "name").hint("merge"), [*keys, "gx", "gy", "gz"]).join(comps.hint("merge"), "name", "left")
    return rows.join(own.select("node", F.coalesce("comp", "name").alias("comp")).hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def zone_conflicts(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """(cluster_id, zone): boxes that touch a zone; zones without all bounds touch nothing."""
    return touching(boxes, zones).select(F.col("a_cluster_id").alias("cluster_id"), F.col("b_id").alias("zone"))


def trimmed(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """Boxes cut back from each touching zone in order, along the axis with the smallest positive overlap; a cut that would
    empty the box is undone.

    A cut box lies inside the uncut one, so the zones that touch it are among those that touched it before any cut.
    """
    met = touching(boxes, zones).select(F.col("a_cluster_id").alias("cluster_id"), F.struct(*(F.col(f"b_{c}").alias(c) for c in ("id", *(f"{m}_{a}" for a in "xyz" for m in ("min", "max"))))).alias("z"))
    listed = met.groupBy("cluster_id").agg(F.array_sort(F.collect_list("z")).alias("zones"))
    state = "struct(min_x, max_x, min_y, max_y, min_z, max_z)"
    touch = " and ".join(f"b.min_{c} <= z.max_{c} and z.min_{c} <= b.max_{c}" for c in "xyz")
    over = {c: f"(least(b.max_{c}, z.max_{c}) - greatest(b.min_{c}, z.min_{c}))" for c in "xyz"}
    positive = {c: f"if({over[c]} > 0, {over[c]}, double('inf'))" for c in "xyz"}
    least = f"least({', '.join(positive.values())})"
    cut = "case "
    for c in "xyz":
        below = f"(b.min_{c} + b.max_{c}) / 2 <= (z.min_{c} + z.max_{c}) / 2"
        low, high = f"if({below}, b.min_{c}, greatest(b.min_{c}, z.max_{c}))", f"if({below}, least(b.max_{c}, z.min_{c}), b.max_{c})"
        fields = ", ".join(f"'min_{a}', {low if a == c else f'b.min_{a}'}, 'max_{a}', {high if a == c else f'b.max_{a}'}" for a in "xyz")
        cut += f"when {positive[c]} = {least} then if({low} < {high}, named_struct({fields}), b) "
    fold = f"if(zones is null, {state}, aggregate(zones, {state}, (b, z) -> if({touch} and {least} < double('inf'), {cut} else b end, b)))"
    return boxes.join(listed, "cluster_id", "left").withColumn("box", e(fold)).select("cluster_id", *(F.col(f"box.{m}_{c}").alias(f"{m}_{c}") for c in "xyz" for m in ("min", "max")))


def hulls(points: DataFrame, most: int | None = 5000, chunk: int = 5000) -> DataFrame:
    """cluster_id, volume, vertices, equations (outward normals and offsets), footprints and their areas, degenerate: of an even sample of
    ``most`` points of each cluster (points with cluster_id), or without ``most`` of all its points.

    All points of a cluster go through rounds of partial hulls: about ``chunk`` of them in a task leave the corners of their hull,
    and the corners are dealt anew until a cluster's fit one task.
    """
    from .selection import even_sample

    rows = points if most is None else even_sample(points, most, ("cluster_id",), ("track_id", "seq"))
    rows = rows.select("cluster_id", "x", "y", "z")
    while most is None:
        sizes = cut(rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / chunk).alias("parts")))
        before = sizes.agg(F.max("parts").alias("m"), F.sum("parts").alias("s")).first()
        if (before.m or 0) <= 1:
            break
        dealt = rows.join(sizes, "cluster_id").withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.col("parts")))
        rows = cut(dealt.groupBy("cluster_id", "part").applyInPandas(kernels.outermost_rows, "cluster_id int, x double, y double, z double"))
        if rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / chunk).alias("parts")).agg(F.sum("parts")).first()[0] >= before.s:
            chunk *= 2
    schema = "cluster_id int, volume double, vertices array<array<double>>, equations array<array<double>>, area_xy double, area_xz double, area_yz double, footprint_xy array<array<double>>, footprint_xz array<array<double>>, footprint_yz array<array<double>>, degenerate boolean"
    return rows.groupBy("cluster_id").applyInPandas(kernels.hull_rows, schema)


def inside_hull(points: DataFrame, hull: DataFrame, buffer: float = XY_BUFFER, chunk: int = 100_000) -> DataFrame:
    """Points (with cluster_id) no further than ``buffer`` outside any face of their cluster's hull; a degenerate hull has no
    faces and holds no point back.

    A cluster's points are dealt into parts of about ``chunk``, each of which meets the faces as arrays: points that lie together meet only the faces that their box isn't wholly behind.
    """
    parts = points.groupBy("cluster_id").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    own = points.join(parts, "cluster_id").withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), "parts")).drop("parts")
    # The hull may come from the same points, so its side has names of its own.
    several = parts.select(F.col("cluster_id").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("slot"))
    faces = hull.where("equations is not null").select(F.col("cluster_id").alias("held"), "equations").join(several, F.col("held") == F.col("own")).select("held", "slot", "equations")
    schema = points.schema

    def held(table: pa.Table, planes: pa.Table) -> pa.Table:
        table = table.select(schema.names)
        if not planes.num_rows:
            return table.slice(0, 0)
        faces_ = np.array(planes["equations"][0].as_py(), dtype=float).reshape(-1, 4)
        return table.filter(pa.array(kernels.within(np.column_stack([table[c].to_numpy() for c in "xyz"]).astype(float), faces_, buffer)))

    return own.groupBy("cluster_id", "part").cogroup(faces.groupBy("held", "slot")).applyInArrow(held, schema)
