"""Spatial joins as equi-joins on grid cells, followed by the exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.geodesic import spheroid_m
from .components import connected_components
from .fuzzy import top
from .subdivide import pieces
from .tables import discard, save

#: Degrees around a region that still belong to it: its boundary generalises the coast.
REGION_BUFFER = 0.003


#: So many pieces of areas, of some 32 edges each, are broadcast.
FEW_PIECES = 10_000
#: From so many points a place, places are decided instead of points.
COPIES = 2

#: No two places are farther apart on the sphere than so many times their distance on the spheroid.
SPHERE_EXCESS = 1.006


def within(points: DataFrame, features: DataFrame, radius_m: float, size: float | None = None, spheroid: bool = False) -> DataFrame:
    """Pairs of ``points`` (point_id, lon, lat) and ``features`` (id, lon, lat) at most radius_m apart, or at most each
    point's own ``radius_m``, if there is such a column and it is less: point_id, id, distance_m. Distances are those on
    the sphere, or on the spheroid, which is measured for the pairs that are near enough on the sphere."""
    size = size or max(radius_m / (math.pi * G.EARTH_M / 180), 1e-4)
    reach = F.least(F.col("radius_m"), F.lit(float(radius_m))) if "radius_m" in points.columns else F.lit(float(radius_m))
    wide = reach * SPHERE_EXCESS if spheroid else reach
    p = points.select("point_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), reach.alias("reach"), F.explode(G.cells_near(F.col("lon"), F.col("lat"), wide, size)).alias("cell"))
    f = features.select("id", F.col("lon").alias("flon"), F.col("lat").alias("flat"), G.cell_of(F.col("lon"), F.col("lat"), size).alias("cell"))
    ends = [F.col(c) for c in ("plon", "plat", "flon", "flat")]
    pairs = p.join(f, "cell").select("point_id", "id", "reach", *ends, G.haversine_m(*ends).alias("distance_m"))
    if spheroid:
        pairs = pairs.filter(F.col("distance_m") <= F.col("reach") * SPHERE_EXCESS).withColumn("distance_m", spheroid_m(*ends))
    pairs = pairs.drop("plon", "plat", "flon", "flat")
    return pairs.filter(F.col("distance_m") <= F.col("reach")).drop("reach")


def nearest(points: DataFrame, features: DataFrame, k: int, radius_m: float, size: float | None = None) -> DataFrame:
    """The k nearest features of each point within the radius: point_id, id, distance_m, rank."""
    return top(within(points, features, radius_m, size), ["point_id"], [F.col("distance_m"), F.col("id")], k)


def containing(points: DataFrame, areas: DataFrame, size: float | None = None, buffer: float = 0.0, spread: bool = True) -> DataFrame:
    """Pairs of ``points`` (point_id, lon, lat) and ``areas`` (area_id, rings) that contain them, boundaries included, or
    whose boundary is at most ``buffer`` degrees away.

    Without a buffer, areas are cut into pieces of a bounded number of edges (:mod:`.subdivide`), and a point meets the
    pieces of its own cell, once for each width of cell in use. ``size`` plays no part then. ``spread`` is for
    :func:`.subdivide.pieces`.

    With one, an area is listed under the cells of its bounding box, widened by the buffer, each time with those of its
    edges alone that a ray to the east from the cell can meet, or that are within the buffer: the cell's own band of
    latitude, from the cell on. Cells are ``size`` degrees wide; without a size, an area's cells are the power of two
    next to a quarter of its extent, so that a country and a village have as many, and a point is looked up once
    for each of the widths in use (22 at the most, from 2^-15 to 2^6 degrees).
    """
    if not buffer:
        return _in_pieces(points, areas, spread)
    edges = F.col("edges")
    bound = lambda pick, *axes: pick(F.flatten(F.transform(edges, lambda e: F.array(*(e[x] for x in axes)))))
    # Listing costs some milliseconds an area, so a small file of areas is spread over the tasks of a shuffle first.
    spread = areas.select("area_id", "rings").repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")), "area_id")
    drawn = spread.select("area_id", G.ring_edges(F.col("rings")).alias("edges")).filter(F.size("edges") > 0)
    drawn = drawn.select("area_id", "edges", *(bound(pick, f"{axis}1", f"{axis}2").alias(f"{axis}_{name}") for axis in "xy" for name, pick in (("low", F.array_min), ("high", F.array_max))))
    extent = F.greatest(F.col("x_high") - F.col("x_low"), F.col("y_high") - F.col("y_low"))
    level = F.lit(0) if size else F.least(F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)))) - 2, F.lit(-15)), F.lit(6)).cast("int")
    drawn = drawn.withColumn("level", level)
    levels = [0] if size else sorted(r.level for r in drawn.select("level").distinct().collect())
    wide = F.lit(float(size)) if size else F.pow(F.lit(2.0), F.col("level"))
    cell = lambda value: F.floor(value / F.col("wide")).cast("long")
    span = lambda axis: F.sequence(cell(F.col(f"{axis}_low") - buffer), cell(F.col(f"{axis}_high") + buffer))
    banded = drawn.withColumn("wide", wide).select("area_id", "edges", "level", "wide", span("x").alias("columns"), F.explode(span("y")).alias("cy"))
    own = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("cy") * F.col("wide") - buffer) & (F.least(e["y1"], e["y2"]) <= (F.col("cy") + 1) * F.col("wide") + buffer))
    listed = banded.select("area_id", own.alias("edges"), "level", "wide", "cy", F.explode("columns").alias("cx"))
    listed = listed.select("area_id", "level", "cx", "cy", F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("cx") * F.col("wide") - buffer).alias("edges"))
    placed = points.select("point_id", "lon", "lat", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level")).withColumn("wide", wide)
    placed = placed.select("point_id", "lon", "lat", "level", cell(F.col("lon")).alias("cx"), cell(F.col("lat")).alias("cy"))
    held = G.inside_edges(F.col("lon"), F.col("lat"), edges) | G.near_edges(F.col("lon"), F.col("lat"), edges, buffer)
    return placed.join(listed.filter(F.size("edges") > 0), ["level", "cx", "cy"]).filter(held).select("point_id", "area_id")


def _in_pieces(points: DataFrame, areas: DataFrame, spread: bool = True) -> DataFrame:
    cut = save(pieces(areas) if spread else pieces(areas, spread=False))
    held = {r.level: r["count"] for r in cut.groupBy("level").count().collect()}
    # Where many points stand in few places, a place is decided once, and each of its points takes its areas.
    places = save(points.select("lon", "lat").distinct())
    if COPIES * places.count() > points.count():
        discard(places)
        return _decided(points.select("point_id", "lon", "lat"), cut, held).select("point_id", "area_id")
    found = save(_decided(places, cut, held))
    discard(places, cut)
    return points.select("point_id", "lon", "lat").join(found.hint("merge"), ["lon", "lat"]).select("point_id", "area_id")


def _decided(points: DataFrame, cut: DataFrame, held: dict[int, int]) -> DataFrame:
    """``points`` (lon, lat, ...) once for each area they are in, by the pieces ``cut``, so many at each level."""
    levels = sorted(held)
    placed = points.select("*", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    wide = F.pow(F.lit(2.0), F.col("level"))
    placed = placed.select("*", F.floor(F.col("lon") / wide).cast("long").alias("cx"), F.floor(F.col("lat") / wide).cast("long").alias("cy"))
    inside = G.inside_piece(F.col("lon"), F.col("lat"), F.col("edges"), F.col("crossings"), F.col("odd"), (F.col("cx") + 1) * wide)
    # Files of points and of pieces are packed so well that their sizes say little: a few pieces are broadcast by their
    # count, and many points never are.
    cut = F.broadcast(cut) if sum(held.values()) <= FEW_PIECES else cut.hint("merge")
    return placed.join(cut, ["level", "cx", "cy"]).filter(inside).select(*points.columns, "area_id")


def clip(points: DataFrame, inside: DataFrame, outside: DataFrame, exempt: Column, size: float | None = None, buffer: float = REGION_BUFFER) -> DataFrame:
    """Points inside one of ``inside``, or at most ``buffer`` degrees from it, and in none of ``outside`` (both areas, the
    latter without a buffer), and all that are ``exempt``."""
    kept = containing(points, inside, size, buffer).select("point_id").distinct().withColumn("_in", F.lit(True))
    lost = containing(points, outside, size).select("point_id").distinct().withColumn("_out", F.lit(True))
    joined = points.join(kept, "point_id", "left").join(lost, "point_id", "left")
    return joined.filter(exempt | (F.col("_in").isNotNull() & F.col("_out").isNull())).drop("_in", "_out")


def clusters(points: DataFrame, key: str, eps: float, id_col: str = "id", x: str = "lon", y: str = "lat") -> DataFrame:
    """(id, cluster): connected components, inside each key, of points at most ``eps`` apart in the plane; a cluster
    is named by its smallest id.

    Points of one grid cell of diagonal eps are linked to the cell's first point; points of neighbouring
    cells are compared only through distinct places, so many copies of one place cost one comparison.
    """
    side = eps / math.sqrt(2)
    cells = points.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(x) / side).cast("long").alias("i"), F.floor(F.col(y) / side).cast("long").alias("j"))
    places = cells.groupBy("k", "i", "j", "x", "y").agg(F.min("id").alias("id"))
    heads = places.groupBy("k", "i", "j").agg(F.min("id").alias("head"))
    own = cells.join(heads, ["k", "i", "j"]).select(F.col("head").alias("a"), F.col("id").alias("b"))
    shifts = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)))
    moved = places.select("k", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("id").alias("b"), "i", "j", F.explode(shifts).alias("s"))
    moved = moved.select("k", "x2", "y2", "b", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    near = places.join(moved, ["k", "i", "j"]).filter(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= eps * eps)
    labels = connected_components(own.unionByName(near.select(F.col("id").alias("a"), "b")))
    return points.select(F.col(id_col).alias("node")).join(labels, "node", "left").select(F.col("node").alias("id"), F.coalesce("component", "node").alias("cluster"))


def _segments(lines: DataFrame, key: str) -> DataFrame:
    """id, key, x1, y1, x2, y2 of every segment of ``lines`` (id, key, line)."""
    made = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(F.get("line", i - 1).alias("a"), F.get("line", i).alias("b")))
    return lines.select("id", key, F.explode(made).alias("s")).select("id", key, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def line_clusters(lines: DataFrame, key: str, eps: float) -> DataFrame:
    """(id, cluster): connected components, inside each key, of ``lines`` (id, key, line: array of struct(x, y)) at most
    ``eps`` apart; a cluster is named by its smallest id.

    Lines that share a segment are linked by it, and each distinct segment is compared once, in the name of its smallest
    id: segments are cut into pieces no longer than a cell, and pieces of one key and cell are compared.
    """
    place = [key, "x1", "y1", "x2", "y2"]
    drawn = _segments(lines, key)
    own = save(drawn.groupBy(*place).agg(F.min("id").alias("head")))
    held = drawn.join(own, place).select("id", "head").distinct()
    # A line stands for itself through the least head of its segments, to which its other heads are linked.
    held = save(held.groupBy("id").agg(F.collect_set("head").alias("heads")).select("id", F.array_min("heads").alias("head"), "heads"))
    shared = held.select("head", F.explode("heads").alias("b")).filter("head <> b").select(F.col("head").alias("a"), "b").distinct()
    own = own.withColumnRenamed("head", "id")
    size = 4 * eps
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    count = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) / size)).cast("int")
    cut = own.withColumn("n", count).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    along = lambda a, b, k: a + (b - a) * k / F.col("n")
    k = F.col("k")
    pieces = cut.select("id", key, along(x1, x2, k - 1).alias("x1"), along(y1, y2, k - 1).alias("y1"), along(x1, x2, k).alias("x2"), along(y1, y2, k).alias("y2"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - eps / 2) / size).cast("long"), F.floor((F.greatest(a, b) + eps / 2) / size).cast("long"))
    placed = pieces.withColumn("cx", F.explode(span(x1, x2))).withColumn("cy", F.explode(span(y1, y2)))
    one = placed.withColumnRenamed("id", "a")
    two = placed.select(F.col("id").alias("b"), key, "cx", "cy", *(F.col(c).alias(c.replace("x", "u").replace("y", "v")) for c in ("x1", "y1", "x2", "y2")))
    u1, v1, u2, v2 = (F.col(c) for c in ("u1", "v1", "u2", "v2"))
    side = lambda ax, ay, bx, by, px, py: F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    cross = (side(x1, y1, x2, y2, u1, v1) * side(x1, y1, x2, y2, u2, v2) < 0) & (side(u1, v1, u2, v2, x1, y1) * side(u1, v1, u2, v2, x2, y2) < 0)
    gap = F.least(G.segment_gap2(x1, y1, u1, v1, u2, v2), G.segment_gap2(x2, y2, u1, v1, u2, v2), G.segment_gap2(u1, v1, x1, y1, x2, y2), G.segment_gap2(u2, v2, x1, y1, x2, y2))
    near = one.join(two, [key, "cx", "cy"]).filter((F.col("a") < F.col("b")) & (cross | (gap <= eps * eps))).select("a", "b").distinct()
    labels = connected_components(near.unionByName(shared)).withColumnRenamed("node", "head")
    named = lines.select("id").distinct().join(held.drop("heads"), "id", "left").join(labels, "head", "left")
    return named.select("id", F.coalesce("component", "head", "id").alias("cluster"))


def merged_lines(lines: DataFrame, key: str, eps: float) -> DataFrame:
    """One row for each cluster of :func:`line_clusters`: its smallest id, key, and lon and lat of the point on its lines
    nearest to their centroid. A segment that several lines share counts once."""
    labels = line_clusters(lines, key, eps)
    swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    parts = _segments(lines, key).join(labels, "id").select(F.col("cluster").alias("id"), key, *ends).distinct()
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    length = F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
    mean = lambda a, b: F.coalesce(F.try_divide(F.sum(length * (a + b) / 2), F.sum(length)), F.avg((a + b) / 2))
    centre = parts.groupBy("id", key).agg(mean(x1, x2).alias("cx"), mean(y1, y2).alias("cy"))
    px, py = G.on_segment(F.col("cx"), F.col("cy"), x1, y1, x2, y2)
    near = parts.join(centre, ["id", key]).select("id", key, F.struct((F.pow(px - F.col("cx"), 2) + F.pow(py - F.col("cy"), 2)).alias("gap"), px.alias("lon"), py.alias("lat")).alias("p"))
    return near.groupBy("id", key).agg(F.min("p").alias("p")).select("id", key, "p.lon", "p.lat")
