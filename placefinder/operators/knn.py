"""k nearest places through a tree of cells that is as deep as places are dense.

The Earth is halved four times a level, into 4 by 4 cells of a cell, down to some centimetres. A cell of at most
``LEAF`` places is a leaf. Points descend level by level with a frontier of cells each: the k-th place can't be
farther than the cells that surely hold k places reach, so every cell that begins beyond that is dropped. What is
left at the leaves is measured. A point thus meets a number of places that depends on k and ``LEAF``, whether it
lies in a city or in a desert; a radius only ends the search earlier.

Edge cases: rows without a coordinate or an id are left out; longitudes are taken round the Earth; of places at one
coordinate the first k by id alone can be among the k nearest, so no more are indexed; fewer than k places in
reach give fewer rows; no points or no places give no row; repeated point_ids count as one point (any of its places).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .fuzzy import top
from .tables import discard, save

#: Most places of a leaf, but for places that share a cell of the last level.
LEAF = 32
#: Levels, and the one whose cells are counted first: only the places of full ones are counted deeper.
LEVELS, FIRST = 16, 8
#: Levels whose cells are broadcast, as there are at most 16^3 of them.
SMALL = 3
#: Levels between saved frontiers.
STEP = 4

CELL = ["level", "cx", "cy"]


@dataclass
class Index:
    """``nodes``: level, cx, cy, n, leaf; ``places``: id, flon, flat by leaf; ``most``: the greatest k it answers."""

    nodes: DataFrame
    places: DataFrame
    depth: int
    most: int

    def free(self) -> None:
        discard(self.nodes, self.places)


def _fine(lon: Column, lat: Column) -> list[Column]:
    """The cell of the last level."""
    side = float(4**LEVELS)
    axis = lambda share: F.least(F.floor(share * side), F.lit(4**LEVELS - 1)).cast("long")
    return [axis(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0).alias("x"), axis((lat + 90.0) / 180.0).alias("y")]


def _up(value: str, levels: Column | int) -> Column:
    """A cell's column or row, ``levels`` levels up."""
    return F.call_function("shiftright", F.col(value), 2 * (levels if isinstance(levels, Column) else F.lit(levels)))


def _counted(cells: DataFrame, held: int, levels: range, leaf: int) -> DataFrame:
    """level, cx, cy, n, leaf of the cells above ``cells`` (x, y of level ``held``, n), those of open parents alone."""
    listed = cells.select("x", "y", "n", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    above = F.lit(held) - F.col("level")
    # Sums of a level are made before the shuffle, so the upper ones send a few rows a task.
    counts = listed.groupBy("level", _up("x", above).alias("cx"), _up("y", above).alias("cy")).agg(F.sum("n").alias("n"))
    counts = save(counts)
    full = counts.filter(F.col("n") > leaf).select((F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    parent = counts.withColumn("px", _up("cx", 1)).withColumn("py", _up("cy", 1)).join(full, ["level", "px", "py"], "left_semi")
    kept = parent.unionByName(counts.filter(F.col("level") == levels[0]).withColumn("px", F.lit(0).cast("long")).withColumn("py", F.lit(0).cast("long")))
    return kept.select(*CELL, "n", ((F.col("n") <= leaf) | (F.col("level") == LEVELS)).alias("leaf"))


def index(features: DataFrame, most: int, leaf: int = LEAF) -> Index:
    """The tree over ``features`` (id, lon, lat) for searches of up to ``most`` places."""
    rows = features.select("id", F.col("lon").cast("double").alias("flon"), F.col("lat").cast("double").alias("flat"))
    rows = rows.filter("id IS NOT NULL AND flon IS NOT NULL AND flat IS NOT NULL AND flat BETWEEN -90 AND 90")
    rows = top(rows, ["flon", "flat"], [F.col("id")], most).drop("rank")
    rows = save(rows.select("*", *_fine(F.col("flon"), F.col("flat"))))
    first = rows.withColumn("fx", _up("x", LEVELS - FIRST)).withColumn("fy", _up("y", LEVELS - FIRST))
    cells = save(first.groupBy(F.col("fx").alias("x"), F.col("fy").alias("y")).agg(F.count(F.lit(1)).alias("n")))
    upper = _counted(cells, FIRST, range(1, FIRST + 1), leaf)
    full = cells.filter(F.col("n") > leaf).select(F.col("x").alias("fx"), F.col("y").alias("fy"))
    dense = save(first.join(full, ["fx", "fy"], "left_semi"))
    lower = _counted(dense.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), LEVELS, range(FIRST + 1, LEVELS + 1), leaf)
    nodes = save(upper.unionByName(lower))
    leaves = nodes.filter("leaf").select(*CELL)

    def under(df: DataFrame, x: str, y: str, held: int, levels: range) -> DataFrame:
        """``df`` with the leaf above each row; every row has one at most."""
        listed = df.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        return listed.withColumn("cx", _up(x, F.lit(held) - F.col("level"))).withColumn("cy", _up(y, F.lit(held) - F.col("level"))).join(leaves, CELL, "left_semi")

    shallow = under(cells.select(F.col("x").alias("fx"), F.col("y").alias("fy")), "fx", "fy", FIRST, range(1, FIRST + 1))
    placed = first.join(shallow, ["fx", "fy"]).select(*CELL, "id", "flon", "flat")
    deep = under(dense, "x", "y", LEVELS, range(FIRST + 1, LEVELS + 1)).select(*CELL, "id", "flon", "flat")
    places = save(placed.unionByName(deep))
    depth = nodes.agg(F.max("level")).first()[0] or 0
    discard(rows, cells, dense)
    return Index(nodes, places, depth, most)


def _between() -> tuple[Column, Column]:
    """Least and greatest haversine (of the half angle, squared) from the point to anything in the cell."""
    wide, high = F.lit(360.0) / F.pow(F.lit(4.0), F.col("level")), F.lit(180.0) / F.pow(F.lit(4.0), F.col("level"))
    west, south = F.col("cx") * wide - 180.0, F.col("cy") * high - 90.0
    north = south + high
    lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    apart = lambda x: F.greatest(west - x, x - (west + wide), F.lit(0.0))
    dlon = F.least(apart(lon), apart(lon - 360.0), apart(lon + 360.0))
    lat = F.col("lat")
    dlat = F.greatest(south - lat, lat - north, F.lit(0.0))
    half = lambda degrees: F.pow(F.sin(F.radians(degrees) / 2), 2)
    own = F.cos(F.radians(lat))
    edges = F.cos(F.radians(south)), F.cos(F.radians(north))
    widest = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(*edges))
    low = half(dlat) + own * F.greatest(F.least(*edges), F.lit(0.0)) * half(dlon)
    far = half(F.greatest(F.abs(lat - south), F.abs(lat - north))) + own * widest * half(F.least(dlon + wide, F.lit(180.0)))
    return low, far


def candidates(points: DataFrame, tree: Index, k: int, radius_m: float | None = None) -> DataFrame:
    """point_id, lon, lat and the leaves (level, cx, cy, n) that may hold one of its k nearest places."""
    if k > tree.most:
        raise ValueError(f"the index holds the first {tree.most} places of a coordinate, {k} are asked")
    asked = points.select("point_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    # A small table of points makes many cells, so it is spread first; windows by point then need no other shuffle.
    spread = lambda df: df.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "point_id")
    asked = spread(asked.filter("point_id IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90 AND 90")).dropDuplicates(["point_id"])
    # The square of the half chord, as haversines are; 1 is the other side of the Earth.
    limit = F.lit(1.0 if radius_m is None else math.sin(min(radius_m / (2 * G.EARTH_M), math.pi / 2)) ** 2)
    whole = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("cx"), F.lit(y).cast("long").alias("cy")) for x in range(4) for y in range(4))))
    first = F.broadcast(tree.nodes.filter("level = 1").select(*CELL, "n", "leaf"))
    front = asked.select("*", whole.alias("cell")).select("point_id", "lon", "lat", "cell.*").join(first, ["cx", "cy"]).select("point_id", "lon", "lat", *CELL, "n", "leaf")
    saved = None
    order = Window.partitionBy("point_id")
    for level in range(1, tree.depth + 1):
        if level > 1:
            below = tree.nodes.filter(F.col("level") == level).select(F.lit(level - 1).alias("level"), _up("cx", 1).alias("cx"), _up("cy", 1).alias("cy"), F.struct(*CELL, "n", "leaf").alias("child"))
            # A leaf has no cells below it and stays itself; the frontier is read once, so plans don't double with each level.
            front = front.join(F.broadcast(below) if level <= SMALL else below, CELL, "left").withColumn("child", F.coalesce("child", F.struct(*CELL, "n", "leaf")))
            front = (front if level <= SMALL else spread(front)).select("point_id", "lon", "lat", "child.*")
        low, far = _between()
        both = front.select("*", low.alias("low"), far.alias("far"))
        # The first cells, by how far they reach, that hold k places together: none of the k is farther than the last of them.
        sums = both.withColumn("held", F.sum("n").over(order.orderBy("far", *CELL).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        bound = F.least(F.coalesce(F.min(F.when(F.col("held") >= k, F.col("far"))).over(order), F.lit(4.0)), limit)
        front = sums.withColumn("bound", bound).filter(F.col("low") <= F.col("bound") * (1 + 1e-9) + 1e-17).drop("held", "bound", "low", "far")
        if level % STEP == 0 and level < tree.depth:
            front, before = save(front), saved
            discard(before)
            saved = front
    return front.filter("leaf").select("point_id", "lon", "lat", *CELL, "n")


def nearest(points: DataFrame, features: DataFrame | Index, k: int, radius_m: float | None = None) -> DataFrame:
    """The k nearest features (id, lon, lat, or their :func:`index`) of each point (point_id, lon, lat), ties by id:
    point_id, id, distance_m, rank."""
    tree = features if isinstance(features, Index) else index(features, k)
    found = candidates(points, tree, k, radius_m).drop("n").join(tree.places, CELL)
    found = found.select("point_id", "id", G.haversine_m(F.col("lon"), F.col("lat"), F.col("flon"), F.col("flat")).alias("distance_m"))
    if radius_m is not None:
        found = found.filter(F.col("distance_m") <= float(radius_m))
    return top(found, ["point_id"], [F.col("distance_m"), F.col("id")], k)
