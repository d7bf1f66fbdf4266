"""Geographic functions on plain columns (degrees, metres)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
DEGREE_M = 111320.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def focus_boost(distance_m: Column) -> Column:
    """1 at the focus, fading with distance; 0 without one."""
    return F.coalesce(F.exp(-distance_m / 50000.0), F.lit(0.0))


def distance_confidence(distance_m: Column) -> Column:
    out = F.when(distance_m < 1, 1.0)
    for most, value in ((10, 0.9), (100, 0.8), (250, 0.7), (1000, 0.6)):
        out = out.when(distance_m < most, value)
    return out.otherwise(0.5)


def ring_edges(rings: Column) -> Column:
    """The edges (array of struct(x1, y1, x2, y2)) of closed rings (arrays of struct(x, y), first = last)."""

    def edges(ring: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.struct(F.get(ring, i - 1)["x"].alias("x1"), F.get(ring, i - 1)["y"].alias("y1"), F.get(ring, i)["x"].alias("x2"), F.get(ring, i)["y"].alias("y2")))

    return F.filter(F.flatten(F.transform(rings, edges)), lambda e: e["x2"].isNotNull())


def _touches(lon: Column, lat: Column, e: Column) -> Column:
    """Whether a point lies on an edge."""
    cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    return lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & (cross == 0) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def inside_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd over a polygon's edges (holes and parts alike); boundaries count as inside. Edges that reach neither the
    point's latitude nor east of it may be missing."""

    def crosses(e: Column) -> Column:
        rises = e["y2"] - e["y1"]
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(rises != 0, rises).otherwise(1.0) + e["x1"])

    return F.exists(edges, lambda e: _touches(lon, lat, e)) | (F.size(F.filter(edges, crosses)) % 2 == 1)


#: More than any number of edges of a piece: what a point on an edge counts.
_ON_EDGE = 1 << 30


def inside_piece(lon: Column, lat: Column, edges: Column, crossings: Column, odd: Column, east: Column) -> Column:
    """Whether a point of a cell is inside the area whose edges in that cell are given (y1 <= y2), boundaries included.

    ``odd`` says whether the cell's north-eastern corner is inside; each edge on the way there, east to ``east``, then
    north past the latitudes ``crossings``, changes that. Most edges are ruled out by their latitudes.
    """

    def met(count: Column, e: Column) -> Column:
        run, rise = e["x2"] - e["x1"], e["y2"] - e["y1"]
        x = run * (lat - e["y1"]) / F.when(rise != 0, rise).otherwise(1.0) + e["x1"]
        across = (lat < e["y2"]) & (x > lon) & (x <= east)
        return F.when((lat < e["y1"]) | (lat > e["y2"]), count).when(_touches(lon, lat, e), count + _ON_EDGE).when(across, count + 1).otherwise(count)

    count = F.aggregate(edges, odd.cast("int").cast("long"), met)
    return (count >= _ON_EDGE) | (((count + F.size(F.filter(crossings, lambda y: y > lat))) % 2) == 1)


def near_edges(lon: Column, lat: Column, edges: Column, buffer: float) -> Column:
    """Whether a point is at most ``buffer`` degrees from an edge."""
    return F.exists(edges, lambda e: segment_gap2(lon, lat, e["x1"], e["y1"], e["x2"], e["y2"]) <= buffer * buffer)


def segment_gap2(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance, in the plane, of a point from a segment."""
    px, py = on_segment(x, y, x1, y1, x2, y2)
    return F.pow(x - px, 2) + F.pow(y - py, 2)


def on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The point of a segment that is nearest to a point."""
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.when(long2 > 0, long2)))).otherwise(0.0)
    return x1 + t * dx, y1 + t * dy


def ring_area(ring: Column) -> Column:
    """Planar area of a closed ring (shoelace)."""
    terms = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def band_of(lat: Column, size: float) -> Column:
    return F.floor(lat / size).cast("long")


def lon_width(band: Column, size: float) -> Column:
    """Degrees of longitude of the cells of a latitude band: as wide as ``size`` degrees of latitude at its pole side."""
    edge = F.greatest(F.abs(band * size), F.abs((band + 1) * size))
    return F.lit(size) / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.05))


def cell_of(lon: Column, lat: Column, size: float) -> Column:
    band = band_of(lat, size)
    return F.struct(band.alias("band"), F.floor(lon / lon_width(band, size)).cast("long").alias("col"))


def cells_near(lon: Column, lat: Column, radius_m: Column | float, size: float) -> Column:
    """Every cell a point within ``radius_m`` can lie in."""
    r = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    dlat = r / (math.pi * EARTH_M / 180)
    edge = F.abs(lat) + dlat
    # Beyond 87 degrees a circle may hold every longitude.
    dlon = F.when(edge >= 87, F.lit(180.0)).otherwise(dlat / F.cos(F.radians(F.least(edge, F.lit(87.0)))))

    def columns(band: Column) -> Column:
        width = lon_width(band, size)

        def span(shift: float) -> Column:
            low, high = F.greatest(lon - dlon + shift, F.lit(-180.0)), F.least(lon + dlon + shift, F.lit(180.0))
            return F.when(low <= high, F.sequence(F.floor(low / width).cast("long"), F.floor(F.greatest(low, high) / width).cast("long"))).otherwise(F.array().cast("array<long>"))

        # The circle may cross the date line.
        spans = F.array_distinct(F.concat(span(0.0), span(-360.0), span(360.0)))
        return F.transform(spans, lambda c: F.struct(band.alias("band"), c.alias("col")))

    return F.flatten(F.transform(F.sequence(band_of(lat - dlat, size), band_of(lat + dlat, size)), columns))
