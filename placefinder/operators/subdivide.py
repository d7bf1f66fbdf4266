"""Areas cut into pieces of few edges, so that a point is tested against a handful of them however long an outline is.

The cells of an area begin as wide as the area and are cut in four until none holds more than ``MOST_EDGES`` of its
edges. Edges are not cut: a piece keeps every edge that meets its cell, and whether the cell's north-eastern corner is
inside the area. A point of the cell is inside as the corner is, or not as it is, by the number of edges on the way
from the point east to the cell's border and north to the corner; where edges cross that border is worked out here. A cell without edges is inside as a whole, or dropped.

Places count as lying beyond their own coordinates by less than any number, and by much less in latitude than in
longitude, so edges along a border, or through a corner, are met once. A child's corner is known from its parent's by the parent's edges alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

MOST_EDGES = 32
#: Cells are 2^level degrees wide; edges that meet in one point can't be parted, so the smallest cells hold any number.
LOWEST, HIGHEST = -24, 9
#: Points of outlines that are worked on at once, unless one area has more.
POINTS_AT_ONCE = 50_000


def _outlines(column) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x1, y1, x2, y2) of the areas' rings, and the area of each; what lacks a coordinate is left out."""
    import pyarrow.compute as pc

    count = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rings = column.flatten()
    points = rings.flatten()
    ring = np.repeat(np.arange(len(rings)), count(rings))
    area = np.repeat(np.arange(len(column)), count(column))[ring]
    x, y = (pc.struct_field(points, name).cast("double").to_numpy(zero_copy_only=False) for name in "xy")
    first = np.flatnonzero(ring[:-1] == ring[1:])
    down = y[first] > y[first + 1]
    one, two = first + down, first + ~down  # the lower end comes first
    edges = np.stack([x[one], y[one], x[two], y[two]])  # kept by columns, as all later work is on columns
    sound = np.logical_and.reduce(np.isfinite(edges))
    return edges[:, sound].T, area[first][sound]


def _meets(e: np.ndarray, x: np.ndarray, y: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Whether edges meet the closed cells from (x, y) to (x + wide, y + wide); rounding counts as meeting."""
    x1, y1, x2, y2 = e.T
    near = (np.minimum(x1, x2) <= x + wide) & (np.maximum(x1, x2) >= x) & (np.minimum(y1, y2) <= y + wide) & (np.maximum(y1, y2) >= y)
    some = np.flatnonzero(near)  # most edges are ruled out by their boxes
    x1, y1, x2, y2, x, y, wide = (c[some] for c in (x1, y1, x2, y2, x, y, wide))
    up1, up2 = (x2 - x1) * (y - y1), (x2 - x1) * (y + wide - y1)
    along1, along2 = (y2 - y1) * (x - x1), (y2 - y1) * (x + wide - x1)
    slack = 1e-14 * (np.maximum(np.abs(up1), np.abs(up2)) + np.maximum(np.abs(along1), np.abs(along2)))
    # the least and the greatest of up - along over the four corners
    near[some] = (np.minimum(up1, up2) - np.maximum(along1, along2) <= slack) & (np.maximum(up1, up2) - np.minimum(along1, along2) >= -slack)
    return near


def _upward(e: np.ndarray, east: np.ndarray, north: np.ndarray) -> np.ndarray:
    """The latitude where each edge crosses the border ``east`` below ``north``, or NaN. One that rises from the very
    latitude crosses above it, which is the next number."""
    x1, _, x2, _ = e.T
    found = np.full(len(e), np.nan)
    some = np.flatnonzero((x1 > east) != (x2 > east))
    (x1, y1, x2, y2), east, north = e[some].T, east[some], north[some]
    at = (y2 - y1) * (east - x1) / (x2 - x1) + y1
    at = np.where((y2 - y1) * (x2 - x1) > 0, np.nextafter(at, np.inf), at)
    found[some] = np.where(at <= north, at, np.nan)
    return found


def _eastward(e: np.ndarray, x: np.ndarray, y: np.ndarray, east: np.ndarray) -> np.ndarray:
    """The edges that are met on the way from (x, y) east to ``east``."""
    _, y1, _, y2 = e.T
    some = np.flatnonzero((y1 > y) != (y2 > y))
    x1, y1, x2, y2 = (c[some] for c in e.T)
    at = (x2 - x1) * (y[some] - y1) / (y2 - y1) + x1
    return some[(at > x[some]) & (at <= east[some])]


def _children(e: np.ndarray, parent: np.ndarray, cx: np.ndarray, cy: np.ndarray, w: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y, odd and the edges (by index) of the four cells, ``w`` wide, that each of the cells (cx, cy) is cut in; all
    edges meet their parent."""
    west, mid, east = ((2 * cx + i) * w for i in range(3))
    south, half, north = ((2 * cy + i) * w for i in range(3))
    x_mid, x_east, y_half, y_north = mid[parent], east[parent], half[parent], north[parent]
    x1, y1, x2, y2 = e.T
    count = lambda met: np.bincount(parent[met], minlength=len(cx)) % 2 == 1
    # From each child's corner to the parent's: east along a border, then north along the parent's eastern one.
    upper = np.flatnonzero(_upward(e, x_east, y_north) > y_half)
    rise, low, high = count(upper), count(_eastward(e, x_mid, y_half, x_east)), count(_eastward(e, x_mid, y_north, x_east))
    corner = {(0, 0): low ^ rise, (0, 1): high, (1, 0): rise, (1, 1): np.zeros(len(cx), dtype=bool)}
    wests, easts = np.minimum(x1, x2) <= x_mid, np.maximum(x1, x2) >= x_mid
    souths, norths = np.minimum(y1, y2) <= y_half, np.maximum(y1, y2) >= y_half
    # An edge whose box touches one child alone meets that one, as it meets the parent.
    alone = (wests ^ easts) & (souths ^ norths)
    for dx in (0, 1):
        for dy in (0, 1):
            near = (easts if dx else wests) & (norths if dy else souths)
            some = np.flatnonzero(near & ~alone)
            of = parent[some]
            near[some] = _meets(e[some], (mid if dx else west)[of], (half if dy else south)[of], w[of])
            yield 2 * cx + dx, 2 * cy + dy, corner[dx, dy] ^ odd, np.flatnonzero(near)


def cut(edges: np.ndarray, area: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces of areas by their edges, some at a time: area, level, cx, cy, odd (whether the corner is inside), the
    number of edges, and the edges of all pieces one after the other."""
    if not len(area):
        return
    columns = np.ascontiguousarray(edges.T)
    edges = columns.T
    ids, begin = np.unique(area, return_index=True)
    size = np.diff(np.append(begin, len(area)))
    low = np.minimum.reduceat(np.minimum(edges[:, :2], edges[:, 2:]), begin)
    high = np.maximum.reduceat(np.maximum(edges[:, :2], edges[:, 2:]), begin)
    level = np.clip(np.ceil(np.log2(np.maximum((high - low).max(axis=1), 1e-9))), LOWEST, HIGHEST).astype(np.int64)
    wide = np.exp2(level)
    first, last = np.floor(low / wide[:, None]).astype(np.int64), np.floor(high / wide[:, None]).astype(np.int64)
    node: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for dx in range(int((last - first)[:, 0].max()) + 1):
        for dy in range(int((last - first)[:, 1].max()) + 1):
            here = np.flatnonzero((first[:, 0] + dx <= last[:, 0]) & (first[:, 1] + dy <= last[:, 1]))
            cx, cy, w = first[here, 0] + dx, first[here, 1] + dy, wide[here]
            which = np.repeat(np.arange(len(here)), size[here])
            some = np.repeat(begin[here] - np.cumsum(size[here]) + size[here], size[here]) + np.arange(len(which))
            east, north = ((cx + 1) * w)[which], ((cy + 1) * w)[which]
            odd = np.bincount(which[_eastward(edges[some], east, north, np.full(len(which), np.inf))], minlength=len(here)) % 2 == 1
            keep = _meets(edges[some], (cx * w)[which], (cy * w)[which], w[which])
            node.append((ids[here], level[here], cx, cy, odd))
            held.append((which[keep] + total, some[keep]))
            total += len(here)
    owner, lev, cx, cy, odd = (np.concatenate(c) for c in zip(*node))
    which, some = (np.concatenate(c) for c in zip(*held))
    while len(owner):
        count = np.bincount(which, minlength=len(owner))
        split = (count > most) & (lev > LOWEST)
        out = np.flatnonzero(~split & ((count > 0) | odd))
        # The edges are in the order of their pieces, as those of children are in the order of their parents.
        yield owner[out], lev[out], cx[out], cy[out], odd[out], count[out], columns[:, some[~split[which]]].T
        # Four children of each piece that has too many, from the piece's own edges.
        rows = np.flatnonzero(split)
        place = np.cumsum(split) - 1
        inner = split[which]
        parent, some = place[which[inner]], some[inner]
        w = np.exp2(lev[rows] - 1)
        node, held, total = [], [], 0
        for x, y, corner, met in _children(columns[:, some].T, parent, cx[rows], cy[rows], w, odd[rows]):
            node.append((owner[rows], lev[rows] - 1, x, y, corner))
            held.append((parent[met] + total, some[met]))
            total += len(rows)
        owner, lev, cx, cy, odd = (np.concatenate(c) for c in zip(*node))
        which, some = (np.concatenate(c) for c in zip(*held))


def pieces(areas: DataFrame, most: int = MOST_EDGES, spread: bool = True) -> DataFrame:
    """area_id, level, cx, cy, odd, edges (array of struct(x1, y1, x2, y2), y1 <= y2) and crossings (latitudes where
    edges cross the cell's eastern border) of the pieces of ``areas`` (area_id, rings:
    arrays of closed rings of struct(x, y)). Areas without an edge have none. Areas are spread over the tasks of a
    shuffle first, as an outline costs some milliseconds and a file of areas may be small; not so where the caller has
    spread them already, before their outlines were made."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        for batch in batches:
            ids, rings = batch.column(0), batch.column(1)
            rows = np.repeat(np.arange(len(rings)), pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False))
            sizes = np.bincount(rows, pc.fill_null(pc.list_value_length(rings.flatten()), 0).to_numpy(zero_copy_only=False), len(rings)).tolist()
            start = held = 0
            for i, size in enumerate([*sizes, POINTS_AT_ONCE + 1]):
                if i == len(sizes) or (i > start and held + size > POINTS_AT_ONCE):
                    if i > start:
                        yield from made(ids.slice(start, i - start), rings.slice(start, i - start))
                    start, held = i, 0
                held += size

    def made(ids, rings) -> Iterator:
        import pyarrow as pa

        for owner, level, cx, cy, odd, count, edges in cut(*_outlines(rings), most):
            if len(owner):
                piece = np.repeat(np.arange(len(owner)), count)
                wide = np.exp2(level)
                crossed = _upward(edges, ((cx + 1) * wide)[piece], ((cy + 1) * wide)[piece])
                some = np.flatnonzero(~np.isnan(crossed))
                ends = np.concatenate(([0], np.cumsum(np.bincount(piece[some], minlength=len(owner)))))
                crossings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(crossed[some]))
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in range(4)], ["x1", "y1", "x2", "y2"])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(level.astype(np.int32)), pa.array(cx), pa.array(cy), pa.array(odd), listed, crossings], ["area_id", "level", "cx", "cy", "odd", "edges", "crossings"])

    dealt = areas.select("area_id", "rings")
    if spread:
        dealt = dealt.repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")), "area_id")
    kind = areas.schema["area_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"area_id {kind}, level int, cx long, cy long, odd boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>, crossings array<double>")
