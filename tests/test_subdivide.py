"""Areas cut into pieces against even-odd tests of whole outlines."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placefinder.operators import spatial, subdivide

RINGS = "area_id long, rings array<array<struct<x:double,y:double>>>"


def whole(lon, lat, rings):
    """Even-odd over every edge, boundaries included, in exact fractions of the given doubles."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            cross = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)
            if cross == 0 and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
                return True
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, x, y, n, low, high, snap=None):
    points = []
    for i in range(n):
        r, turn = rng.uniform(low, high), 2 * math.pi * i / n
        p = (x + r * math.cos(turn), y + r * math.sin(turn))
        points.append(tuple(round(c * snap) / snap for c in p) if snap else p)
    return [*points, points[0]]


def shapes():
    rng = random.Random(4)
    out = []
    for k in range(12):
        x, y = rng.uniform(-170, 170), rng.uniform(-80, 80)
        snap = (None, 4, 1)[k % 3]
        rings = [star(rng, x, y, rng.choice([5, 40, 300]), 3, 9, snap)]
        if k % 2:
            rings.append(star(rng, x, y, 60, 1, 2.5, snap))
        if k % 4 == 3:
            rings.append(star(rng, x + 30, y / 2, 25, 1, 5, snap))
        out.append((k, rings))
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    teeth = [(float(i), 8.0 * (i % 2)) for i in range(65)]
    out += [(20, [box(0, 0, 64, 32)]), (21, [box(-8, -8, 8, 8), box(-4, -4, 4, 4)]), (22, [[*teeth, (64.0, -1.0), (0.0, -1.0), (0.0, 0.0)]]), (23, [[(1.0, 1.0)]]), (24, []), (25, None)]
    return out


def test_points_of_pieces_equal_points_of_outlines(spark, monkeypatch):
    areas, rng = shapes(), random.Random(6)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(400)]
    for _, rings in areas:
        for ring in rings or []:
            xs, ys = [p[0] for p in ring], [p[1] for p in ring]
            points += [(rng.uniform(min(xs) - 1, max(xs) + 1), rng.uniform(min(ys) - 1, max(ys) + 1)) for _ in range(40)]
            points += rng.sample(ring, min(6, len(ring))) + [(float(round(rng.uniform(min(xs), max(xs)))), float(round(rng.uniform(min(ys), max(ys))))) for _ in range(40)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "point_id long, lon double, lat double")
    a = spark.createDataFrame([(k, rings and [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in areas], RINGS)
    want = {(i, k) for i, p in enumerate(points) for k, rings in areas if whole(*p, rings or [])}
    for most, at_once in ((4, 100), (32, 50_000)):
        monkeypatch.setattr(subdivide, "POINTS_AT_ONCE", at_once)
        monkeypatch.setattr(spatial, "pieces", lambda areas, most=most: subdivide.pieces(areas, most))
        got = [(r.point_id, r.area_id) for r in spatial.containing(df, a).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


@pytest.mark.parametrize("vertices", [1_000, 10_000, 100_000])
def test_edges_tested_for_a_point_stay_flat(vertices):
    rng = random.Random(1)
    ring = np.array(star(rng, 10, 10, vertices, 7, 7.02))
    edges = np.hstack([ring[:-1], ring[1:]])
    kept, size, odd = set(), 0, 0.0
    weight = 0.0
    for _, level, cx, cy, corner, count, some in subdivide.cut(edges, np.zeros(vertices, np.int64), 32):
        assert count.max(initial=0) <= 32
        kept |= set(map(tuple, some.tolist()))
        size += len(some)
        cover = np.exp2(2.0 * level)
        weight += float((cover * count).sum())
        odd += float((cover * ((count == 0) & corner)).sum())
    assert len(kept) == vertices and size < 3 * vertices
    assert weight / (14 * 14) < 20  # edges met by a point of the bounding box, on average
    assert odd > 0.5 * math.pi * 7 * 7 * 0.9  # most of the inside needs no edge at all


def test_edges_that_meet_in_one_point_end_the_cutting():
    spokes = np.array([[0.1, 0.1, 0.1 + math.cos(i), 0.1 + math.sin(i)] for i in range(100)])
    found = list(subdivide.cut(spokes, np.zeros(100, np.int64), 8))
    assert max(int(c.max(initial=0)) for *_, c, _ in found) == 100 and len(found) <= subdivide.HIGHEST - subdivide.LOWEST + 1


def test_ids_of_texts_and_extra_columns(spark):
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))]
    areas = spark.createDataFrame([("a", [ring])], "area_id string, rings array<array<struct<x:double,y:double>>>").withColumn("level", F.lit(7))
    points = spark.createDataFrame([("p", 0.6, 0.2), ("q", 0.2, 0.6), ("r", None, 0.5)], "point_id string, lon double, lat double").withColumn("cx", F.lit(1))
    assert [tuple(r) for r in spatial.containing(points, areas).collect()] == [("p", "a")]
    assert spatial.containing(points, areas.limit(0)).collect() == []


def test_copies_of_a_place_are_decided_once(spark, monkeypatch):
    decided = []
    whole_join = spatial._decided
    monkeypatch.setattr(spatial, "_decided", lambda points, *rest: (decided.append(points.count()), whole_join(points, *rest))[1])
    box = [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]]
    areas = spark.createDataFrame([(1, box), (2, box)], RINGS)
    places = [(1.0, 1.0), (4.0, 2.0), (9.0, 9.0), (-0.0, 0.0), (0.0, 0.0), (None, 1.0)]
    points = spark.createDataFrame([(i, *places[i % 6]) for i in range(120)], "point_id long, lon double, lat double")
    got = sorted(tuple(r) for r in spatial.containing(points, areas).select("point_id", "area_id").collect())
    assert got == sorted((i, a) for i in range(120) for a in (1, 2) if i % 6 in (0, 1, 3, 4))
    assert decided and decided[0] <= 6
