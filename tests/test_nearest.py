"""Nearest places through the tree of cells, and distances on the spheroid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placefinder.functions.geodesic import spheroid_m
from placefinder.operators import knn, spatial
from placefinder.plans import address

PLACES, POINTS = "id long, lon double, lat double", "point_id long, lon double, lat double"


def far(a, b):
    x, y = math.radians(a[1]), math.radians(b[1])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture(scope="module")
def crowded(spark):
    """Places anywhere, a town of three thousand, five hundred copies of one place, and some at the date line and poles."""
    rng = random.Random(3)
    places = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(1000)]
    places += [(10_000 + i, rng.gauss(12, 0.001), rng.gauss(50, 0.001)) for i in range(3000)]
    places += [(20_000 + i, 5.0, 6.0) for i in range(500)] + [(30_000 + i, rng.choice([-180.0, 180.0, 179.99999]), rng.uniform(-90, 90)) for i in range(200)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(60)] + [(1000 + i, rng.gauss(12, 0.002), rng.gauss(50, 0.002)) for i in range(60)]
    points += [(2000, 5.0, 6.0), (2001, 180.0, 90.0), (2002, -180.0, -90.0), (2003, 179.9999, 10.0), (2004, 12.0, 50.0)]
    return places, points, knn.index(spark.createDataFrame(places, PLACES), 5)


def brute(places, points, k, most=math.inf):
    return {(p, r + 1, i) for p, *at in points for r, (m, i) in enumerate(sorted((far(at, x), i) for i, *x in places)[:k]) if m <= most}


@pytest.mark.parametrize("k, radius", [(5, None), (1, None), (3, 40_000.0)])
def test_nearest_equals_brute_force(spark, crowded, k, radius):
    places, points, tree = crowded
    found = knn.nearest(spark.createDataFrame(points, POINTS), tree, k, radius).collect()
    assert {(r.point_id, r["rank"], r.id) for r in found} == brute(places, points, k, radius or math.inf)


def test_pairs_do_not_grow_with_density(spark, crowded):
    _, points, tree = crowded
    made = knn.candidates(spark.createDataFrame(points, POINTS), tree, 5).groupBy("point_id").agg(F.sum("n").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert made[0] <= 16 * knn.LEAF and made[1] == len(points)


def test_index_holds_bounded_leaves_and_every_place_once(crowded):
    places, _, tree = crowded
    assert tree.nodes.filter("leaf").agg(F.max("n")).first()[0] <= knn.LEAF
    held = [r.id for r in tree.places.select("id").collect()]
    assert len(held) == len(set(held))
    assert set(held) == {i for i, *_ in places if not 20_005 <= i < 20_500}
    with pytest.raises(ValueError):
        knn.candidates(tree.places.select(F.col("id").alias("point_id"), F.col("flon").alias("lon"), F.col("flat").alias("lat")), tree, 6)


def test_missing_empty_and_repeated_rows(spark):
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (None, 1.0, 1.0), (3, 2.0, 95.0), (4, 541.0, 1.0)], PLACES)
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 0.0), (None, 0.0, 0.0), (3, -179.0, 1.0)], POINTS)
    got = {(r.point_id, r["rank"], r.id) for r in knn.nearest(points, places, 3).collect()}
    assert got == {(1, 1, 1), (1, 2, 4), (3, 1, 4), (3, 2, 1)}
    assert knn.nearest(points, places.limit(0), 3).count() == 0
    assert knn.nearest(points.limit(0), places, 3).count() == 0


def test_nearest_address(spark):
    rows = spark.createDataFrame([(1, "address", 1.0, 1.0), (2, "venue", 1.0, 1.00001), (3, "address", 1.0, 1.03)], "id long, layer string, lon double, lat double")
    points = spark.createDataFrame([(7, 1.0, 1.00001), (8, 1.0, 1.02), (9, 9.0, 9.0)], POINTS)
    assert {(r.point_id, r.id) for r in address.nearest_address(points, rows).collect()} == {(7, 1), (8, 3)}


#: Published test lines of geodesics on WGS 84 (lat1, lon1, lat2, lon2, metres).
LINES = [
    (-30.12345, 0.0, -30.12344, 0.00005, 4.944208), (-30.0, 0.0, 29.9, 179.8, 19989832.827610), (40.0, 0.0, 41.79331020506, 137.84490004377, 10000000.0),
    (-41.32, 174.81, 40.96, -5.50, 19959679.26735382), (90.0, 0.0, -90.0, 0.0, 20003931.458625), (0.0, 0.0, 0.0, 180.0, 20003931.458625),
    (0.0, 0.0, 0.5, 179.5, 19936288.579), (0.0, 0.0, 0.5, 179.7, 19944127.421), (0.0, 10.0, 0.0, 11.0, 111319.490793),
]


def test_published_geodesics_either_way(spark):
    df = spark.createDataFrame([(i, *line) for i, line in enumerate(LINES)], "i int, a double, b double, c double, d double, m double")
    a, b, c, d = (F.col(x) for x in "abcd")
    got = df.select("m", spheroid_m(b, a, d, c).alias("there"), spheroid_m(d, c, b, a).alias("back"), spheroid_m(b, -a, d, -c).alias("mirrored"))
    for r in got.collect():
        for value in (r.there, r.back, r.mirrored):
            assert abs(value - r.m) < 1e-3


def test_spheroid_of_null_and_equal_points(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0), (1.0, None, 1.0, 2.0), (179.0, 0.0, -179.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(spheroid_m(*(F.col(x) for x in "abcd"))).collect()]
    assert got[:2] == [0.0, None] and abs(got[2] - 2 * 111319.490793) < 1e-3


def test_within_on_the_spheroid(spark):
    """A degree of latitude at the equator is 110.574 km on the spheroid and 111.195 km on the sphere."""
    points, places = spark.createDataFrame([(1, 0.0, 0.0)], POINTS), spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0)], PLACES)
    ids = lambda **how: {r.id for r in spatial.within(points, places, 111_000.0, **how).collect()}
    assert ids() == set() and ids(spheroid=True) == {1}
