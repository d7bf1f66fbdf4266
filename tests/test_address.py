"""Address answers by gid, text and point."""

import pytest
from pyspark.sql import functions as F

from placefinder.plans import address


@pytest.fixture(scope="module")
def feature(spark):
    rows = [
        (1, "a:address:1", "address", "12", "Oak Street", "Bath", "Sagadahoc County", "ME", "04530-1", -69.8, 43.9),
        (2, "a:address:2", "address", "14", "Oak Street", "Bath", "Sagadahoc County", "ME", "04530", -69.8, 43.902),
        (3, "o:venue:3", "venue", None, None, "Bath", "Sagadahoc County", "ME", None, -69.8, 43.9001),
        (4, "o:venue:4", "venue", None, None, "Far", None, "NH", None, -71.0, 45.0),
        (5, "w:locality:5", "locality", None, None, "Bath", "Sagadahoc County", "ME", None, -69.8, 43.9),
    ]
    names = "id long, gid string, layer string, housenumber string, street string, locality string, county string, region_a string, postcode string, lon double, lat double"
    null = F.lit(None).cast("string")
    return spark.createDataFrame(rows, names).select("*", F.col("gid").alias("label"), F.lit("a").alias("source"), null.alias("localadmin"), null.alias("postal_locality_norm"))


def rows(df):
    return {(r.query_id, r.pos): r for r in df.collect()}


def test_by_gid(spark, feature):
    asked = spark.createDataFrame([(1, ["a:address:1", "o:venue:3", "o:venue:4", "w:locality:5", "none:x:1"], "Apt 2"), (2, [], None)], "query_id long, gids array<string>, unit string")
    counties = spark.createDataFrame([("sagadahoc", "23023"), ("sagadahoc", "99001")], "county string, fips string")
    got = rows(address.answers(asked, feature, counties=counties))
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3)}
    assert got[1, 0].delivery_line == "12 OAK ST APT 2" and got[1, 0].match == "exact" and got[1, 0].zip5 == "04530"
    assert (got[1, 0].state_fips, got[1, 0].county_fips, got[1, 0].place_zip5) == ("23", "23023", "04530")
    assert got[1, 1].delivery_line == "12 OAK ST" and got[1, 1].match == "nearest" and 11 < got[1, 1].distance_m < 12
    assert got[1, 2].delivery_line is None and got[1, 2].state_fips == "33" and got[1, 2].county_fips is None
    assert got[1, 3].delivery_line is None and got[1, 3].gid == "w:locality:5"


def test_by_point(spark, feature):
    asked = spark.createDataFrame([(1, -69.8, 43.9021, None), (2, -69.8, 43.93, None), (3, -69.8, 43.93, 4.0)], "query_id long, lon double, lat double, radius_km double")
    places = spark.createDataFrame([(1, 5, 0, 0.0), (2, 5, 2, 3.0)], "query_id long, id long, grp int, distance_km double")
    got = rows(address.answers(asked, feature, places=places))
    assert {k: (r.gid, r.match) for k, r in got.items()} == {(1, 0): ("a:address:2", "nearest"), (2, 0): ("w:locality:5", "place"), (3, 0): ("a:address:2", "nearest")}


def test_by_text(spark, feature):
    asked = spark.createDataFrame([(1, "12 Oak St Apt 7, Bath"), (2, "13 Oak St, Bath"), (3, "nowhere")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 1, -69.8, 43.9, "exact", 1.0, None, 1), (1, 2, -69.8, 43.9, "exact", 0.5, None, 2), (2, 1, -69.8, 43.9015, "interpolated", 0.8, 13, 1)], "query_id long, id long, lon double, lat double, match_type string, confidence float, interpolated_number int, rank int")
    got = rows(address.answers(asked, feature, hits))
    assert set(got) == {(1, 0), (2, 0)}
    assert got[1, 0].delivery_line == "12 OAK ST APT 7"
    assert got[2, 0].delivery_line == "14 OAK ST" and got[2, 0].match == "nearest" and abs(got[2, 0].confidence - 0.8) < 1e-6


def test_units_of_texts(spark):
    texts = ["1 A St Apt 2", "1 A St suite #30b", "1 A St # 5", "1 Aptos St", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(address.unit_of(F.col("t"))).collect()] == ["Apt 2", "suite 30b", "5", None, None, None]


def test_nothing_asked(spark, feature):
    empty = spark.createDataFrame([], "query_id long, gids array<string>")
    assert address.answers(empty, feature).count() == 0
