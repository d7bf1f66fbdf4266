"""Fixed cases: postal parts of streets and units, what the parser makes of texts, what the gate and the checks say."""

from pyspark.sql import functions as F

from placefinder.functions import text as T
from placefinder.plans import evaluate, parse, validate

# Streets and their postal parts.
STREETS = [
    ("Congress Street", None, "CONGRESS", "ST", None, None), ("North Main Street", "N", "MAIN", "ST", None, None), ("Main St N", None, "MAIN", "ST", "N", None), ("North Street", None, "NORTH", "ST", None, None),
    ("US Route 1", None, "US ROUTE 1", None, None, None), ("Rte 202", None, "ROUTE 202", None, None, None), ("St. John Street", None, "ST JOHN", "ST", None, None), ("East Main Street Extension", "E", "MAIN", "ST", None, "EXT"),
    ("Park Avenue West", None, "PARK", "AVE", "W", None), ("West Broadway", "W", "BROADWAY", None, None, None), ("US Route 2 W", None, "US ROUTE 2", None, "W", None), ("Parkway N", None, "PARKWAY", None, "N", None),
]

# Units and their postal parts.
UNITS = [("Apt 2", "APT", "2"), ("Suite 200", "STE", "200"), ("#3", "#", "3"), ("2B", "#", "2B"), ("Rear", "REAR", None), ("", None, None)]

# Texts and what the parser makes of them (name, number, street, town, ZIP, state), for a build that
# holds Maine, New York, New Hampshire and Arizona.
PARSED = [
    ("389 Congress St, Portland, ME 04101", None, "389", "Congress St", "Portland", "04101", "ME"),
    ("12 Main St South Portland Maine", None, "12", "Main St", "South Portland", None, "ME"),
    ("210 State St Apt 2, Augusta, ME", None, "210", "State St", "Augusta", None, "ME"),
    ("Jordan Pond, Bar Harbor", "Jordan Pond", None, None, "Bar Harbor", None, None),
    ("Bangor ME", None, None, None, "Bangor", None, "ME"),
    ("Moosehead Lake", None, None, None, None, None, None),
    ("73 Harlow St Bangor 04401-5102", None, "73", "Harlow St", "Bangor", "04401", None),
    ("27 Libert St, Newcatsle, ME", None, "27", "Libert St", "Newcatsle", None, "ME"),
    ("350 5th Ave, New York, NY", None, "350", "5th Ave", "New York", None, "NY"),
    ("350 5th Ave, New York", None, "350", "5th Ave", "New York", None, None),
    ("101 Penbrooke Drive Penfield New York", None, "101", "Penbrooke Drive", "Penfield", None, "NY"),
    ("5 Elm St North Conway New Hampshire", None, "5", "Elm St", "North Conway", None, "NH"),
    ("13023 E Lima St, Prescott Valley", None, "13023", "E Lima St", "Prescott Valley", None, None),
    ("13023 E Lima St, Prescott Valley AZ 86314", None, "13023", "E Lima St", "Prescott Valley AZ", "86314", "AZ"),
    ("Sacramento CA", None, None, None, "Sacramento", None, "CA"),
    ("Sacramento MD", None, None, None, None, None, None),
    ("Eric Broen, MD", None, None, None, None, None, None),
    ("Steawrt, AZ", None, None, None, "stewart", None, "AZ"),
    ("Bangro", None, None, None, "bangor", None, None),
]
TOWNS = [("portland", "ME"), ("south portland", "ME"), ("bar harbor", "ME"), ("augusta", "ME"), ("bangor", "ME"), ("new york", "NY"), ("penfield", "NY"), ("north conway", "NH"), ("prescott valley", "AZ"), ("stewart", "AZ")]

# Two runs and what the gate says of them.
BASE = [("ALL", 1560, 1495, 0.958, 0.686), ("address/exact", 200, 196, 0.98, None), ("lake/typo", 50, 43, 0.86, None), ("level:F1", 300, 261, 0.87, None)]
NOW = [("ALL", 1560, 1485, 0.952, 0.70), ("address/exact", 200, 193, 0.965, None), ("lake/typo", 50, 40, 0.80, None), ("level:F1", 300, 260, 0.868, None)]


def test_streets(spark):
    rows = spark.createDataFrame([(s[0],) for s in STREETS], "street string")
    got = rows.select("street", T.postal_street(F.col("street")).alias("s")).select("street", "s.*").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(STREETS, key=repr)


def test_units(spark):
    rows = spark.createDataFrame([(u[0],) for u in UNITS], "unit string")
    got = rows.select("unit", T.postal_unit(F.col("unit")).alias("u")).select("unit", "u.*").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(UNITS, key=repr)


def test_parsed_texts(spark):
    towns = spark.createDataFrame([(n, s, False) for n, s in TOWNS] + [("sacramento", "CA", True)], "name string, region_a string, coarse boolean")
    texts = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARSED)], "query_id long, text string")
    got = parse.parse(texts, towns, ["ME", "NY", "NH", "AZ"]).select("text", "name", "housenumber", "street", "locality", "postcode", "state").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(PARSED, key=repr)


def test_gate(spark):
    shape = "grp string, n long, n_correct long, correct double, conf_when_wrong double"
    got = evaluate.gate(spark.createDataFrame(BASE, shape), spark.createDataFrame(NOW, shape)).collect()
    assert sorted(map(tuple, got)) == [("ALL", "overall"), ("lake/typo", "group")]


def test_request_checks(spark):
    asked = [(1, "portland", "venue,oa", 10, 44.0, -70.0), (2, "", "coarse", 0, 44.0, None), (3, "x", "town", 41, 95.0, 1.0)]
    rows = spark.createDataFrame(asked, "query_id int, text string, layers string, size int, lat double, lon double")
    got = validate.checked(rows).select("query_id", F.size("errors"), F.size("layers")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 3, 7), (3, 3, 1)]
