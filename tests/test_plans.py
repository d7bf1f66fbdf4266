import pytest
from pyspark.sql import functions as F

from placefinder import queries as Q
from placefinder.operators import conflate, fuzzy, spatial
from placefinder.plans import autocomplete, build, output, search, validate
from placefinder.sources import readers, sinks


def feature_rows(spark, rows):
    """(id, source, layer, name, number, street, town, lon, lat, importance, state, coarse)"""
    empty = Q.venues(spark, "/root/testdata/sf0.001").limit(0)
    made = []
    for i, source, layer, name, number, street, town, lon, lat, importance, state, coarse in rows:
        made.append((i, f"{source}:{layer}:{i}", source, layer, str(i), name, f"{name}, {town}" if town else name, lon, lat, importance, coarse, number, street, town, state))
    df = spark.createDataFrame(made, "id long, gid string, source string, layer string, source_id string, name string, label string, lon double, lat double, importance float, coarse boolean, housenumber string, street string, locality string, region_a string")
    from placefinder.functions import text as T

    df = df.select("*", T.norm(F.col("name")).alias("name_norm"), T.norm(F.col("street")).alias("street_norm"), T.norm(F.col("locality")).alias("locality_norm"), T.hn_int(F.col("housenumber")).alias("hn_int"), F.when(F.col("layer") == "postalcode", F.col("name")).alias("postcode"), F.lit("US").alias("country_a"))
    df = df.withColumn("tokens", F.array_distinct(F.concat(T.norm_tokens(F.col("name")), F.coalesce(T.norm_tokens(F.col("locality")), F.array().cast("array<string>")))))
    return empty.unionByName(df, allowMissingColumns=True)


@pytest.fixture(scope="module")
def maine(spark):
    rows = [
        (1, "openaddresses", "address", "10 Main St", "10", "Main St", "Portland", -70.26, 43.66, 0.3, "ME", False),
        (2, "openaddresses", "address", "20 Main St", "20", "Main St", "Portland", -70.25, 43.66, 0.3, "ME", False),
        (3, "openaddresses", "address", "15 Main St", "15", "Main St", "Bangor", -68.77, 44.80, 0.3, "ME", False),
        (4, "whosonfirst", "locality", "Portland", None, None, None, -70.255, 43.66, 0.9, "ME", False),
        (5, "whosonfirst", "locality", "Bangor", None, None, None, -68.77, 44.80, 0.85, "ME", False),
        (6, "openstreetmap", "venue", "Portland Museum", None, None, "Portland", -70.256, 43.661, 0.4, "ME", False),
        (7, "zcta", "postalcode", "04101", None, None, None, -70.26, 43.66, 0.6, "ME", False),
        (8, "overture", "locality", "Portland", None, None, "Oregon", -122.67, 45.52, 0.5, "OR", True),
        (9, "openstreetmap", "street", "Main St", None, "Main St", "Portland", -70.255, 43.66, 0.35, "ME", False),
    ]
    feature = feature_rows(spark, rows).cache()
    return feature, build.street_names(feature).cache()


def ask(spark, maine, **fields):
    q = spark.createDataFrame([("q", *fields.values())], "query_id string, " + ", ".join(f"{k} string" for k in fields))
    got = search.search(q, *maine, [("ME", "Maine")])
    return got.orderBy("rank").collect()


def test_exact_address_comes_first(spark, maine):
    top = ask(spark, maine, text="10 Main St, Portland, ME", housenumber="10", street="Main St", locality="Portland", state="ME")[0]
    assert (top.id, top.match_type, top.accuracy, round(top.confidence, 3)) == (1, "exact", "point", 1.0)


def test_missing_number_is_interpolated_between_neighbours(spark, maine):
    top = ask(spark, maine, text="14 Main St, Portland", housenumber="14", street="Main St", locality="Portland")[0]
    assert (top.match_type, top.label) == ("interpolated", "14 Main St, Portland, ME, USA")
    assert top.lon == pytest.approx(-70.256) and round(top.confidence, 3) == 0.8


def test_misspelled_town_is_found(spark, maine):
    rows = ask(spark, maine, text="Portlnd", locality="Portlnd")
    assert rows[0].id == 4 and rows[0].match_type == "fallback"


def test_postcode_is_exact(spark, maine):
    top = ask(spark, maine, text="04101", postcode="04101")[0]
    assert (top.layer, top.match_type) == ("postalcode", "exact")


def test_named_state_wins_over_a_namesake(spark, maine):
    assert ask(spark, maine, text="Portland OR", locality="Portland", state="OR")[0].id == 8
    assert ask(spark, maine, text="Portland ME", locality="Portland", state="ME")[0].id == 4


def test_nonsense_has_no_answer(spark, maine):
    assert ask(spark, maine, text="zzzz qqqq") == []


def test_autocomplete_modes(spark, maine):
    feature, _ = maine
    q = spark.createDataFrame([("short", "po"), ("name", "portland mus"), ("home", "10 main"), ("typo", "portlnad"), ("none", "")], "query_id string, text string")
    got = {}
    for r in autocomplete.autocomplete(q, feature, build.prefix_table(feature)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.match_type))
    assert [i for i, _ in got["short"]] == [4, 6, 8]
    assert got["name"][0] == (6, None) and got["home"][0] == (1, None)
    assert got["typo"][0] == (4, "fallback") and "none" not in got


def test_similarity_join_loses_no_pair(spark):
    words = ["main street", "maine street", "main st", "park avenue", "parc avenue", "x", "", "main street"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "left_id int, left_text string")
    got = {(r.left_id, r.right_id) for r in fuzzy.similarity_join(df, df.toDF("right_id", "right_text"), 0.3).collect()}
    grams = [{f"  {p} "[k : k + 3] for p in w.split() for k in range(len(p) + 1)} for w in words]
    assert got == {(i, j) for i, a in enumerate(grams) for j, b in enumerate(grams) if a | b and len(a & b) / len(a | b) >= 0.3}


def test_boundary_counts_as_inside_and_holes_do_not(spark):
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    areas = spark.createDataFrame([(1, [ring(0.0, 0.0, 10.0, 10.0), ring(4.0, 4.0, 6.0, 6.0)])], "area_id int, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, 5.0), (3, 2.0, 2.0), (4, 11.0, 2.0), (5, 10.0, 10.0)], "point_id int, lon double, lat double")
    assert {r.point_id for r in spatial.containing(points, areas, 3.0).collect()} == {1, 3, 5}


def test_neighbours_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 179.99, 0.0), (2, 0.0, 89.9)], "point_id int, lon double, lat double")
    places = spark.createDataFrame([(1, -179.99, 0.0), (2, 170.0, 0.0), (3, 120.0, 89.9)], "id int, lon double, lat double")
    got = {(r.point_id, r.id) for r in spatial.within(points, places, 30000.0).collect()}
    assert got == {(1, 1), (2, 3)}


def test_conflation_prefers_source_then_votes(spark):
    rows = [(1, "address", "k", "openstreetmap", "b", 0.0, 0.0), (2, "address", "k", "openaddresses", "z", 0.001, 0.0), (3, "address", "k", "openaddresses", "a", 0.0005, 0.0), (4, "address", "k", "openaddresses", "y", 0.001, 0.0), (5, "address", "k", "openaddresses", "c", 9.0, 9.0), (6, "venue", None, "gnis", "q", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "rid long, layer string, dup_key string, source string, source_id string, lon double, lat double")
    assert sorted(r.rid for r in conflate.deduplicate(df).collect()) == [4, 5, 6]


def test_build_is_labelled_from_its_areas(spark, small):
    got = Q.build_features(spark, small)
    rows = got.collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == list(range(1, len(rows) + 1))
    inside = [r for r in rows if r.county]
    assert inside and all(r.label.endswith(f", {r.county}, {r.region_a}, USA") and r.country_a == "US" for r in inside)
    assert all(r.country_a is None for r in rows if not r.region_a)


def test_reverse_list_and_limits():
    assert validate.limits({"max_size": 50})["max_size"] == 50
    with pytest.raises(validate.RequestError):
        validate.limits({"max_size": 500})


def test_feature_collection_has_a_box(spark):
    hits = spark.createDataFrame([("q", 1, "a", -70.0, 43.0, 0.91234, None), ("q", 2, "b", -71.0, 44.0, 0.5, "x")], "query_id string, rank int, name string, lon double, lat double, confidence double, street string")
    import json

    made = json.loads(output.collections(output.feature_json(hits)).first().collection)
    assert made["bbox"] == [-71.0, 43.0, -70.0, 44.0]
    assert [f["properties"] for f in made["features"]] == [{"name": "a", "confidence": 0.912}, {"name": "b", "street": "x", "confidence": 0.5}]


def test_openaddresses_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('LON,LAT,NUMBER,STREET,UNIT,CITY,POSTCODE,HASH\n-70,43,0045,"Main ""Old"" St",,Portland,04101,h1\n-70,43,45,Main St,,,,h1\n-70,43,,Main St,,,,h2\n')
    (tmp_path / "b.csv").write_text("HASH,LON,LAT,NUMBER,STREET,CITY,UNIT,POSTCODE,EXTRA\nh3,-71,44,7,Elm St,Bangor,2,,x\n")
    got = readers.openaddresses(readers.text_csv(spark, str(tmp_path))).orderBy("source_id").collect()
    assert [(r.source_id, r.housenumber, r.street, r.lon, r.unit) for r in got] == [("h1", "45", 'Main "Old" St', -70.0, None), ("h3", "7", "Elm St", -71.0, "2")]


def test_delimiters_and_roles():
    assert readers.detect_delimiter('\n"a,b"|c|d\n') == "|"
    assert readers.detect_delimiter("abc") == ","
    assert readers.roles(["Latitude", "LNG", "Zip Code", "City"]) == {"lat": "Latitude", "lon": "LNG", "zip": "Zip Code", "city": "City"}


def test_divisions_follow_their_rules(spark):
    rows = [("a", "locality", "US", "US-CA", "Sacramento", None, 500000, 1.0, 1.0), ("b", "locality", "NO", "NO-03", "Oslo", None, 0, 1.0, 1.0), ("c", "country", "DE", None, "Deutschland", "Germany", 0, 1.0, 1.0), ("d", "locality", "US", "US-ME", "Bangor", None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, subtype string, country string, region string, name_primary string, name_en string, population int, lon double, lat double")
    countries = spark.createDataFrame([("US", "United States"), ("NO", "Norway"), ("DE", "Germany")], "country string, country_name string")
    regions = spark.createDataFrame([("NO-03", "Oslo"), ("US-CA", "California")], "region_code string, region_name string")
    got = {r.source_id: (r.name, r.label, round(r.importance, 2)) for r in readers.divisions(df, countries, regions, "US", ["ME"]).collect()}
    assert got == {"a": ("Sacramento", "Sacramento, CA, USA", 0.5), "b": ("Oslo", "Oslo, Norway", 0.35), "c": ("Germany", "Germany", 0.9), "c#alt": ("Deutschland", "Germany", 0.9)}


def test_export_fails_closed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0)], "id string, lon double, lat double")
    with pytest.raises(sinks.ExportError, match="duplicates"):
        sinks.export(rows, str(tmp_path / "x"), ["id"], "id")
    with pytest.raises(sinks.ExportError, match="no rows"):
        sinks.export(rows.limit(0), str(tmp_path / "x"), ["id"], "id")


def test_publish_flips_a_pointer(spark, tmp_path):
    import json

    version = sinks.publish({"t": spark.range(3)}, str(tmp_path))
    assert json.loads((tmp_path / "current.json").read_text())["version"] == version
    assert spark.read.parquet(f"{version}/t").count() == 3
    later = sinks.publish({"t": spark.range(4)}, str(tmp_path))
    assert json.loads((tmp_path / "current.json").read_text())["version"] == later != version
    assert not [f for f in tmp_path.iterdir() if f.name.startswith("current.json.")]


def test_dumps_are_restored_whole_or_not_at_all(spark, tmp_path):
    import json

    root, dump = str(tmp_path / "a"), str(tmp_path / "dump")
    sinks.publish({"t": spark.range(5), "u": spark.range(3)}, root, {"made": "here"})
    sinks.dump(spark, root, dump, {"t": ["id"]})
    version = sinks.restore(spark, dump, str(tmp_path / "b"))
    assert sorted(r.id for r in spark.read.parquet(f"{version}/t").collect()) == list(range(5))
    assert json.loads((tmp_path / "b" / "current.json").read_text())["version"] == version
    spark.range(1, 6).write.mode("overwrite").parquet(f"{dump}/t")  # as many rows, other ones
    with pytest.raises(sinks.ExportError, match="not as expected: t"):
        sinks.restore(spark, dump, str(tmp_path / "b"))
    assert json.loads((tmp_path / "b" / "current.json").read_text())["version"] == version
    with pytest.raises(sinks.ExportError, match="no manifest"):
        sinks.restore(spark, root, str(tmp_path / "b"))


def test_manifest_keeps_other_runs(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_bytes(b"a,b")
    (tmp_path / "in" / "empty.csv").write_bytes(b"")
    found = {r.file.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in sinks.digests(spark, str(tmp_path / "in")).collect()}
    assert found == {"x.csv": (3, hashlib.sha256(b"a,b").hexdigest()), "empty.csv": (0, hashlib.sha256(b"").hexdigest())}
    path = str(tmp_path / "manifest.json")
    sinks.record(spark, path, {"one": {"rows": 1}, "two": {"rows": 2}})
    assert sinks.record(spark, path, {"two": {"rows": 3}})["outputs"] == {"one": {"rows": 1}, "two": {"rows": 3}}


def test_csv_headers_after_blank_lines_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("\n  \ny,z\n3,4\n")
    (tmp_path / "c.csv").write_text("")
    rows = readers.text_csv(spark, str(tmp_path))
    assert {(r.x, r.y, r.z) for r in rows.collect()} == {("1", "2", None), (None, "3", "4")}


def test_cases_say_names_otherwise(spark):
    from placefinder.plans import cases

    rows = spark.createDataFrame([(1, "Lake Street, Bath"), (2, "ab"), (3, "")], "id int, name string")
    got = rows.select("id", cases.misspelled(F.col("name"), F.lit(0.0)).alias("low"), cases.misspelled(F.col("name"), F.lit(0.999999)).alias("high"), cases.reworded(F.col("name")).alias("other")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [("Lkae Street, Bath", "Lake Street, Baht", "lake st bath"), ("ab", "ab", "ab"), ("", "", "")]
    for row in cases.typed(rows).collect():
        name = {1: "Lake Street, Bath", 2: "ab", 3: ""}[row.id]
        assert name.startswith(row.text) and len(row.text) >= min(3, len(name))


def test_sql_functions_equal_the_columns(spark):
    from placefinder.functions import sql, text

    sql.register(spark)
    spark.createDataFrame([("St Mary's Ave",), ("12 Main St",), ("Éloi  st N",), ("",), (None,)], "x string").createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT x, pf_norm(x) AS n, pf_similarity(x, 'main st') AS s FROM sql_texts")
    for row in got.select("x", "n", "s", text.norm(F.col("x")).alias("n2"), text.similarity(F.col("x"), F.lit("main st")).alias("s2")).collect():
        assert row.n == row.n2 and row.s == row.s2


def test_cells_are_guarded(spark):
    df = spark.createDataFrame([("=1+1",), ("-5",), ("x",)], "c string")
    assert [r[0] for r in df.select(sinks.guarded(F.col("c"))).collect()] == ["'=1+1", "-5", "x"]


def test_stream_answers_batches(spark, tmp_path):
    from placefinder.streaming.search import answer

    spark.range(3).selectExpr("id AS query_id", "'Main St' AS text").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, text string").json(str(tmp_path / "in"))
    run = answer(stream, lambda q: q.select("query_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_osm_points_and_areas_follow_the_tag_rules(spark):
    shape = "osm_id string, osm_way_id string, name string, amenity string, tourism string, natural string, sport string, addr_housenumber string, addr_street string, addr_city string, lon double, lat double"
    rows = [
        ("1", None, "Bean", "cafe", None, None, None, "4", "Elm St", "Bath", -70.0, 43.0), ("2", None, "Oak", None, None, "tree", None, None, None, None, -70.0, 43.0),
        ("3", None, "Field", None, None, None, "golf", None, None, None, -70.0, 43.0), ("4", "77", "Art", None, "museum", "water", None, None, None, None, -70.1, 43.1), ("5", None, None, None, None, None, None, "6", "Elm St", None, -70.0, 43.0),
    ]
    df = spark.createDataFrame(rows, shape)
    nodes = {(r.layer, r.source_id): (r.name, r.category, r.popularity) for r in readers.osm_points(df.filter("osm_id <> '4'")).collect()}
    assert nodes == {
        ("venue", "node/1"): ("Bean", ["amenity=cafe"], 0.05), ("venue", "node/3"): ("Field", ["sport=golf"], 0.0),
        ("address", "node/1"): ("4 Elm St", None, None), ("address", "node/5"): ("6 Elm St", None, None),
    }
    areas = {(r.layer, r.source_id): (r.name, r.category, r.popularity, r.lon) for r in readers.osm_polygons(df.filter("osm_id >= '4'")).collect()}
    assert areas == {("venue", "way/77"): ("Art", ["tourism=museum", "natural=water"], 0.2, -70.1), ("address", "relation/5"): ("6 Elm St", None, None, -70.0)}


def test_osm_roads_of_one_name_merge_when_near(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [
        ("10", "Elm St", "residential", line((0, 0), (0.1, 0))), ("11", "Elm St", "service", line((0.102, 0), (0.2, 0))), ("12", "Elm St", "residential", line((0.05, -0.01), (0.05, 0.01))),
        ("13", "Elm St", "residential", line((0.3, 0), (0.4, 0))), ("14", "Oak St", "residential", line((0, 0), (0.1, 0))), ("15", "Path", "footway", line((0, 0), (0.1, 0))), ("16", None, "primary", line((0, 0), (0.1, 0))),
    ]
    got = {r.source_id: (r.layer, r.name, r.street, round(r.lon, 6), round(r.lat, 6)) for r in readers.osm_lines(spark.createDataFrame(rows, "osm_id string, name string, highway string, line array<struct<x:double,y:double>>")).collect()}
    assert set(got) == {"way/10", "way/13", "way/14"}
    assert got["way/13"] == ("street", "Elm St", "Elm St", 0.35, 0.0) and got["way/14"][1:4] == ("Oak St", "Oak St", 0.05)
    assert got["way/10"][3] == pytest.approx((0.1 * 0.05 + 0.098 * 0.151 + 0.02 * 0.05) / 0.218, abs=1e-6)


def test_clip_keeps_the_shore_and_drops_the_neighbour(spark):
    square = lambda x0, x1: [[(float(x), float(y)) for x, y in ((x0, 0), (x1, 0), (x1, 1), (x0, 1), (x0, 0))]]
    shape = "area_id long, rings array<array<struct<x:double,y:double>>>"
    inside, outside = spark.createDataFrame([(1, square(0, 1))], shape), spark.createDataFrame([(2, square(-1, 0))], shape)
    rows = [("in", 0.5, 0.5), ("pier", 1.0029, 0.5), ("far", 1.0031, 0.5), ("corner", 1.002, 1.002), ("off corner", 1.0025, 1.0025), ("abroad", -0.001, 0.5), ("south", 0.5, -0.003)]
    points = spark.createDataFrame(rows, "point_id string, lon double, lat double")
    kept = lambda **k: {r.point_id for r in spatial.clip(points, inside, outside, F.lit(False), 1.0, **k).collect()}
    assert kept() == {"in", "pier", "corner", "south"} and kept(buffer=0.0) == {"in"}


def test_every_address_is_asked(spark, small):
    address = lambda df: {tuple(r) for r in df.select("street", "locality", "housenumber").distinct().collect()}
    asked = address(Q.asked_places(spark, small).filter("housenumber IS NOT NULL"))
    homes = address(Q.homes(spark, small))
    assert all((s, t, n) in asked or (s, t, str(int(n) + 2)) in asked for s, t, n in homes)
    assert {int(n) % 2 for _, _, n in asked} == {0, 1}


def test_unit_tails_go_with_what_follows(spark):
    rows = [(1, "12 Main St Suite 100 Rear", "Bath", "ME"), (2, "12 Main St, Bldg C", "Bath", "ME"), (3, "12 Building St", "Bath", "ME"), (4, "12 Main St #4 back", "Bath", "ME"), (5, "12 Main St Floor", "Bath", "ME"), (6, "12 Floor Rd rm. 2B", "Bath", "ME")]
    df = spark.createDataFrame(rows, "row_id int, `Street Address` string, Municipality string, St string")
    got = {r.row_id: r.text for r in readers.batch_jobs(df).collect()}
    assert got == {1: "12 Main St, Bath, ME", 2: "12 Main St, Bath, ME", 3: "12 Building St, Bath, ME", 4: "12 Main St, Bath, ME", 5: "12 Main St, Bath, ME", 6: "12 Floor Rd, Bath, ME"}


def test_request_values_are_checked(spark):
    rows = [("a", None, None, "us", "whosonfirst:locality:1", "cafe, shop=x", "en-US", "true"), ("b", 95.0, 0.0, "usa1", "x", "Ünder", "e", "maybe"), ("c", 1.0, None, None, None, ",".join(f"c{i}" for i in range(21)), None, None)]
    df = spark.createDataFrame(rows, "query_id string, focus_lat double, focus_lon double, country string, gid string, categories string, lang string, coarse string")
    got = {r.query_id: (len(r.errors), r.categories) for r in validate.checked(df).collect()}
    assert got["a"] == (0, ["cafe", "shop=x"]) and got["b"][0] == 6 and got["c"][0] == 2


def test_other_parsers_are_mended_by_the_rules(spark):
    from placefinder.plans import parse

    shape = "query_id int, components map<string,string>"
    other = parse.from_components(spark.createDataFrame([(1, {"house_number": "12", "house": "wenbelle df buckspotr me"}), (2, {"house_number": "389", "road": "congress st", "suburb": "portland", "state": "me"}), (3, {"house": "jetport"})], shape))
    texts = spark.createDataFrame([(1, "12 Wenbelle Df, Buckspotr, ME"), (2, "x"), (3, "jetport")], "query_id int, text string")
    towns = spark.createDataFrame([("portland", "ME", False)], "name string, region_a string, coarse boolean")
    got = {r.query_id: (r.name, r.housenumber, r.street, r.locality, r.state) for r in parse.with_rule_fallback(other, parse.parse(texts, towns, ["ME"])).collect()}
    assert got == {1: (None, "12", "Wenbelle Df", "Buckspotr", None), 2: (None, "389", "congress st", "portland", "me"), 3: ("jetport", None, None, None, None)}


def brute_inside(x, y, rings):
    """Even-odd over all rings, boundaries inside."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_points_in_ragged_areas_of_all_sizes(spark):
    import math
    import random

    rng = random.Random(1)

    def star(cx, cy, r, n):
        ring = [(round(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), 3), round(cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n), 3)) for i in range(n)]
        return [*ring, ring[0]]

    areas = [(i, [star(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.05, 0.5, 4, 30]), rng.randint(3, 40))]) for i in range(40)]
    areas += [(100, [[(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0), (-5.0, -5.0)], [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]]), (101, [])]
    points = [(i, round(rng.uniform(-25, 25), 2), round(rng.uniform(-25, 25), 2)) for i in range(600)] + [(1000 + k, *p) for k, p in enumerate(areas[0][1][0])] + [(2000, 1.0, 0.0), (2001, 0.0, 0.0), (2002, -5.0, 2.0)]
    a = spark.createDataFrame(areas, "area_id int, rings array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame(points, "point_id int, lon double, lat double")
    want = {(i, j) for i, x, y in points for j, rings in areas if brute_inside(x, y, rings)}
    for size in (None, 3.0):
        assert {(r.point_id, r.area_id) for r in spatial.containing(p, a, size).collect()} == want


def test_search_with_state_area_focus_and_layers(spark, maine):
    shape = "query_id string, text string, locality string, state string, rect array<double>, circle array<double>, focus_lon double, focus_lat double, layers array<string>, country string, coarse boolean"
    rows = [
        ("rect", "Portland", "Portland", None, [-71.0, 43.0, -69.0, 45.0], None, None, None, None, None, None), ("circle", "Portland", "Portland", None, None, [-122.67, 45.52, 5000.0], None, None, None, None, None),
        ("focus", "Portland", "Portland", None, None, None, -122.6, 45.5, None, None, None), ("layers", "Portland", "Portland", None, None, None, None, None, ["venue"], None, None), ("abroad", "Portland", "Portland", None, None, None, None, None, None, "FR", None),
        ("own", "Portland OR", "Portland", "OR", None, None, None, None, None, None, False), ("nowhere", "Portland", "Portland", None, [0.0, 0.0, 1.0, 1.0], None, None, None, None, None, None), ("unknown", "Portland", "Portland", None, None, None, None, None, None, "XYZ", None),
    ]
    found: dict = {}
    for r in search.search(spark.createDataFrame(rows, shape), *maine, [("ME", "Maine")]).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.layer))
    assert found["rect"][0][0] == 4 and 8 not in [i for i, _ in found["rect"]]
    assert [i for i, _ in found["circle"]] == [8] and found["focus"][0][0] in (4, 8) and {x for _, x in found["layers"]} == {"venue"}
    assert not {"abroad", "own", "nowhere", "unknown"} & set(found)


def test_rows_alike_do_not_multiply_candidates(spark, monkeypatch):
    homes = [(i, "openaddresses", "address", "10 Main St", "10", "Main St", "Portland", -70.0 + i / 1000, 43.66, 0.3, "ME", False) for i in range(1, 151)]
    shops = [(i, "overture", "venue", "Blue Ring", None, None, None, -70.0 + i / 1000, 43.66, 0.4, "ME" if i % 2 else "NH", False) for i in range(201, 351)]
    feature = feature_rows(spark, homes + shops).cache()
    street_name = build.street_names(feature).cache()
    shape = "query_id string, text string, name string, housenumber string, street string, locality string, state string, focus_lon double, focus_lat double, circle array<double>"
    address = ("10 Main St, Portland", None, "10", "Main St", "Portland")
    sizes = []
    whole = search.save
    monkeypatch.setattr(search, "save", lambda *given: (out := whole(*given), sizes.append(out.count()))[0])
    asked = [("home", *address, None, None, None, None), ("shop", "Blue Rng", "Blue Rng", None, None, None, None, None, None, None)]
    got = {(r.query_id, r.id) for r in search.search(spark.createDataFrame(asked, shape), feature, street_name, []).collect()}
    assert got == {("home", 1), ("shop", 201)} and max(sizes) <= 2 * search.NAMES
    # Queries that can tell them apart still meet all of them.
    asked = [("focus", *address, None, -69.86, 43.66, None), ("circle", *address, None, None, None, [-69.87, 43.66, 20.0]), ("shop", "Blue Rng", "Blue Rng", None, None, None, None, -69.68, 43.66, None), ("state", "Blue Ring", "Blue Ring", None, None, None, "NH", None, None, None)]
    got = {(r.query_id, r.id) for r in search.search(spark.createDataFrame(asked, shape), feature, street_name, [("NH", "New Hampshire")]).collect()}
    assert got == {("focus", 140), ("circle", 130), ("shop", 320), ("state", 202)}
