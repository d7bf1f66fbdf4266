"""Stored features and postings: the same answers as without, and no shuffle of what is stored."""

import pytest
from pyspark.sql import functions as F

from placefinder import queries
from placefinder.operators import postings
from placefinder.operators.fuzzy import similarity_join
from placefinder.operators.tables import work_dir
from placefinder.plans import build, search
from placefinder.sources.sinks import ExportError


@pytest.fixture(scope="module")
def stored(spark, small):
    feature = queries.venues(spark, small).unionByName(queries.homes(spark, small))
    folder = f"{work_dir(spark)}/index"
    postings.store(feature, folder, 8)
    return feature, postings.open_stored(spark, folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_reopened_tables_hold_every_row(stored):
    feature, held = stored
    assert sorted(r.id for r in held.feature.select("id").collect()) == sorted(r.id for r in feature.select("id").collect())
    assert held.tokens.count() == feature.select(F.explode("tokens")).count()


def test_similar_equals_the_full_join(stored):
    feature, held = stored
    names = feature.filter("layer <> 'address'").select("name_norm").distinct()
    asked = names.select(F.concat(F.substring("name_norm", 2, 40), F.lit(" qx")).alias("q")).unionByName(names.limit(3).select(F.lit("").alias("q")))
    for threshold in (0.3, 0.5):
        want = {(r.q, r.name_norm, round(r.sim, 9)) for r in similarity_join(asked.distinct(), names, threshold, "q", "q", "name_norm", "name_norm").collect()}
        assert {(r.q, r.name_norm, round(r.sim, 9)) for r in held.similar(asked, threshold, "q").collect()} == want
        assert want
    with pytest.raises(ValueError):
        held.similar(asked, 0.2, "q")


@pytest.mark.parametrize("name, key", [("tokens", "token"), ("grams", "gram"), ("names", "name_norm"), ("feature", "id")])
def test_index_side_is_not_shuffled(spark, stored, no_broadcast, name, key):
    side = getattr(stored[1], name)
    asked = spark.range(100).select(F.col("id").cast(side.schema[key].dataType).alias(key))
    shown = plan(asked.join(side, key))
    assert shown.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in shown


def test_scan_opens_the_layers_asked_for(stored):
    shown = stored[1].tokens.filter("layer = 'address'")._jdf.queryExecution().explainString(stored[0].sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(layer" in shown and "= address)]" in shown


def test_search_with_an_index_answers_alike(spark, small, stored):
    feature, held = stored
    asked = queries.asked_places(spark, small).filter("housenumber IS NULL")
    streets, states = build.street_names(feature), [("ME", "Maine"), ("NH", "New Hampshire")]
    rows = lambda df: sorted((r.query_id, r.gid, round(r.confidence, 5), r["rank"]) for r in df.collect())
    got = rows(search.search(asked, feature, streets, states, held))
    assert got and got == rows(search.search(asked, feature, streets, states))


def test_empty_features_and_missing_manifest(spark, stored):
    folder = f"{work_dir(spark)}/index-empty"
    postings.store(stored[0].limit(0), folder, 2)
    held = postings.open_stored(spark, folder)
    assert held.similar(spark.createDataFrame([("oak",)], "q string"), 0.3, "q").count() == 0 and held.tokens.count() == 0
    with pytest.raises(ExportError):
        postings.open_stored(spark, f"{work_dir(spark)}/nothing")
