"""Results as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import US_GID

PROPERTIES = ("gid", "layer", "source", "source_id", "name", "housenumber", "street", "region", "region_a", "county", "localadmin", "locality", "neighbourhood", "label", "category", "addendum", "match_type", "accuracy")


def feature_json(hits: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """``hits`` with ``feature``: a GeoJSON feature as text, without null members; the hierarchy's ids are merged
    into the properties. ``codes``: alpha-2 to alpha-3 country codes."""
    have = set(hits.columns)
    table = {"US": "USA", "CA": "CAN", "MX": "MEX", "GB": "GBR", "FR": "FRA", "DE": "DEU", "ES": "ESP"} | (codes or {})
    alpha3 = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col("country_a")]
    parts = [F.col(c) for c in PROPERTIES if c in have]
    parts += [F.col("source_id").alias("id")] if "source_id" in have else []
    parts += [F.round(F.col(c).cast("double"), 3).alias(n) for c, n in (("confidence", "confidence"), ("distance_km", "distance")) if c in have]
    parts += [F.col("postcode").alias("postalcode")] if "postcode" in have else []
    if "country_a" in have:
        parts += [F.col("country")] if "country" in have else []
        parts += [alpha3.alias("country_a"), F.col("country_a").alias("country_code"), F.when(F.col("country_a") == "US", US_GID).alias("country_gid")]
    parts += [F.when(F.col("coarse"), F.lit(True)).alias("coarse")] if "coarse" in have else []
    plain = F.to_json(F.struct(*parts))
    hier = F.coalesce(F.to_json("hier"), F.lit("{}")) if "hier" in have else F.lit("{}")
    merged = F.when(hier.isin("{}"), plain).when(plain == "{}", hier).otherwise(F.concat(F.expr("left(_plain, length(_plain) - 1)"), F.lit(","), F.substring(F.col("_hier"), 2, 1 << 30)))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    rows = hits.withColumn("_plain", plain).withColumn("_hier", hier)
    whole = F.concat(F.lit('{"type":"Feature","geometry":'), point, F.lit(',"properties":'), merged, F.lit("}"))
    return rows.withColumn("feature", whole).drop("_plain", "_hier")


def collections(features: DataFrame, order: str = "rank") -> DataFrame:
    """One FeatureCollection for each query_id, features in order, with the box of their points; a query has at most
    the limit of results, so the list is bounded."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "feature"))), lambda x: x["feature"])
    made = features.groupBy("query_id").agg(listed.alias("f"), F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"), F.max("lat").alias("d"))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit('],"bbox":'), F.to_json(F.array("a", "b", "c", "d")), F.lit("}"))
    return made.select("query_id", body.alias("collection"))


def licence_page(regions: DataFrame, version: str, notices: dict[str, str]) -> DataFrame:
    """One row, ``page``: an HTML page with the version, the names of ``regions`` (name) in order, and a notice for each
    source; all of them escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = [F.concat(F.lit("<li>"), safe(F.lit(source)), F.lit(": "), safe(F.lit(notice)), F.lit("</li>")) for source, notice in notices.items()]
    named = safe(F.coalesce(F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY name)"), F.lit("")))
    body = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Sources</title></head><body><p>Version '), safe(F.lit(version)), F.lit("</p><p>Places of "), named, F.lit("</p><ul>"), *items, F.lit("</ul></body></html>"))
    return regions.agg(body.alias("page"))
