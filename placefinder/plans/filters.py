"""Filters that queries carry, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G

US_GID = "whosonfirst:country:85633793"
_KINDS = {
    "text": "string", "name": "string", "housenumber": "string", "street": "string", "locality": "string", "postcode": "string", "state": "string",
    "focus_lon": "double", "focus_lat": "double", "layers": "array<string>", "sources": "array<string>", "rect": "array<double>", "circle": "array<double>",
    "gid": "string", "categories": "array<string>", "country": "string", "coarse": "boolean", "size": "int",
}


def with_defaults(queries: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """Queries with every optional column, and use_coarse, cc (alpha-2, '--' if unknown) and country_ok.

    ``codes``: alpha-3 to alpha-2 country codes beyond two-letter ones, which stand for themselves.
    """
    have = set(queries.columns)
    q = queries.select("query_id", *(F.col(c).cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in _KINDS.items()))
    given = F.upper(F.trim("country"))
    table = {"USA": "US", "CAN": "CA", "MEX": "MX", "GBR": "GB", "FRA": "FR", "DEU": "DE", "ESP": "ES"} | (codes or {})
    looked_up = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[given]
    cc = F.when(F.coalesce(given, F.lit("")) == "", None).when(F.length(given) == 2, given).otherwise(F.coalesce(looked_up, F.lit("--")))
    q = q.withColumn("cc", cc).withColumn("use_coarse", F.coalesce("coarse", F.lit(True))).drop("coarse")
    return q.withColumn("country_ok", F.coalesce(F.col("cc") != "--", F.lit(True)))


def keep(build_regions: list[str] | None = None) -> Column:
    """Layers, sources, gid and categories; an unset or empty list keeps everything. A gid is met by the feature
    itself, by any area of its hierarchy, and by the country or a region of the whole build."""
    unset = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    whole = F.col("want_gid").isin(US_GID, *(f"whosonfirst:region:{r}" for r in build_regions or []))
    inside = (F.col("gid") == F.col("want_gid")) | whole | F.coalesce(F.array_contains(F.map_values("hier"), F.col("want_gid")), F.lit(False))
    return (
        (unset("layers") | F.array_contains("layers", F.col("layer")))
        & (unset("sources") | F.array_contains("sources", F.col("source")))
        & (F.col("want_gid").isNull() | inside)
        & (unset("categories") | F.coalesce(F.arrays_overlap("category", "categories"), F.lit(False)))
    )


def area_filter() -> Column:
    """Inside the rectangle and the circle, where given."""
    at = lambda c, i: F.get(c, F.lit(i))
    rect = F.col("rect").isNull() | (F.col("lon").between(at("rect", 0), at("rect", 2)) & F.col("lat").between(at("rect", 1), at("rect", 3)))
    circle = F.col("circle").isNull() | (G.haversine_m(F.col("lon"), F.col("lat"), at("circle", 0), at("circle", 1)) <= at("circle", 2))
    return rect & circle


def expand_layers(layers: Column, coarse: tuple[str, ...]) -> Column:
    """A layer list with ``coarse`` written out."""
    return F.when(F.array_contains(layers, "coarse"), F.array_union(F.array_remove(layers, "coarse"), F.array(*map(F.lit, coarse)))).otherwise(layers)
