"""Postal-standard addresses of features, and of the address nearest a feature or point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.refdata import STATES, UNITS
from ..operators import knn
from ..operators.fuzzy import top
from ..operators.tables import save

# Gids answered at once, and the radius in kilometres where none is given and at most.
MOST_IDS, RADIUS_KM, MOST_KM = 10, 0.5, 5.0
_UNIT = r"(?i)\b(" + "|".join(sorted(UNITS)) + r")\b\.?\s*#?\s*([a-z0-9-]+)"


def postal(feature: DataFrame, kind: Column | str = "address", unit: Column | None = None, suffixes: dict[str, str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id and the parts, delivery line and last line of each address row, and the columns named in ``carry``."""
    unit = F.lit(None).cast("string") if unit is None else unit
    number = F.nullif(F.upper(F.regexp_replace(F.coalesce("housenumber", F.lit("")), r"\s+", "")), F.lit(""))
    city = F.nullif(F.upper(F.coalesce(F.nullif(F.col("postal_locality_norm"), F.lit("")), T.norm(F.coalesce("locality", "localadmin")))), F.lit(""))
    rows = feature.select(*carry, "id", "gid", "source", "lat", "lon", number.alias("primary_number"), T.postal_street(F.col("street"), suffixes).alias("s"), T.postal_unit(unit).alias("u"), city.alias("city"), F.upper("region_a").alias("state"), F.nullif(F.regexp_extract("postcode", r"\d{5}", 0), F.lit("")).alias("zip5"))
    rows = rows.select(*carry, "id", "gid", "source", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "primary_number", "s.*", F.col("u.designator").alias("secondary_designator"), F.col("u.unit_number").alias("secondary_number"), "city", "state", "zip5", (F.lit(kind) if isinstance(kind, str) else kind).alias("match"))
    line = F.nullif(F.concat_ws(" ", "primary_number", "predirectional", "street_name", "suffix", "post_modifier", "postdirectional", "secondary_designator", "secondary_number"), F.lit(""))
    return rows.select("*", line.alias("delivery_line"), F.nullif(F.concat_ws(" ", "city", "state", "zip5"), F.lit("")).alias("last_line"))


def nearest_address(points: DataFrame, feature: DataFrame, radius_m: float = 5000.0) -> DataFrame:
    """The nearest address of each point (point_id, lon, lat): point_id, id, distance_m."""
    return knn.nearest(points, feature.filter("layer = 'address'").select("id", "lon", "lat"), 1, radius_m).drop("rank")


def unit_of(text: Column) -> Column:
    """The secondary unit a text names ("Apt 2"), else what follows a number sign; null without either."""
    named = F.concat_ws(" ", F.nullif(F.regexp_extract(text, _UNIT, 1), F.lit("")), F.nullif(F.regexp_extract(text, _UNIT, 2), F.lit("")))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)#\s*([a-z0-9-]+)", 1), F.lit("")))


def context(feature: DataFrame, counties: DataFrame | None = None) -> DataFrame:
    """id and the place each feature lies in: town, county and state with their FIPS codes, zip5. ``counties``: county
    (lower case, without the word), fips; a county counts only in the state its code begins with."""
    rows = feature.select("id", F.coalesce("locality", "localadmin").alias("place_town"), F.col("county").alias("place_county") if "county" in feature.columns else F.lit(None).cast("string").alias("place_county"), F.col("region_a").alias("state_code"), _state_fips(F.col("region_a")).alias("state_fips"), F.nullif(F.regexp_extract("postcode", r"\d{5}", 0), F.lit("")).alias("place_zip5"))
    if counties is None:
        return rows.withColumn("county_fips", F.lit(None).cast("string"))
    known = counties.groupBy("county", F.substring("fips", 1, 2).alias("state_fips")).agg(F.min("fips").alias("county_fips"))
    named = F.lower(F.regexp_replace("place_county", r"(?i)\s+County$", ""))
    return rows.withColumn("_county", named).join(known.withColumnRenamed("county", "_county"), ["_county", "state_fips"], "left").drop("_county")


def _state_fips(abbr: Column) -> Column:
    return F.create_map(*(F.lit(x) for a, _, code in STATES if a and code for x in (a, code)))[abbr]


def answers(asked: DataFrame, feature: DataFrame, hits: DataFrame | None = None, places: DataFrame | None = None, counties: DataFrame | None = None, suffixes: dict[str, str] | None = None) -> DataFrame:
    """Address answers: query_id, pos, gid, label, confidence, match, distance_m, the parts of :func:`postal` and
    :func:`context`.

    ``asked`` has query_id and one of gids (array; the first ten count), text, or lon and lat; and optionally radius_km
    and unit. A text's answer is its best row of ``hits`` (of :func:`.search.search`), with the unit the text names; a
    number between two others is answered by the nearest address. A point's is the nearest address in its radius, else
    its best row of ``places`` (of :func:`.reverse.reverse`, towns alone). Addresses answer for themselves, venues and
    streets through the nearest address, anything else by its context. A gid that isn't held has no row.
    """
    have = set(asked.columns)
    given = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    reach = F.least(F.coalesce(given("radius_km", "double"), F.lit(RADIUS_KM)), F.lit(MOST_KM)) * 1000
    q = asked.select("query_id", given("gids", "array<string>"), given("text", "string"), given("lon", "double"), given("lat", "double"), given("unit", "string"), reach.alias("reach"))
    narrow = feature.select("id", "gid", "layer", "label", F.col("lon").alias("flon"), F.col("lat").alias("flat"))
    shape = ["query_id", "pos", "id", "gid", "layer", "label", "flon", "flat", "unit", "reach", "confidence", "match"]
    none = lambda kind: F.lit(None).cast(kind)

    listed = q.filter("gids IS NOT NULL").select("query_id", "unit", "reach", F.posexplode(F.slice("gids", 1, MOST_IDS)).alias("pos", "gid"))
    found = listed.join(narrow, "gid").withColumn("confidence", F.lit(1.0).cast("float")).withColumn("match", F.lit("exact")).select(*shape)
    points = q.filter("gids IS NULL AND text IS NULL").select("query_id", "lon", "lat", "unit", "reach", none("float").alias("confidence"))
    if hits is not None:
        best = hits.filter("rank = 1").select("query_id", F.col("id").alias("hit"), F.col("lon").alias("hlon"), F.col("lat").alias("hlat"), "match_type", "confidence", "interpolated_number")
        answered = q.filter("gids IS NULL AND text IS NOT NULL").join(best, "query_id")
        plain = answered.filter("interpolated_number IS NULL").withColumn("id", F.col("hit")).join(narrow, "id")
        kind = F.when(F.col("match_type") == "exact", "exact").otherwise("fallback")
        plain = plain.withColumn("unit", F.coalesce("unit", unit_of(F.col("text")))).withColumn("pos", F.lit(0)).withColumn("match", kind)
        found = found.unionByName(plain.select(*shape))
        between = answered.filter("interpolated_number IS NOT NULL")
        points = points.unionByName(between.select("query_id", F.col("hlon").alias("lon"), F.col("hlat").alias("lat"), none("string").alias("unit"), "reach", "confidence"))
    found, points = save(found), save(points)

    # One search for the nearest address of all that need one: points, and the places that are no address themselves.
    beside = found.filter(F.col("layer").isin("venue", "street")).select(F.struct("query_id", "pos").alias("point_id"), F.col("flon").alias("lon"), F.col("flat").alias("lat"), "reach")
    near = beside.unionByName(points.select(F.struct("query_id", F.lit(-1).alias("pos")).alias("point_id"), "lon", "lat", "reach"))
    near = near.join(nearest_address(near, feature, MOST_KM * 1000).withColumnRenamed("id", "near"), "point_id").filter(F.col("distance_m") <= F.col("reach"))
    near = save(near.select("point_id.query_id", "point_id.pos", "near", "distance_m"))

    own = found.join(near, ["query_id", "pos"], "left").withColumn("address", F.when(F.col("layer") == "address", F.col("id")).otherwise(F.col("near")))
    own = own.withColumn("unit", F.when(F.col("layer") == "address", F.col("unit"))).withColumn("match", F.when(F.col("near").isNotNull(), "nearest").otherwise(F.col("match")))
    columns = ["query_id", "pos", "id", "gid", "label", "confidence", "match", "distance_m", "address", "unit"]
    met = points.join(near.filter("pos = -1").drop("pos"), "query_id").join(narrow.withColumnRenamed("id", "near"), "near")
    met = met.select("query_id", F.lit(0).alias("pos"), F.col("near").alias("id"), "gid", "label", "confidence", F.lit("nearest").alias("match"), "distance_m", F.col("near").alias("address"), "unit")
    out = own.select(*columns).unionByName(met)
    if places is not None:
        town = top(places.join(points.join(near.filter("pos = -1"), "query_id", "left_anti").select("query_id"), "query_id", "left_semi").drop("rank"), ["query_id"], [F.col("grp"), F.col("distance_km"), F.col("id")], 1)
        town = town.select("query_id", "id").join(narrow, "id")
        out = out.unionByName(town.select("query_id", F.lit(0).alias("pos"), "id", "gid", "label", none("float").alias("confidence"), F.lit("place").alias("match"), none("double").alias("distance_m"), none("bigint").alias("address"), none("string").alias("unit")))
    out = save(out)
    rows = feature.join(out.select(F.col("address").alias("id")).distinct(), "id", "left_semi")
    lines = postal(rows.join(out.filter("address IS NOT NULL").select(F.col("address").alias("id"), F.col("unit").alias("_unit")).distinct(), "id"), unit=F.col("_unit"), suffixes=suffixes, carry=("_unit",))
    lines = lines.drop("gid", "match", "source").withColumnRenamed("id", "address")
    told = out.join(lines.withColumnRenamed("_unit", "_u"), (out["address"] == lines["address"]) & out["unit"].eqNullSafe(F.col("_u")), "left").drop(lines["address"]).drop("_u", "unit", "address")
    return told.join(context(feature.join(out.select("id").distinct(), "id", "left_semi"), counties), "id").drop("id")
