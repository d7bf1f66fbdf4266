"""What is at a coordinate: nearest points, containing areas, worldwide towns and worldwide areas.

``points``: query_id, lon, lat, and optionally layers, sources, radius_km, size, gid, categories,
country, coarse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.refdata import LIMITS
from ..operators import spatial
from ..operators.fuzzy import top
from ..operators.tables import save
from .filters import keep, with_defaults

# Which layers each branch answers, and the order of containing areas.
POINTS = ("address", "venue", "street")
ADMIN, ADMIN_DEFAULT = ("neighbourhood", "locality", "localadmin", "county", "region", "postalcode"), ("neighbourhood", "locality", "localadmin", "county", "region")
AREAS, COARSE = ("region", "country"), ("locality", "localadmin", "county")
ADMIN_ORDER = ("neighbourhood", "locality", "localadmin", "postalcode", "county", "region")
TOWN_CONFIDENCE, AREA_CONFIDENCE = 0.45, 0.7
#: Metres that are looked around a point, one after the other, before the greatest radius.
RINGS = (1000.0, 8000.0)


def _branch(all_layers: tuple[str, ...], default: tuple[str, ...] | None = None) -> Column:
    """Layers a branch may answer with: those asked for that it knows, or its default."""
    known = F.array(*map(F.lit, all_layers))
    return F.when(F.size(F.coalesce("layers", F.array().cast("array<string>"))) > 0, F.array_intersect("layers", known)).otherwise(F.array(*map(F.lit, default or all_layers)))


def reverse(points: DataFrame, feature: DataFrame, admin: DataFrame, coarse_areas: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """query_id, id, grp, confidence, distance_km, rank. ``admin``: area_id, placetype, rings, feature_id;
    ``coarse_areas``: area_id, layer, rings, feature_id. Postcode areas answer only where asked for."""
    radius = F.col("radius_km").cast("double") if "radius_km" in points.columns else F.lit(None).cast("double")
    q = with_defaults(points).filter("country_ok").drop("name", "housenumber", "street", "locality", "postcode", "state", "text", "rect", "circle", "focus_lon", "focus_lat", "country")
    q = q.join(points.select("query_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), radius.alias("radius_km")), "query_id").withColumnRenamed("gid", "want_gid")
    most = float(LIMITS["max_reverse_km"][0])
    q = q.withColumn("radius_m", F.least(F.coalesce("radius_km", F.lit(50.0)), F.lit(most)) * 1000)
    q = q.withColumn("lim", F.least(F.greatest(F.coalesce("size", F.lit(10)), F.lit(1)), F.lit(LIMITS["max_size"][0])))
    q = q.select("*", _branch(POINTS).alias("point_layers"), _branch(ADMIN, ADMIN_DEFAULT).alias("admin_layers"), _branch(AREAS).alias("area_layers"), _branch(COARSE).alias("coarse_layers"))
    rows = feature.select("id", "gid", "layer", "source", "category", "hier", "lon", "lat", "coarse", "country_a", "region")
    places = q.select(F.col("query_id").alias("point_id"), F.col("plon").alias("lon"), F.col("plat").alias("lat"))
    sources = F.col("sources").isNull() | (F.size("sources") == 0) | F.array_contains("sources", F.col("source"))
    country = F.col("cc").isNull() | (F.col("country_a") == F.col("cc"))
    own = F.col("use_coarse") | ~F.col("coarse")
    plain = F.col("want_gid").isNull() & F.col("categories").isNull()

    # Ever wider rings: a query that has found enough in one, or has looked as far as it may, is not asked again, so a
    # point in a city meets the places around it and not those of the whole greatest radius.
    asked, near = q, None
    for ring in sorted({min(r, most * 1000) for r in RINGS} | {most * 1000}):
        around = asked.select(F.col("query_id").alias("point_id"), F.col("plon").alias("lon"), F.col("plat").alias("lat"), "radius_m")
        close = spatial.within(around, rows.filter(F.col("layer").isin(*POINTS)), ring, max(ring / 111_000.0 / 2, 0.005)).withColumnRenamed("point_id", "query_id")
        met = close.join(rows, "id").join(asked, "query_id").filter(F.array_contains("point_layers", F.col("layer")))
        met = met.withColumn("layers", F.lit(None).cast("array<string>")).filter(sources & keep() & own & country)
        met = top(met, ["query_id"], [F.col("distance_m"), F.col("id")], F.col("lim") * 3).select("query_id", "id", "lim", "distance_m", "radius_m")
        if ring == most * 1000:
            near = met if near is None else near.unionByName(met)
            break
        met = save(met)
        done = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.first("lim").alias("lim")).filter("n >= lim * 3").select("query_id")
        done = save(done.unionByName(asked.filter(F.col("radius_m") <= ring).select("query_id")).distinct())
        found = met.join(done, "query_id", "left_semi")
        near = found if near is None else near.unionByName(found)
        asked = save(asked.join(done, "query_id", "left_anti"))
        if asked.isEmpty():
            break
    out = near.select("query_id", "id", "lim", F.lit(0).alias("grp"), F.col("distance_m").alias("ord"), G.distance_confidence(F.col("distance_m")).alias("confidence"), (F.col("distance_m") / 1000).alias("distance_km"))

    inside = spatial.containing(places, admin.select("area_id", "rings"), size).withColumnRenamed("point_id", "query_id").join(admin.select("area_id", "placetype", F.col("feature_id").alias("id")), "area_id")
    inside = inside.join(rows, "id").join(q, "query_id").filter(F.array_contains("admin_layers", F.col("placetype")) & own & country & sources)
    inside = inside.withColumn("layers", F.lit(None).cast("array<string>")).withColumn("categories", F.lit(None).cast("array<string>")).filter(keep())
    place_in_order = F.array_position(F.array(*map(F.lit, ADMIN_ORDER)), F.col("layer")).cast("double")
    out = out.unionByName(inside.select("query_id", "id", "lim", F.lit(1).alias("grp"), place_in_order.alias("ord"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("distance_km")))

    if coarse_areas is not None:
        held = spatial.containing(places, coarse_areas.select("area_id", "rings"), size).withColumnRenamed("point_id", "query_id").join(coarse_areas.select("area_id", F.col("layer").alias("area_layer"), F.col("feature_id").alias("id")), "area_id")
        held = held.join(rows, "id").join(q, "query_id").filter(F.col("use_coarse") & country & plain & sources)
        area_order = F.when(F.col("area_layer") == "region", 0.0).otherwise(1.0)
        shown = held.filter(F.array_contains("area_layers", F.col("area_layer")))
        out = out.unionByName(shown.select("query_id", "id", "lim", F.lit(3).alias("grp"), area_order.alias("ord"), F.lit(AREA_CONFIDENCE).alias("confidence"), F.lit(0.0).alias("distance_km")))
        found = held.groupBy("query_id").agg(F.min(F.when(F.col("area_layer") == "country", F.col("country_a"))).alias("in_country"), F.max(F.col("area_layer") == "region").alias("in_region"), F.min(F.when(F.col("area_layer") == "region", F.col("region"))).alias("region_name"))
        towns = spatial.within(places.join(q.select(F.col("query_id").alias("point_id"), "radius_m"), "point_id"), rows.filter(F.col("coarse") & F.col("layer").isin(*COARSE)), most * 1000, 0.5).withColumnRenamed("point_id", "query_id")
        towns = towns.join(rows, "id").join(q, "query_id").join(found, "query_id", "left")
        same_region = ~F.coalesce("in_region", F.lit(False)) | F.col("region").eqNullSafe(F.col("region_name")) | F.col("region").isNull()
        towns = towns.filter(F.col("use_coarse") & F.array_contains("coarse_layers", F.col("layer")) & sources & country & plain & same_region & (F.col("in_country").isNull() | (F.col("country_a") == F.col("in_country"))))
        towns = top(towns, ["query_id"], [F.col("distance_m"), F.col("id")], F.col("lim") * 3).filter(F.col("distance_m") <= F.col("radius_m"))
        out = out.unionByName(towns.select("query_id", "id", "lim", F.when(F.col("rank") == 1, 2).otherwise(4).alias("grp"), F.col("distance_m").alias("ord"), F.least(F.lit(TOWN_CONFIDENCE), G.distance_confidence(F.col("distance_m"))).alias("confidence"), (F.col("distance_m") / 1000).alias("distance_km")))
    return top(out, ["query_id"], [F.col("grp"), F.col("ord"), F.col("id")], F.col("lim")).select("query_id", "id", "grp", "confidence", "distance_km", "rank")


def place(ids: DataFrame, feature: DataFrame, most: int = 40) -> DataFrame:
    """Features by gid in the order asked: ``ids`` has query_id and gids (array); the first ``most`` count."""
    asked = ids.select("query_id", F.posexplode(F.slice("gids", 1, most)).alias("pos", "gid"))
    return asked.join(feature, "gid").orderBy("query_id", "pos")
