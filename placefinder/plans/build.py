"""The build: source rows to the searchable feature table and its side tables.

Expected columns of a point table (``STAGE_POINT``): rid, source, layer, source_id, name, housenumber,
street, unit, postcode, locality_hint, category (array), addendum, lon, lat, popularity. Of an admin
table: area_id, source_id, placetype, name, longname, abbr, parent_id, rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as T
from ..functions.refdata import LAYER_IMPORTANCE, OTHER_IMPORTANCE
from ..operators import conflate, spatial
from ..operators.fuzzy import top

PLACETYPES = ("neighbourhood", "locality", "localadmin", "county", "region")
#: Results kept for each short prefix, and what a worldwide place loses.
PREFIX_RESULTS, COARSE_PENALTY = 25, 0.2


def usable(points: DataFrame) -> DataFrame:
    """Points with a name and a place on Earth that is not (0, 0), which stands for missing data."""
    on_earth = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    return points.filter(on_earth & (F.coalesce("name", F.lit("")) != "") & ~((F.col("lon") == 0) & (F.col("lat") == 0)))


def staged(points: DataFrame, region: DataFrame, neighbours: DataFrame, everywhere: tuple[str, ...] = ("whosonfirst", "zcta")) -> DataFrame:
    """``points`` (rid, source, lon, lat, ...) of the build's region: those inside ``region`` (area_id, rings) or within its
    buffer and in none of ``neighbours``, and all of the sources that are cut to the region where they are read."""
    kept = spatial.clip(points.select(F.col("rid").alias("point_id"), "lon", "lat", "source"), region, neighbours, F.col("source").isin(*everywhere))
    return points.join(kept.select(F.col("point_id").alias("rid")), "rid", "left_semi")


def layer_counts(feature: DataFrame) -> DataFrame:
    """Rows of each layer, and how many of them are worldwide ones."""
    return feature.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("coarse"), 1)).alias("coarse_rows"))


def hierarchy(points: DataFrame, admin: DataFrame, regions: DataFrame, size: float | None = None) -> DataFrame:
    """For each rid the smallest area of each placetype around it, and the region: the county's parent, else the
    region area itself, else none.

    ``regions``: wof_id, name, abbr. The areas' attributes are joined after the spatial join by id alone.
    """
    area = F.aggregate(F.transform("rings", G.ring_area), F.lit(0.0), lambda s, a: s + a)
    sized = admin.withColumn("full_area", area)
    found = spatial.containing(points.select(F.col("rid").alias("point_id"), "lon", "lat"), sized, size).join(sized.drop("rings"), "area_id")
    best = lambda column, kind: F.min_by(F.when(F.col("placetype") == kind, F.col(column)), F.when(F.col("placetype") == kind, F.struct("full_area", "area_id")))
    columns = [best("name", k).alias(f"{k}_name") for k in PLACETYPES] + [best("source_id", k).alias(f"{k}_id") for k in PLACETYPES]
    columns += [best("longname", "county").alias("county_long"), best("parent_id", "county").alias("county_parent")]
    pivoted = found.groupBy(F.col("point_id").alias("rid")).agg(*columns)
    by_parent = regions.select(F.col("wof_id").alias("county_parent"), F.col("name").alias("p_name"), F.col("abbr").alias("p_abbr"))
    by_area = regions.select(F.col("wof_id").cast("string").alias("region_id"), F.col("name").alias("a_name"), F.col("abbr").alias("a_abbr"))
    joined = pivoted.join(by_parent, "county_parent", "left").withColumn("region_id", F.col("region_id").cast("string")).join(by_area, "region_id", "left")
    gid = lambda k: F.when(F.col(f"{k}_id").isNotNull(), F.concat(F.lit(f"whosonfirst:{k}:"), F.col(f"{k}_id").cast("string")))
    hier = F.map_filter(F.create_map(*(x for k in PLACETYPES for x in (F.lit(f"{k}_gid"), gid(k)))), lambda _, v: v.isNotNull())
    return joined.select(
        "rid",
        F.col("neighbourhood_name").alias("neighbourhood"),
        F.col("locality_name").alias("pip_locality"),
        F.col("localadmin_name").alias("localadmin"),
        F.coalesce("county_long", "county_name").alias("county"),
        F.coalesce("p_name", "a_name").alias("region"),
        F.coalesce("p_abbr", "a_abbr").alias("region_a"),
        hier.alias("hier"),
    )


def importance(layer: str = "layer", popularity: str = "popularity"):
    prior = F.when(F.lit(False), 0.0)
    for name, value in LAYER_IMPORTANCE.items():
        prior = prior.when(F.col(layer) == name, value)
    return F.least(F.lit(1.0), prior.otherwise(OTHER_IMPORTANCE) + F.coalesce(F.col(popularity), F.lit(0.0))).cast("float")


def label():
    """What a result is called; unknown parts are left out."""
    state = F.when(F.col("region_a").isNotNull(), F.concat(F.lit(", "), "region_a", F.lit(", USA"))).otherwise("")
    after = lambda *parts: F.coalesce(F.concat(F.lit(", "), F.coalesce(*parts)), F.lit(""))
    return (
        F.when(F.col("layer") == "region", F.concat("name", F.lit(", USA")))
        .when(F.col("layer") == "postalcode", F.concat("name", after("pip_locality", "localadmin"), state))
        .when(F.col("layer").isin("county", "locality", "localadmin"), F.concat("name", state))
        .otherwise(F.concat("name", after("pip_locality", "localadmin", "locality_hint", "county"), state))
    )


def features(points: DataFrame, hier: DataFrame, eps: float = 0.002) -> DataFrame:
    """The feature table: conflated rows with ids, labels, importance and everything that is searched.

    Ids number the rows by (layer, source, source_id), without one task that sorts them all: each range
    of the order is numbered on its own and starts after the ranges before it.
    """
    joined = points.join(hier, "rid", "left")
    town = F.coalesce("pip_locality", "localadmin", "locality_hint")
    key = F.concat(F.lower("housenumber"), F.lit("|"), T.norm(F.col("street")), F.lit("|"), F.coalesce(T.norm(town), F.lit("")))
    joined = joined.withColumn("dup_key", F.when(F.col("layer") == "address", key))
    kept = conflate.deduplicate(joined, eps)
    made = kept.select(
        F.concat_ws(":", "source", "layer", "source_id").alias("gid"), "source", "layer", "source_id", "name", "housenumber", "street", "unit", "postcode", "neighbourhood",
        F.coalesce("pip_locality", F.when(F.col("localadmin").isNull(), F.col("locality_hint"))).alias("locality"),
        "localadmin", "county", "region", "region_a", label().alias("label"), "category", "addendum", "lon", "lat", "hier", importance().alias("importance"),
        T.norm(F.col("name")).alias("name_norm"), T.norm(F.col("street")).alias("street_norm"), T.norm(town).alias("locality_norm"), T.norm(F.col("locality_hint")).alias("postal_locality_norm"),
        T.hn_int(F.col("housenumber")).alias("hn_int"),
        F.when(F.col("region_a").isNotNull(), "US").alias("country_a"), F.when(F.col("region_a").isNotNull(), "United States").alias("country"), F.lit(False).alias("coarse"),
    )
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda w: w != "")
    made = made.withColumn("tokens", F.array_distinct(F.concat(words("name_norm"), words("locality_norm"))))
    return numbered(made, ["layer", "source", "source_id", "gid"])


def numbered(rows: DataFrame, order: list[str], start: int = 1, name: str = "id") -> DataFrame:
    """``rows`` with consecutive numbers in a total order; sorted and numbered range by range."""
    from pyspark.sql import Window

    from ..operators.tables import save

    ranged = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range (a task of the sort), so this window and broadcast are small.
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (within + F.col("_before") + (start - 1)).cast("long")).drop("_range", "_before")


def add_worldwide(feature: DataFrame, coarse: DataFrame) -> DataFrame:
    """``feature`` with the worldwide rows whose gid it does not hold yet, numbered after its own."""
    new = coarse.join(feature.select("gid"), "gid", "left_anti")
    last = feature.agg(F.max("id")).first()[0] or 0
    return feature.unionByName(numbered(new.withColumn("coarse", F.lit(True)), ["layer", "source", "source_id", "gid"], last + 1), allowMissingColumns=True)


def street_names(feature: DataFrame) -> DataFrame:
    """Distinct (street_norm, town) with a spelling of each and the number of addresses; both of a row's towns count."""
    streets = feature.filter("street_norm IS NOT NULL AND street_norm <> ''")
    own = streets.select("street_norm", F.coalesce("locality_norm", F.lit("")).alias("town"), "street", F.coalesce("locality", "localadmin").alias("town_name"), "layer")
    postal = streets.filter("postal_locality_norm IS NOT NULL AND postal_locality_norm <> coalesce(locality_norm, '')")
    postal = postal.select("street_norm", F.col("postal_locality_norm").alias("town"), "street", F.col("postal_locality_norm").alias("town_name"), "layer")
    counted = F.count(F.when(F.col("layer") == "address", 1)).alias("n_addresses")
    return own.unionByName(postal).groupBy("street_norm", F.col("town").alias("locality_norm")).agg(F.min("street").alias("street"), F.min("town_name").alias("locality"), counted)


def towns(feature: DataFrame) -> DataFrame:
    return feature.filter(F.col("layer").isin("locality", "localadmin")).select(F.lower("name").alias("name"), "region_a", "coarse").distinct()


def prefix_table(feature: DataFrame, longest: int = 3, most: int = PREFIX_RESULTS) -> DataFrame:
    """The best features of every prefix of one to three characters: prefix, rank, feature_id.

    A prefix such as "s" may hold a fifth of all rows, so rows are first cut to the best of each prefix
    and shard, and these to the best of each prefix.
    """
    rows = feature.filter("layer <> 'address' AND length(name_norm) >= 1")
    value = F.col("importance").cast("double") - F.when(F.col("coarse"), COARSE_PENALTY).otherwise(0.0)
    listed = rows.select(F.col("id").alias("feature_id"), value.alias("value"), F.length("name_norm").alias("size"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substring("name_norm", F.lit(1), n)))).alias("prefix"))
    order = [F.desc("value"), F.col("size"), F.col("feature_id")]
    sharded = top(listed.withColumn("shard", F.pmod(F.xxhash64("feature_id"), F.lit(64))), ["prefix", "shard"], order, most).drop("rank")
    return top(sharded, ["prefix"], order, most).select("prefix", F.col("rank").cast("short").alias("rank"), "feature_id")
