"""Readers of the source files, each to the point or admin columns of the build.

Files that Spark can't read by itself (OSM extracts, SQLite, shapefiles) are accepted as tables that
were extracted before, with the same columns.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.conflate import argmax_share, exclusive_prefixes, first_of
from ..operators.spatial import merged_lines

POINT = ("source", "layer", "source_id", "name", "housenumber", "street", "unit", "postcode", "locality_hint", "category", "addendum", "lon", "lat", "popularity")
_TYPES = {"category": "array<string>", "lon": "double", "lat": "double", "popularity": "double"}


def as_points(df: DataFrame, **columns: Column) -> DataFrame:
    """The point columns, null where neither given nor present."""
    have = set(df.columns)
    pick = lambda c: columns[c] if c in columns else F.col(c) if c in have else F.lit(None)
    return df.select(*(pick(c).cast(_TYPES.get(c, "string")).alias(c) for c in POINT))


def _first_lines(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by their first line that isn't blank, as far as which alone each is read, without a job; compressed ones too."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[str, list[str]] = {}
    for name in files:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream, codec = at.getFileSystem(conf).open(at), codecs.getCodec(at)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        found.setdefault(line or "", []).append(name)
        lines.close()
    return found


def text_csv(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', **options) -> DataFrame:
    """Every column as text; files whose headers (their first lines) differ are united by name. Files without a line are
    left out."""
    reader = spark.read.options(header=True, sep=sep, quote=quote, escape=quote or "", recursiveFileLookup=True, **options)
    files = [r.file for r in spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(path).select(F.col("path").alias("file")).collect()]
    headers = _first_lines(spark, files)
    headers.pop("", None)
    out = None
    for same in headers.values():
        part = reader.csv(same)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    return out


def openaddresses(df: DataFrame) -> DataFrame:
    """OpenAddresses rows with a number, street and hash; one row for each hash."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    kept = df.filter(filled("NUMBER") & filled("STREET") & filled("HASH"))
    kept = first_of(kept, ["HASH"], [F.col(c).asc_nulls_last() for c in ("NUMBER", "STREET", "LON", "LAT")])
    number = F.regexp_replace(F.trim("NUMBER"), "^0+([0-9])", "$1")
    return as_points(
        kept, source=F.lit("openaddresses"), layer=F.lit("address"), source_id=F.col("HASH"), name=F.concat_ws(" ", number, F.trim("STREET")), housenumber=number, street=F.trim("STREET"),
        unit=F.nullif(F.trim("UNIT"), F.lit("")), postcode=F.nullif(F.trim("POSTCODE"), F.lit("")), locality_hint=F.nullif(F.trim("CITY"), F.lit("")), lon=F.col("LON"), lat=F.col("LAT"),
    )


NDJSON = T.StructType().add("geometry", T.StructType().add("type", "string").add("coordinates", T.ArrayType(T.DoubleType()))).add("properties", T.StructType([T.StructField(c, T.StringType()) for c in ("number", "street", "unit", "city", "district", "region", "postcode", "id", "hash")]))


def openaddresses_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited features with a declared schema, as the columns of the CSV form."""
    rows = spark.read.schema(NDJSON).json(path)
    return rows.select(F.get("geometry.coordinates", F.lit(0)).cast("string").alias("LON"), F.get("geometry.coordinates", F.lit(1)).cast("string").alias("LAT"), *(F.col(f"properties.{c}").alias(c.upper()) for c in ("number", "street", "unit", "city", "district", "region", "postcode", "id", "hash")))


def prepared(df: DataFrame, source: str) -> DataFrame:
    """A prepared CSV whose optional columns may be missing; popularity is a tenth of the confidence for places."""
    popularity = {"popularity": 0.1 * F.col("confidence").cast("double")} if source == "overture" and "confidence" in df.columns else {}
    category = {"category": F.split(F.nullif(F.col("category"), F.lit("")), r"\|")} if "category" in df.columns else {}
    return as_points(df, source=F.lit(source), **popularity, **category)


def gnis(df: DataFrame, box: tuple[float, float, float, float], include_historical: bool = False) -> DataFrame:
    """Named features inside one state's box (min lon, min lat, max lon, max lat); class as category."""
    lon, lat = F.col("prim_long_dec").cast("double"), F.col("prim_lat_dec").cast("double")
    rows = df.filter(lon.between(box[0], box[2]) & lat.between(box[1], box[3]))
    if not include_historical:
        rows = rows.filter(~F.col("feature_name").ilike("%(historical)%"))
    rows = first_of(rows, ["feature_id"], [F.col("feature_name"), F.col("state_name").asc_nulls_last()])
    category = F.array(F.replace(F.lower("feature_class"), F.lit(" "), F.lit("_")))
    return as_points(rows, source=F.lit("gnis"), layer=F.lit("venue"), source_id=F.col("feature_id"), name=F.col("feature_name"), category=category, lon=lon, lat=lat)


def zcta_states(relationship: DataFrame) -> DataFrame:
    """The state with most of each ZCTA's land: zcta, state (FIPS), land."""
    rows = relationship.filter("GEOID_ZCTA5_20 IS NOT NULL AND GEOID_ZCTA5_20 <> ''").select(F.col("GEOID_ZCTA5_20").alias("zcta"), F.substring("GEOID_COUNTY_20", 1, 2).alias("state"), F.col("AREALAND_PART").cast("decimal(38,0)").alias("land"))
    return argmax_share(rows, "zcta", "state", "land")


def zcta(gazetteer: DataFrame, states: DataFrame, wanted: list[str]) -> DataFrame:
    """ZCTAs of the wanted states as postcode points."""
    own = states.filter(F.col("state").isin(*wanted)).select(F.col("zcta").alias("GEOID"))
    rows = gazetteer.join(own, "GEOID", "left_semi")
    return as_points(rows, source=F.lit("zcta"), layer=F.lit("postalcode"), source_id=F.col("GEOID"), name=F.col("GEOID"), postcode=F.col("GEOID"), lon=F.trim("INTPTLONG"), lat=F.trim("INTPTLAT"))


def zip_prefixes(states: DataFrame, wanted: list[str]) -> DataFrame:
    """Three-digit prefixes all of whose ZCTAs are in the wanted states."""
    return exclusive_prefixes(states.withColumn("inside", F.col("state").isin(*wanted)), "zcta", "inside")


def overture_places(places: DataFrame, prefixes: DataFrame, region: str, in_region: Column, near_region: Column, least: float = 0.5) -> DataFrame:
    """Open places inside the region, or at its edge with evidence in their address (its state, or a postcode of its
    own prefixes). Numbers lead the free-form address; foreign postcodes are dropped."""
    a = F.get("addresses", F.lit(0))
    zip5 = F.substring(a["postcode"], 1, 5)
    rows = places.filter((F.col("confidence") >= least) & (F.coalesce("operating_status", F.lit("open")) == "open") & F.col("names.primary").isNotNull())
    rows = rows.withColumn("zip5", zip5).join(F.broadcast(prefixes.select(F.col("prefix").alias("own_prefix"))), F.substring("zip5", 1, 3) == F.col("own_prefix"), "left")
    evidence = F.coalesce(a["region"] == region, F.lit(False)) | F.col("own_prefix").isNotNull()
    rows = rows.filter(in_region | (near_region & evidence))
    shape = r"^\s*(\d+[A-Za-z]?)\s+(.+)$"
    number = F.nullif(F.regexp_extract(a["freeform"], shape, 1), F.lit(""))
    street = F.nullif(F.regexp_extract(a["freeform"], shape, 2), F.lit(""))
    lon, lat = (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2
    return as_points(rows, source=F.lit("overture"), layer=F.lit("venue"), source_id=F.col("id"), name=F.col("names.primary"), housenumber=number, street=street, postcode=F.when(F.col("own_prefix").isNotNull(), F.col("zip5")), locality_hint=a["locality"], category=F.array(F.col("basic_category")), lon=lon, lat=lat, popularity=0.1 * F.col("confidence"))


def divisions(rows: DataFrame, countries: DataFrame, regions: DataFrame, own_country: str, own_states: list[str]) -> DataFrame:
    """Worldwide countries, regions, counties and towns as coarse features, without the build's own states.

    ``countries``: country, country_name; ``regions``: region_code, region_name. A local name that differs
    from the English one is a row of its own.
    """
    layer = F.when(F.col("subtype").isin("country", "dependency"), "country").when(F.col("subtype") == "region", "region").when(F.col("subtype") == "county", "county").otherwise("locality")
    outside = (F.col("country") != own_country) | F.col("region").isNull() | ~F.substring_index("region", "-", -1).isin(*own_states)
    named = rows.filter(outside).withColumn("layer", layer).join(countries, "country", "left").join(regions, F.col("region") == F.col("region_code"), "left")
    english = F.coalesce("name_en", "name_primary")
    us = F.col("country") == "US"
    state = F.when(us, F.substring_index("region", "-", -1))
    after = lambda c: F.when(c.isNotNull() & (c != english), F.concat(F.lit(", "), c)).otherwise("")
    label = F.when(F.col("layer") == "country", english).when(us, F.concat(english, F.when((F.col("layer") != "region") & state.isNotNull(), F.concat(F.lit(", "), state)).otherwise(""), F.lit(", USA"))).otherwise(F.concat(english, F.when(F.col("layer") == "region", "").otherwise(after(F.col("region_name"))), after(F.col("country_name"))))
    town = F.lit(0.35) + F.least(F.lit(0.15), 0.03 * F.log(1 + F.coalesce("population", F.lit(0)) / 1000.0))
    importance = F.when(F.col("layer").isin("country", "region"), 0.9).when(F.col("layer") == "county", 0.4).otherwise(town)
    base = named.select(F.lit("overture").alias("source"), "layer", F.col("id").alias("source_id"), english.alias("name"), label.alias("label"), "lon", "lat", F.col("country").alias("country_a"), F.col("country_name").alias("country"), F.col("region_name").alias("region"), state.alias("region_a"), importance.cast("float").alias("importance"), "name_primary")
    alias = base.filter("name_primary <> name").withColumn("name", F.col("name_primary")).withColumn("source_id", F.concat("source_id", F.lit("#alt")))
    return base.unionByName(alias).drop("name_primary").withColumn("gid", F.concat_ws(":", "source", "layer", "source_id")).withColumn("coarse", F.lit(True))


def division_names(rows: DataFrame, by: str, first: Column) -> DataFrame:
    """One name for each value of ``by`` (a country or region code): the English one where there is one, of the row that
    comes first by ``first`` and then by id."""
    named = rows.filter(F.col(by).isNotNull()).withColumn("name", F.coalesce(F.nullif(F.col("name_en"), F.lit("")), "name_primary"))
    return first_of(named, [by], [first, F.col("id")]).select(by, "name")


def country_names(rows: DataFrame) -> DataFrame:
    """country, name: a country's own row before a dependency's."""
    return division_names(rows.filter(F.col("subtype").isin("country", "dependency")), "country", F.when(F.col("subtype") == "country", 0).otherwise(1))


def region_names(rows: DataFrame) -> DataFrame:
    """region, name."""
    return division_names(rows.filter("subtype = 'region'"), "region", F.lit(0))


def division_areas(rows: DataFrame) -> DataFrame:
    """One polygon for each division (id, division_id, subtype, class, is_territorial, rings): land before sea, then those
    that are not territorial waters, then the smallest id; dependencies count as countries."""
    sea = F.when(F.col("class") == "land", 0).otherwise(1)
    kept = first_of(rows, ["division_id"], [sea, F.coalesce("is_territorial", F.lit(False)), F.col("id")])
    return kept.select(F.col("division_id").alias("source_id"), F.when(F.col("subtype") == "dependency", "country").otherwise(F.col("subtype")).alias("layer"), "rings")


def geojson_areas(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """Polygons of a GeoJSON FeatureCollection: area_id, rings."""
    point = T.ArrayType(T.DoubleType())
    shape = "struct<type:string,coordinates:string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features:array<struct<properties:map<string,string>,geometry:{shape}>>>")["features"]).alias("f"))
    one = F.from_json("f.geometry.coordinates", T.ArrayType(T.ArrayType(point)))
    many = F.flatten(F.from_json("f.geometry.coordinates", T.ArrayType(T.ArrayType(T.ArrayType(point)))))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    return rows.select(F.col("f.properties")[id_property].alias("area_id"), F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def admin_table(spr: DataFrame, geometries: DataFrame, ancestors: DataFrame, regions: list[int]) -> DataFrame:
    """Current admin areas that descend from ``regions``, with their polygons: the joins of the gazetteer's three tables."""
    below = ancestors.filter(F.col("ancestor_id").isin(*regions)).select("id").unionByName(spr.filter(F.col("id").isin(*regions)).select("id")).distinct()
    current = spr.filter("is_current <> 0 AND coalesce(is_deprecated, 0) <> 1")
    return current.join(below, "id", "left_semi").join(geometries, "id").select(F.col("id").alias("area_id"), F.col("id").cast("string").alias("source_id"), "placetype", "name", "parent_id", "rings", F.coalesce("label_lon", "longitude").alias("lon"), F.coalesce("label_lat", "latitude").alias("lat"))


#: Tags that make an OSM feature a venue, with the values that count (None: any), in the order of its categories.
VENUE_TAGS: dict[str, tuple[str, ...] | None] = {
    "amenity": None, "shop": None, "tourism": None, "leisure": None, "office": None, "craft": None, "historic": None, "healthcare": None,
    "natural": ("peak", "bay", "beach", "cape", "water", "island", "wood"), "aeroway": ("aerodrome", "terminal"), "railway": ("station", "halt"), "public_transport": ("station",), "sport": None,
}
#: Kinds of highway that are streets.
ROADS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street", "pedestrian",
    "road", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "track",
)
#: Degrees within which roads of one name are one street.
STREET_GAP = 0.003


def _osm(df: DataFrame, source_id: Column) -> DataFrame:
    """Venues and addresses of an extracted OSM table with a point (lon, lat) for each feature."""
    held = set(df.columns)
    tag = lambda c: F.nullif(F.col(c), F.lit("")) if c in held else F.lit(None).cast("string")
    kinds = [F.when(tag(t).isNotNull() if values is None else tag(t).isin(*values), F.concat(F.lit(f"{t}="), tag(t))) for t, values in VENUE_TAGS.items()]
    rows = df.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_cat", F.array_compact(F.array(*kinds)))
    much = (tag("aeroway") == "aerodrome") | tag("amenity").isin("hospital", "university", "college") | tag("tourism").isin("attraction", "museum")
    popularity = F.when(much, 0.2).when(tag("amenity").isNotNull() | tag("tourism").isNotNull(), 0.05).otherwise(0.0)
    bare = {c: F.lit(None) for c in POINT if c not in ("lon", "lat")} | {"source": F.lit("openstreetmap"), "source_id": source_id}
    venues = as_points(rows.filter(tag("name").isNotNull() & (F.size("_cat") > 0)), **bare | {"layer": F.lit("venue"), "name": tag("name"), "category": F.col("_cat"), "popularity": popularity})
    number, street = tag("addr_housenumber"), tag("addr_street")
    homes = as_points(rows.filter(number.isNotNull() & street.isNotNull()), **bare | {"layer": F.lit("address"), "name": F.concat_ws(" ", number, street), "housenumber": number, "street": street, "postcode": tag("addr_postcode"), "locality_hint": tag("addr_city")})
    return venues.unionByName(homes)


def osm_points(df: DataFrame) -> DataFrame:
    """Venues and addresses of an extracted OSM point table (osm_id, lon, lat, name, tags, addr_...)."""
    return _osm(df, F.concat(F.lit("node/"), F.col("osm_id")))


def osm_polygons(df: DataFrame) -> DataFrame:
    """Venues and addresses of an extracted OSM multipolygon table: osm_way_id of ways, osm_id of relations; lon and lat
    are a point on the surface, from the extraction."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return _osm(df, F.coalesce(F.concat(F.lit("way/"), filled("osm_way_id")), F.concat(F.lit("relation/"), filled("osm_id"))))


def osm_lines(df: DataFrame) -> DataFrame:
    """Streets of an extracted OSM line table (osm_id, name, highway, line: array of struct(x, y)).

    Roads of one name that lie within ``STREET_GAP`` of each other, also through others, are one street; its
    point is the one on its roads that is nearest their centroid, its id the smallest of theirs.
    """
    roads = df.filter((F.coalesce("name", F.lit("")) != "") & F.col("highway").isin(*ROADS) & (F.size("line") > 1))
    made = merged_lines(roads.select(F.col("osm_id").cast("string").alias("id"), "name", "line"), "name", STREET_GAP)
    bare = {c: F.lit(None) for c in POINT if c not in ("name", "lon", "lat")}
    return as_points(made, **bare | {"source": F.lit("openstreetmap"), "layer": F.lit("street"), "source_id": F.concat(F.lit("way/"), F.col("id")), "street": F.col("name")})


def detect_delimiter(text: str) -> str:
    """The most frequent of , | tab ; outside quotes on the first line that isn't blank; a comma if none leads."""
    line = next((x for x in text.splitlines() if x.strip()), "")
    counts: Counter = Counter()
    quoted = False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in ",|\t;":
            counts[c] += 1
    return max(",|\t;", key=lambda c: (counts[c], c == ","))


#: Header words of an upload, without blanks and marks, and the role each has.
ROLES = {
    "lat": ("lat", "latitude", "y"), "lon": ("lon", "lng", "long", "longitude", "x"), "address": ("address", "addressline1", "address1", "streetaddress", "street", "addr"),
    "city": ("city", "town", "locality", "municipality"), "state": ("state", "st", "statecode", "region", "province"), "zip": ("zip", "zipcode", "postalcode", "postcode", "postal"), "query": ("query", "q", "text", "search", "name"),
}
#: Words that begin a unit at an address's end, where a number, a letter or nothing follows ("Building St"
#: is no unit); what comes after goes too.
UNIT_WORDS = ("suite", "ste", "unit", "apt", "apartment", "floor", "fl", "room", "rm", "bldg", "building")
#: What a record may claim by the layer that answered it, and what is left of it in another state.
LAYER_CAP = {"street": 0.6, "postalcode": 0.5, "neighbourhood": 0.5, "locality": 0.45, "localadmin": 0.45, "county": 0.3, "region": 0.2, "country": 0.1}
OTHER_STATE = 0.6


def roles(header: list[str]) -> dict[str, str]:
    """Role -> column of an upload's header."""
    found: dict[str, str] = {}
    for column in header:
        plain = "".join(c for c in column.lower() if c.isalnum())
        for role, names in ROLES.items():
            if plain in names:
                found.setdefault(role, column)
    return found


def batch_jobs(df: DataFrame) -> DataFrame:
    """Rows of an upload (with row_id) as queries: ``text`` or lon and lat, or ``skip`` with the reason.

    Unit tails are cut, city, state and ZIP are added where the address doesn't name them already, and post
    office boxes can't be placed.
    """
    role = roles(df.columns)
    col = lambda r: F.trim(F.coalesce(F.col(role[r]), F.lit(""))) if r in role else F.lit("")
    unit = rf"[,\s]+(?:{'|'.join(UNIT_WORDS)})\b\.?\s*(?:#?\s*(?:[\w-]*\d|[a-z]\b)|$)"
    tail = rf"(?is)(?:{unit}|\s+#\s*[\w-]).*$"
    street = F.trim(F.regexp_replace(F.regexp_replace(col("address"), tail, ""), r"[,\s]+$", ""))
    names = lambda part, whole: F.concat(F.lit(" "), F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(part), F.lit(" ")))
    extra = [F.when((col(r) != "") & ~names(col(r), street), col(r)) for r in ("city", "state", "zip")]
    joined = F.concat_ws(", ", F.nullif(street, F.lit("")), *extra)
    text = F.when(col("query") != "", col("query")).otherwise(joined)
    point = F.expr(f"try_cast(`{role['lon']}` AS double)").alias("lon") if "lon" in role else F.lit(None).cast("double").alias("lon"), F.expr(f"try_cast(`{role['lat']}` AS double)").alias("lat") if "lat" in role else F.lit(None).cast("double").alias("lat")
    rows = df.select("row_id", text.alias("text"), *point)
    here = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    box = F.col("text").rlike(r"(?i)\bp\.?\s*o\.?\s*box\b")
    skip = F.when(F.coalesce(here, F.lit(False)), None).when(box, "post office box").when(F.col("text") == "", "nothing to look up")
    return rows.select("row_id", F.when(F.coalesce(here, F.lit(False)), None).otherwise(F.nullif(F.col("text"), F.lit(""))).alias("text"), "lon", "lat", skip.alias("skip"))


def batch_results(jobs: DataFrame, hits: DataFrame) -> DataFrame:
    """row_id, the first hit's columns, confidence and ``note`` for each job (row_id, skip, state: null or the abbreviation
    that its row names) from ``hits`` (row_id, rank, layer, confidence, region_a, country_a, ...).

    A town that answers for a building is a poor answer however well it fits its name, so the confidence is
    capped by the answering layer; an answer in another state than the row's keeps ``OTHER_STATE`` of it.
    """
    best = hits.filter("rank = 1").drop("rank").withColumnRenamed("confidence", "claimed")
    cap = F.create_map(*(F.lit(x) for pair in LAYER_CAP.items() for x in pair))[F.col("layer")]
    rows = jobs.select("row_id", "skip", "state").join(best, "row_id", "left")
    # least() skips nulls, so a job without a hit would get the cap itself
    level = F.when(F.col("layer").isNotNull(), F.least(F.col("claimed").cast("double"), F.coalesce(cap, F.lit(1.0))))
    elsewhere = F.col("layer").isNotNull() & F.col("state").isNotNull() & ~F.col("region_a").eqNullSafe(F.col("state"))
    confidence = F.when(elsewhere, F.round(level * OTHER_STATE, 3)).otherwise(level)
    note = (
        F.when(F.col("skip").isNotNull(), F.col("skip"))
        .when(F.col("layer").isNull(), "no match")
        .when(elsewhere, F.concat(F.lit("state differs: found in "), F.coalesce("region_a", "country_a", F.lit("another place"))))
        .when(level < F.col("claimed").cast("double"), F.concat(F.lit("matched at "), "layer", F.lit(" level")))
    )
    return rows.withColumn("confidence", confidence).withColumn("note", note).drop("claimed", "skip")
