"""Search over a table of parsed queries.

``queries``: query_id, text, name, housenumber, street, locality, postcode, state, and optionally
focus_lon, focus_lat, layers, sources, rect (min lon, min lat, max lon, max lat), circle (lon, lat,
metres), gid, categories, country, coarse, size. Every stage is keyed by query_id; every cut is a
row_number with the feature id as the last tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as T
from ..functions.refdata import LIMITS, STATES
from ..operators.fuzzy import similarity_join, top
from ..operators.neighbours import number_neighbours
from ..operators.postings import Stored
from ..operators.tables import save, spread
from .filters import area_filter, keep, with_defaults

# Candidate cuts and thresholds.
STREETS, STREET_NAMES, INTERPOLATED, NAMES, EXACT_NAMES, TOWNS, TOWN_POINTS = 25, 3, 3, 60, 40, 2, 5
SIMILAR, GOOD_STREET, LEAST_CONFIDENCE, INTERPOLATE_M = 0.3, 0.6, 0.3, 1500.0
ADMIN_ANSWERS = ("locality", "localadmin", "county", "region", "postalcode")


def state_code(state: Column) -> Column:
    """The abbreviation of a state given by abbreviation or name; null if it is none."""
    table = F.create_map(*(F.lit(x) for abbr, name, _ in STATES for x in (abbr, abbr, name.upper(), abbr) if x))
    return table[F.upper(F.trim(state))]


def prepared(queries: DataFrame, held: list[tuple[str, str]]) -> DataFrame:
    """Queries with canonical forms, intent, limits and the texts to match names with."""
    q = with_defaults(queries)
    blank = lambda c: F.nullif(c, F.lit(""))
    q = q.select(
        "*",
        T.strip_trailing_state(T.norm(F.coalesce("text", F.lit(""))), held).alias("qf"),
        blank(T.norm(F.col("name"))).alias("qn"),
        blank(T.norm(F.col("street"))).alias("st"),
        blank(T.norm(F.col("locality"))).alias("loc"),
        blank(T.hn_norm(F.col("housenumber"))).alias("hn"),
        T.hn_int(F.col("housenumber")).alias("hni"),
        blank(F.regexp_extract("postcode", r"\d{5}", 0)).alias("pc"),
        state_code(F.col("state")).alias("stt"),
        F.least(F.greatest(F.coalesce("size", F.lit(10)), F.lit(1)), F.lit(LIMITS["max_size"][0])).alias("lim"),
    ).withColumn("addr_intent", F.col("hn").isNotNull() & F.col("st").isNotNull())
    town_only = ~F.col("addr_intent") & F.col("st").isNull() & F.col("hn").isNull() & F.col("qn").isNull()
    targets = F.array(F.col("qn"), F.when(~F.col("addr_intent"), F.col("qf")), F.when(town_only, F.col("loc")))
    return q.withColumn("targets", F.array_distinct(F.filter(targets, lambda t: t.isNotNull() & (t != ""))))


def _scan(q: str = "", f: str = "") -> Column:
    """Filters that hold inside the candidate scans: the pass's state, worldwide rows, country."""
    return (
        (F.col("only_state").isNull() | F.col("region_a").eqNullSafe(F.col("only_state")))
        & (F.col("use_coarse") | ~F.col("coarse"))
        & (F.col("cc").isNull() | (F.col("country_a") == F.col("cc")))
    )


def _foreign(column: str = "region_a") -> Column:
    """Orders rows of the named state first."""
    return F.col("stt").isNotNull() & ~F.col(column).eqNullSafe(F.col("stt"))


def _choosy() -> Column:
    """Whether a query may tell apart addresses that differ in nothing but their place, hierarchy and categories."""
    return (F.col("focus_lon").isNotNull() & F.col("focus_lat").isNotNull()) | F.col("rect").isNotNull() | F.col("circle").isNotNull() | F.col("gid").isNotNull() | F.col("categories").isNotNull()


def _namesakes(asked: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` that a target is equal or similar to, for anchored and other queries. Without an anchor namesakes are taken
    in order of their ids, so of those that the scan filters treat alike the first ``NAMES`` are all that any query can keep."""
    targets = asked.select("target", "anchored").distinct()
    wanted = save(targets.join(pairs, "target").select("name_norm", "anchored").union(targets).distinct())
    rows = names.select("name_norm", "id", "region_a", "coarse", "country_a", "lon", "lat")
    first = top(rows.join(wanted.filter("NOT anchored"), "name_norm"), ["name_norm", "region_a", "coarse", "country_a"], [F.col("id")], max(NAMES, EXACT_NAMES)).drop("rank")
    return first.unionByName(rows.join(wanted.filter("anchored"), "name_norm"))


def _numbered(feature: DataFrame, streets: DataFrame) -> DataFrame:
    """Addresses with a street and number that is asked for: all of them for choosy queries. For others, addresses alike
    in everything that a filter, the score and the label read would end as one hit, that of the smallest id, so it stands for them."""
    wanted = streets.select("street_norm", F.col("hni").alias("hn_int"), "choosy").filter("hn_int IS NOT NULL").distinct()
    rows = feature.filter("layer = 'address'").join(wanted, ["street_norm", "hn_int"])
    alike = ["choosy", "street_norm", "hn_int", "housenumber", "locality_norm", "postal_locality_norm", "region_a", "country_a", "coarse", "postcode", "source", "importance", "label", "name_norm"]
    one = rows.filter("NOT choosy").groupBy(*alike).agg(F.min("id").alias("id")).unionByName(rows.filter("choosy").select(*alike, "id"))
    return one.select("id", "choosy", "street_norm", F.col("hn_int").alias("hni"), F.col("housenumber").alias("number"), F.col("locality_norm").alias("town"), F.col("postal_locality_norm").alias("postal"), "region_a")


def search_core(queries: DataFrame, feature: DataFrame, street_name: DataFrame, stored: Stored | None = None) -> DataFrame:
    """Hits of prepared queries (with only_state set): query_id, id, layer, label, confidence, match_type,
    accuracy, distance_km, score, rank, and for interpolated hits their number and place."""
    narrow = feature.select("id", "layer", "name_norm", "region_a", "coarse", "country_a", "lon", "lat", "importance", "postcode", "gid")
    scope = queries.select("query_id", "only_state", "use_coarse", "cc", "stt")

    # the queried town's places, and the point that breaks ties between namesakes
    town_rows = queries.filter("loc IS NOT NULL").select("query_id", F.col("loc").alias("name_norm"), "only_state", "use_coarse", "cc", "stt")
    town_hits = town_rows.join(narrow.filter(F.col("layer").isin("locality", "localadmin", "neighbourhood")), "name_norm").filter(_scan())
    town_points = save(top(town_hits, ["query_id"], [_foreign(), F.desc("importance"), F.col("id")], TOWN_POINTS).groupBy("query_id").agg(F.collect_list(F.struct("lon", "lat")).alias("town_points")))
    by_gid = queries.filter("gid IS NOT NULL").select("query_id", "gid").join(feature.select("gid", F.col("lon").alias("glon"), F.col("lat").alias("glat")), "gid").groupBy("query_id").agg(F.min(F.struct("glon", "glat")).alias("g"))
    placed = queries.join(town_points, "query_id", "left").join(by_gid, "query_id", "left")
    anchor = F.coalesce(
        F.when(F.col("focus_lon").isNotNull() & F.col("focus_lat").isNotNull(), F.array(F.struct(F.col("focus_lon").alias("lon"), F.col("focus_lat").alias("lat")))),
        F.when(F.col("circle").isNotNull(), F.array(F.struct(F.get("circle", F.lit(0)).alias("lon"), F.get("circle", F.lit(1)).alias("lat")))),
        F.when(F.col("rect").isNotNull(), F.array(F.struct(((F.get("rect", F.lit(0)) + F.get("rect", F.lit(2))) / 2).alias("lon"), ((F.get("rect", F.lit(1)) + F.get("rect", F.lit(3))) / 2).alias("lat")))),
        F.when(F.col("g").isNotNull(), F.array(F.struct(F.col("g.glon").alias("lon"), F.col("g.glat").alias("lat")))),
        F.col("town_points"),
    )
    placed = save(placed.withColumn("anchor", anchor).drop("g"))
    from_anchor = F.coalesce(F.array_min(F.transform("anchor", lambda a: F.hypot(a["lon"] - F.col("lon"), a["lat"] - F.col("lat")))), F.lit(0.0))

    # names: similar, and equal
    asked = placed.select("query_id", "anchor", F.col("anchor").isNotNull().alias("anchored"), "only_state", "use_coarse", "cc", "stt", F.explode("targets").alias("target"))
    names = narrow.filter("layer <> 'address' AND name_norm IS NOT NULL AND name_norm <> ''")
    targets = asked.select("target").distinct()
    if stored is None:
        # saved, as the join would else make trigrams of every row instead of every name
        pairs = similarity_join(targets, save(names.select("name_norm").distinct()), SIMILAR, "target", "target", "name_norm", "name_norm")
    else:
        pairs = stored.similar(targets, SIMILAR, "target")
    pairs = save(pairs)
    namesakes = save(_namesakes(asked, pairs, names))
    near = asked.join(pairs, "target").join(namesakes, ["name_norm", "anchored"]).filter(_scan())
    near = top(near, ["query_id", "target"], [F.desc("sim"), F.col("coarse"), from_anchor, F.col("id")], NAMES)
    near = save(near.select("query_id", "target", "name_norm", "id", "sim"))
    # once for each distinct pair of texts, on columns of trigrams
    texts = spread(near.select("target", "name_norm", "sim").distinct()).withColumn("tg", T.trigrams(F.col("target"))).withColumn("ng", T.ordered_trigrams(F.col("name_norm")))
    nsim = F.greatest(F.col("sim"), F.lit(0.9) * T.word_similarity(F.col("tg"), F.col("ng"))) + F.lit(0.1) * F.col("sim")
    texts = texts.select("target", "name_norm", nsim.alias("nsim"))
    similar = near.join(texts, ["target", "name_norm"]).groupBy("query_id", "id").agg(F.max("nsim").alias("nsim"))
    equal = asked.withColumnRenamed("target", "name_norm").join(namesakes, ["name_norm", "anchored"]).filter(_scan()).dropDuplicates(["query_id", "id"])
    equal = top(equal, ["query_id"], [_foreign(), F.col("coarse"), from_anchor, F.col("id")], EXACT_NAMES).select("query_id", "id", F.lit(1.0).alias("nsim"))
    named = save(similar.unionByName(equal))

    # streets and addresses
    home = queries.filter(F.col("addr_intent") & (F.col("cc").isNull() | (F.col("cc") == "US"))).select("query_id", "st", "loc", F.coalesce("loc", F.lit("")).alias("loc_key"), "hn", "hni", "only_state", _choosy().alias("choosy"))
    street_pairs = similarity_join(home.select("st").distinct(), street_name.select("street_norm").distinct(), SIMILAR, "st", "st", "street_norm", "street_norm").withColumnRenamed("sim", "st_sim")
    # which streets come first depends on the street and town asked for alone
    ranked = home.select("st", "loc_key").distinct().join(street_pairs, "st").join(street_name.select("street_norm", "locality_norm"), "street_norm")
    ranked = ranked.withColumn("loc_sim", F.when(F.col("loc_key") != "", T.similarity(F.col("locality_norm"), F.col("loc_key"))))
    ranked = save(top(ranked, ["st", "loc_key"], [F.desc(F.col("st_sim") + F.coalesce("loc_sim", F.lit(0.0))), F.col("street_norm"), F.col("locality_norm")], STREETS).drop("rank"))
    best = ranked.groupBy("st", "loc_key", "street_norm").agg(F.max("st_sim").alias("st_sim"))
    best = save(top(best, ["st", "loc_key"], [F.desc("st_sim"), F.col("street_norm")], STREET_NAMES).drop("rank"))
    streets = save(home.join(ranked, ["st", "loc_key"]).drop("loc_key"))
    address = feature.filter("layer = 'address'").select("id", "street_norm", F.col("locality_norm").alias("town"), F.col("postal_locality_norm").alias("postal"), "hn_int", F.col("housenumber").alias("number"), "region_a", "lon", "lat")
    in_state = F.col("only_state").isNull() | F.col("region_a").eqNullSafe(F.col("only_state"))
    numbered = save(_numbered(feature, streets))
    # A best street's addresses are taken in any town, so only the other streets' need theirs: two equi-joins instead of
    # an OR, the row's own town and its postal town.
    rest = home.join(ranked.join(best, ["st", "loc_key", "street_norm"], "left_anti"), ["st", "loc_key"])
    at = ["street_norm", "hni", "choosy"]
    own = rest.join(numbered.withColumn("locality_norm", F.col("town")), [*at, "locality_norm"])
    postal = rest.join(numbered.withColumn("locality_norm", F.col("postal")), [*at, "locality_norm"])
    anywhere = home.join(best, ["st", "loc_key"]).join(numbered, at).withColumn("loc_sim", F.lit(None).cast("double"))
    there = own.drop("locality_norm").unionByName(postal.drop("locality_norm")).unionByName(anywhere)
    there = save(there.filter((T.hn_norm(F.col("number")) == F.col("hn")) & in_state).select("query_id", "id", "st_sim", "loc", "loc_sim", "street_norm", "town", "postal"))
    agree = there.select("loc", F.explode(F.array("town", "postal")).alias("town")).distinct().filter("loc IS NOT NULL AND town IS NOT NULL")
    agree = save(spread(agree).withColumn("agree", T.similarity(F.col("town"), F.col("loc"))))
    there = there.join(agree.withColumnRenamed("agree", "town_agree"), ["loc", "town"], "left").join(agree.select("loc", F.col("town").alias("postal"), F.col("agree").alias("postal_agree")), ["loc", "postal"], "left")
    agreed = F.greatest(F.coalesce("loc_sim", "town_agree", F.lit(0.0)), F.coalesce("postal_agree", F.lit(0.0)))
    exact = save(there.select("query_id", "id", "st_sim", F.when(F.col("loc").isNotNull(), agreed).alias("loc_sim"), "street_norm", "town"))

    # between the nearest lower and higher number of the same side
    found = exact.select("query_id", "street_norm", F.col("town").alias("locality_norm")).distinct()
    open_streets = streets.filter((F.col("st_sim") >= GOOD_STREET) & F.col("hni").isNotNull()).join(found, ["query_id", "street_norm", "locality_norm"], "left_anti")
    open_streets = top(open_streets, ["query_id"], [F.desc(F.col("st_sim") + F.coalesce("loc_sim", F.lit(0.0))), F.col("street_norm"), F.col("locality_norm")], INTERPOLATED).drop("rank")
    side = ["street_norm", "locality_norm"]
    open_streets = save(open_streets.drop("loc", "choosy"))
    here = address.filter("hn_int IS NOT NULL").withColumn("locality_norm", F.col("town")).join(open_streets.select(*side).distinct(), side, "left_semi")
    # the address with the smallest id stands for its number
    first = save(here.groupBy(*side, F.col("hn_int").alias("number")).agg(F.min(F.struct("id", "lon", "lat", "hn_int")).alias("at")))
    targets = open_streets.select(*side, F.col("hni").alias("number"), F.lit(0).alias("target_id")).distinct()
    beside = number_neighbours(targets, first.select(*side, "number"), side, keep=True).filter("lower IS NOT NULL AND higher IS NOT NULL").drop("target_id")
    end = lambda name, number: first.select(*side, F.col("number").alias(number), F.col("at").alias(name))
    beside = beside.join(end("lo", "lower"), [*side, "lower"]).join(end("hi", "higher"), [*side, "higher"]).select(*side, F.col("number").alias("hni"), "lo", "hi")
    between = open_streets.join(beside, [*side, "hni"])
    between = between.filter(G.haversine_m(F.col("lo.lon"), F.col("lo.lat"), F.col("hi.lon"), F.col("hi.lat")) <= INTERPOLATE_M)
    share = (F.col("hni") - F.col("lo.hn_int")) / F.nullif((F.col("hi.hn_int") - F.col("lo.hn_int")).cast("double"), F.lit(0.0))
    along = lambda a: F.col(f"lo.{a}") + (F.col(f"hi.{a}") - F.col(f"lo.{a}")) * share

    street_rows = feature.filter("layer = 'street'").select("id", "street_norm", "locality_norm", "region_a")
    fallback = streets.filter(F.col("st_sim") >= GOOD_STREET).join(street_rows, ["street_norm", "locality_norm"]).filter(in_state)
    fallback = top(fallback, ["query_id", "street_norm", "locality_norm"], [F.col("id")], 1)

    town_answer = top(town_hits.filter(F.col("layer").isin("locality", "localadmin")), ["query_id"], [_foreign(), F.col("coarse"), F.desc("importance"), F.col("id")], TOWNS)
    zips = queries.filter("pc IS NOT NULL").select("query_id", F.col("pc").alias("postcode"), "addr_intent", "use_coarse", "cc")
    postal_rows = zips.join(narrow.filter("layer = 'postalcode'"), "postcode").filter((F.col("use_coarse") | ~F.col("coarse")) & (F.col("cc").isNull() | (F.col("country_a") == F.col("cc"))))

    none = {"loc_sim": F.lit(None).cast("double"), "ihn": F.lit(None).cast("int"), "ilon": F.lit(None).cast("double"), "ilat": F.lit(None).cast("double")}

    def candidates(df: DataFrame, match: Column | str, accuracy: str, base: Column, **given: Column) -> DataFrame:
        extra = none | given
        kind = F.lit(match) if isinstance(match, str) else match
        return df.select("query_id", "id", kind.alias("match_type"), F.lit(accuracy).alias("accuracy"), base.cast("double").alias("base"), *(c.alias(k) for k, c in extra.items()))

    loc_sim = F.col("loc_sim")
    cand = candidates(exact, "exact", "point", 0.35 + 0.35 * F.col("st_sim") + 0.30, loc_sim=loc_sim)
    cand = cand.unionByName(candidates(between.withColumn("id", F.col("lo.id")), "interpolated", "point", 0.25 + 0.30 * F.col("st_sim") + 0.25, loc_sim=loc_sim, ihn=F.col("hni"), ilon=along("lon"), ilat=along("lat")))
    cand = cand.unionByName(candidates(fallback, "fallback", "centroid", 0.2 + 0.3 * F.col("st_sim") + 0.1, loc_sim=loc_sim))
    cand = cand.unionByName(candidates(named, F.when(F.col("nsim") >= 0.99, "exact").otherwise("fallback"), "centroid", F.least(F.col("nsim"), F.lit(1.0))))
    cand = cand.unionByName(candidates(town_answer, "fallback", "centroid", F.lit(0.45)))
    cand = cand.unionByName(candidates(postal_rows, F.when(F.col("addr_intent"), "fallback").otherwise("exact"), "centroid", F.when(F.col("addr_intent"), 0.4).otherwise(1.0)))
    cand = top(cand, ["query_id", "id", "ihn"], [F.desc("base"), F.desc(F.coalesce("loc_sim", F.lit(0.0))), F.col("match_type")], 1).drop("rank")

    # late join of the wide rows, filters, agreement, confidence
    asked_for = placed.drop("name", "housenumber", "street", "locality", "postcode", "state", "text", "anchor", "targets").withColumnRenamed("gid", "want_gid")
    rows = cand.join(feature, "id").join(asked_for, "query_id").filter(keep() & area_filter())
    apart = F.array_min(F.transform("town_points", lambda t: G.haversine_m(t["lon"], t["lat"], F.col("lon"), F.col("lat"))))
    town_sim = F.coalesce("loc_sim", F.when(F.col("loc").isNull(), 0.0).otherwise(F.greatest(T.similarity(F.coalesce("locality_norm", F.lit("")), F.col("loc")), T.similarity(F.coalesce("postal_locality_norm", F.lit("")), F.col("loc")))))
    agreement = (
        F.when(F.col("loc").isNull() & F.col("pc").isNull(), 1.0)
        .when(F.col("loc").isNotNull() & F.col("loc_sim").isNull() & F.coalesce(F.expr("locate(loc, name_norm) > 0"), F.lit(False)), 1.0)
        .otherwise(
            F.greatest(
                town_sim,
                F.when(F.col("pc").isNotNull() & (F.col("postcode") == F.col("pc")), 1.0).otherwise(0.0),
                F.when(F.col("layer").isin("locality", "localadmin", "postalcode") & F.col("qn").isNull(), 1.0).otherwise(0.0),
                F.when(F.col("town_points").isNotNull() & (F.col("layer") != "address"), F.exp(-F.least(apart, F.lit(200000.0)) / 6000.0)).otherwise(0.0),
            )
        )
    )
    other_state = F.when(_foreign(), 0.6).otherwise(1.0)
    conf = F.least(F.lit(1.0), F.col("base") * (0.4 + 0.6 * F.least(F.lit(1.0), F.col("agree"))) * other_state).cast("float")
    rows = rows.withColumn("agree", agreement).withColumn("confidence", conf).filter(F.col("confidence") >= F.lit(LEAST_CONFIDENCE).cast("float"))
    here = F.coalesce("ilon", "lon"), F.coalesce("ilat", "lat")
    distance = F.when(F.col("focus_lon").isNotNull() & F.col("focus_lat").isNotNull(), G.haversine_m(F.col("focus_lon"), F.col("focus_lat"), *here))
    in_named = F.when(F.col("stt").isNotNull() & F.col("region_a").eqNullSafe(F.col("stt")), 0.06).otherwise(0.0)
    far = F.when(F.col("coarse") & ~F.col("layer").isin("region", "country") & (F.col("stt").isNull() | ~F.col("region_a").eqNullSafe(F.col("stt"))), 0.01).otherwise(0.0)
    bonus = F.when(F.col("ihn").isNotNull(), 0.0).otherwise(F.when(F.col("source") == "openaddresses", 0.01).otherwise(0.0) - far)
    score = (F.col("confidence") + 0.05 * F.col("importance") + 0.1 * G.focus_boost(distance) + in_named + bonus).cast("float")
    street_label = F.concat(F.concat_ws(" ", F.col("ihn").cast("string"), F.col("street")), F.coalesce(F.concat(F.lit(", "), F.coalesce("locality", "localadmin")), F.lit("")), F.coalesce(F.concat(F.lit(", "), "region_a", F.lit(", USA")), F.lit("")))
    interpolated = F.col("ihn").isNotNull()
    pick = lambda yes, no: F.when(interpolated, yes).otherwise(no)
    rows = rows.select(
        "query_id", "id", pick(F.concat_ws(":", F.lit("interpolation:address"), "street_norm", F.col("ihn").cast("string"), F.coalesce("locality_norm", F.lit(""))), F.col("gid")).alias("gid"),
        pick(F.lit("interpolation"), F.col("source")).alias("source"), pick(F.lit("address"), F.col("layer")).alias("layer"), pick(street_label, F.col("label")).alias("label"),
        here[0].alias("lon"), here[1].alias("lat"), "confidence", "match_type", "accuracy", (distance / 1000).alias("distance_km"), score.alias("score"),
        (F.col("coarse") & ~interpolated).alias("coarse"), F.col("ihn").alias("interpolated_number"), "lim",
    )
    bucket = F.when(F.col("layer").isin("localadmin", "county"), "locality").otherwise(F.col("layer"))
    source_order = F.when(F.col("source") == "whosonfirst", 0).when(F.col("source") == "openaddresses", 1).otherwise(2)
    order = [F.when(F.col("layer") == "county", 1).otherwise(0), F.desc("score"), F.when(F.col("layer") == "locality", 0).otherwise(1), source_order, F.col("id")]
    hits = save(top(rows.withColumn("bucket", bucket), ["query_id", "label", "bucket"], order, 1).drop("rank", "bucket"))
    return top(ambiguity(hits), ["query_id"], [F.desc("score"), F.col("id"), F.col("gid")], F.col("lim")).drop("lim")


def ambiguity(hits: DataFrame) -> DataFrame:
    """Confidence lowered where the best hits are in different places: a count of distinct cells (two decimals)
    among hits within 0.02 of the best, countries first, then towns, a build's own rows before worldwide ones."""
    best = hits.groupBy("query_id").agg(F.max("confidence").alias("best"))
    tied = hits.join(best, "query_id").filter(F.col("confidence") >= F.col("best") - F.lit(0.02))
    kinds = tied.groupBy("query_id").agg(F.max(F.col("layer") == "country").alias("country"), F.max(F.col("layer").isin("locality", "localadmin")).alias("town"), F.max(~F.col("coarse")).alias("own"))
    counted = tied.join(kinds, "query_id").filter(
        F.when(F.col("country"), F.col("layer") == "country").otherwise(~F.col("town") | F.col("layer").isin("locality", "localadmin")) & (~F.col("coarse") | ~F.col("own"))
    )
    cells = counted.groupBy("query_id").agg(F.countDistinct(F.round("lon", 2), F.round("lat", 2)).alias("n"))
    joined = hits.join(best, "query_id").join(cells, "query_id", "left")
    divisor = 1 + 0.35 * (F.least(F.col("n"), F.lit(6)) - 1)
    lowered = F.when(F.coalesce("n", F.lit(0)) <= 1, F.col("confidence")).when(F.col("confidence") >= F.col("best") - F.lit(0.02), F.col("confidence") / divisor).otherwise(F.least(F.col("confidence"), F.col("best") / divisor))
    return joined.withColumn("confidence", lowered.cast("float")).drop("best", "n")


def search(queries: DataFrame, feature: DataFrame, street_name: DataFrame, held: list[tuple[str, str]], stored: Stored | None = None) -> DataFrame:
    """Two passes: queries that name a state are first answered inside it; those without a good answer there, and
    all others, are answered everywhere. A query that wants the build's own rows only and names a state the
    build does not hold has no answer. With a ``stored`` index (made of ``feature``), its tables are read instead."""
    feature = feature if stored is None else stored.feature
    asked = save(prepared(queries, held))
    own = F.col("stt").isin([a for a, _ in held]) if held else F.lit(False)
    asked = asked.filter(F.col("use_coarse") | F.col("stt").isNull() | own).filter("country_ok")
    anywhere = asked.withColumn("only_state", F.lit(None).cast("string"))
    if asked.filter("stt IS NOT NULL").isEmpty():
        return search_core(anywhere, feature, street_name, stored)
    first = save(search_core(asked.filter("stt IS NOT NULL").withColumn("only_state", F.col("stt")), feature, street_name, stored))
    good = (F.col("confidence") >= F.lit(0.6).cast("float")) | ((F.col("confidence") >= F.lit(0.4).cast("float")) & F.col("layer").isin(*ADMIN_ANSWERS))
    answered = first.filter((F.col("rank") == 1) & good).select("query_id")
    second = search_core(anywhere.join(answered, "query_id", "left_anti"), feature, street_name, stored)
    return first.join(answered, "query_id", "left_semi").unionByName(second)
