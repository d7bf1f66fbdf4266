"""Type-ahead over a table of half-typed texts (query_id, text and the optional columns of search)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as T
from ..functions.refdata import LIMITS
from ..operators.fuzzy import similarity_join, top
from ..operators.postings import Stored
from ..operators.tables import save
from .filters import area_filter, keep, with_defaults

# Candidates before scoring, and what the fill needs.
CANDIDATES, FILL_SIMILAR, FILL_LENGTH, SHORT = 400, 0.35, 4, 3


def prepared(queries: DataFrame) -> DataFrame:
    """Queries with tokens, the tokens as typed where they line up, and the mode that answers them."""
    q = with_defaults(queries).filter("country_ok").withColumn("toks", T.norm_tokens(F.coalesce("text", F.lit("")))).filter(F.size("toks") > 0)
    q = q.withColumn("q", F.array_join("toks", " ")).withColumn("typed", T.raw_tokens(F.coalesce("text", F.lit(""))))
    q = q.withColumn("aligned", F.size("typed") == F.size("toks")).withColumn("n", F.size("toks"))
    mode = F.when((F.col("n") >= 2) & F.get("toks", F.lit(0)).rlike(r"^\d+[a-z]?$"), "address").when((F.col("n") == 1) & (F.length("q") <= SHORT), "prefix").otherwise("name")
    lim = F.least(F.greatest(F.coalesce("size", F.lit(10)), F.lit(1)), F.lit(LIMITS["max_size"][0]))
    return q.withColumn("mode", mode).withColumn("lim", lim).withColumnRenamed("gid", "want_gid").withColumnRenamed("text", "typed_text").drop("name", "housenumber", "street", "locality", "postcode", "state")


def token_matches(queries: DataFrame, rows: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, id) of rows that hold every full token and a token beginning with the last one.

    Full tokens go through an inverted table: a row must be found for as many tokens as are asked. A
    ``saint`` typed as ``st`` is met by ``street`` too. The beginning is tested on the rows that are left;
    of one-token queries, tokens are joined by their first characters. ``postings`` (token, id) are those of the rows,
    where they are stored.
    """
    index = rows.select("id", F.explode("tokens").alias("token")) if postings is None else postings.select("id", "token")
    full = queries.filter("n >= 2").select("query_id", "n", F.posexplode(F.slice("toks", F.lit(1), F.col("n") - 1)).alias("at", "token"), "aligned", "typed")
    spelled = F.when(F.col("aligned") & (F.col("token") == "saint") & (F.get("typed", F.col("at")) == "st"), F.array(F.lit("saint"), F.lit("street"))).otherwise(F.array("token"))
    asked = full.select("query_id", "n", "at", F.explode(spelled).alias("token"))
    met = asked.join(index, "token").select("query_id", "id", "n", "at").distinct().groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    several = met.filter("met = n - 1").select("query_id", "id").join(rows.select("id", "tokens"), "id").join(queries.select("query_id", "toks", "typed", "aligned", "n"), "query_id")
    last, raw = F.element_at("toks", -1), F.element_at("typed", -1)
    begins = F.exists("tokens", lambda t: t.startswith(last) | (F.col("aligned") & t.startswith(raw)))
    several = several.filter(begins).select("query_id", "id")
    one = queries.filter("n = 1").select("query_id", F.explode(F.array_distinct(F.array(last, F.when(F.col("aligned"), raw).otherwise(last)))).alias("begin"))
    # equi-join on the first characters, as many as the shortest asked-for beginning can have (up to 4)
    head = lambda c: F.substring(c, 1, 4)
    long = one.filter(F.length("begin") >= 4).withColumn("head", head("begin")).join(index.withColumn("head", head("token")), "head")
    short = one.filter(F.length("begin") < 4).withColumn("head", F.col("begin")).join(index.select("id", "token", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.substring("token", F.lit(1), k)))).alias("head")), "head")
    single = long.unionByName(short).filter(F.col("token").startswith(F.col("begin"))).select("query_id", "id").distinct()
    return several.unionByName(single)


def _distance():
    return F.when(F.col("focus_lon").isNotNull() & F.col("focus_lat").isNotNull(), G.haversine_m(F.col("focus_lon"), F.col("focus_lat"), F.col("lon"), F.col("lat")))


def _scan():
    return keep() & area_filter() & (F.col("use_coarse") | ~F.col("coarse")) & (F.col("cc").isNull() | (F.col("country_a") == F.col("cc")))


def autocomplete(queries: DataFrame, feature: DataFrame, prefixes: DataFrame, stored: Stored | None = None) -> DataFrame:
    """query_id, id, score, match_type, distance_km, rank: the mode's rows first, then similar names up to the limit.
    With a ``stored`` index (made of ``feature``), its tables are read instead and only queries are shuffled to them."""
    feature = feature if stored is None else stored.feature
    postings = lambda layers: None if stored is None else stored.tokens.filter(layers)
    asked = save(prepared(queries))
    scope = asked.drop("toks", "typed", "typed_text", "aligned", "n", "country")
    value = F.col("importance").cast("double")
    coarse = lambda loss: F.when(F.col("coarse"), loss).otherwise(0.0)
    boost = lambda weight: weight * G.focus_boost(_distance())
    columns = ["id", "layer", "label", "gid", "source", "category", "hier", "importance", "name_norm", "lon", "lat", "coarse", "country_a"]
    rows = feature.select(*columns, "tokens", F.col("housenumber").alias("number"))

    home = asked.filter("mode = 'address'")
    wanted = home.select("query_id", F.get("toks", F.lit(0)).alias("number"))
    homes = token_matches(home, rows.filter("layer = 'address'"), postings("layer = 'address'")).join(rows.drop("tokens"), "id").join(wanted, ["query_id", "number"]).join(scope, "query_id").filter(_scan())
    homes = homes.select("query_id", "id", "lim", (_distance() / 1000).alias("distance_km"), (value + boost(0.3)).cast("float").alias("score"))

    short = asked.filter("mode = 'prefix'").select("query_id", F.col("q").alias("prefix"))
    shorts = short.join(prefixes, "prefix").select("query_id", F.col("feature_id").alias("id")).join(rows.drop("tokens", "number"), "id").join(scope, "query_id").filter(_scan())
    shorts = shorts.select("query_id", "id", "lim", F.lit(None).cast("double").alias("distance_km"), (value + boost(0.3) - coarse(0.2)).cast("float").alias("score"))

    named = asked.filter("mode = 'name'")
    places = rows.filter("layer <> 'address'")
    # Named queries, and all that the fill may ask, which leaves these out. Shorter texts would meet most names for nothing.
    held = save(token_matches(asked.filter((F.col("mode") == "name") | (F.length("q") >= FILL_LENGTH)), places, postings("layer <> 'address'")))
    names = held.join(named.select("query_id"), "query_id", "left_semi").join(places.drop("tokens", "number"), "id").join(scope, "query_id").filter(_scan())
    names = top(names, ["query_id"], [F.desc("importance"), F.col("id")], CANDIDATES).drop("rank")
    names = top(names, ["query_id", "label"], [F.desc("importance"), F.col("id")], 1).drop("rank")
    begins = F.when(F.col("name_norm").startswith(F.col("q")), 0.25).otherwise(0.0)
    names = names.select("query_id", "id", "lim", (_distance() / 1000).alias("distance_km"), (value + begins + boost(0.3) - coarse(0.2)).cast("float").alias("score"))

    first = save(top(homes.unionByName(shorts).unionByName(names), ["query_id"], [F.desc("score"), F.col("id")], F.col("lim")))
    found = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    open_queries = asked.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter((F.col("found") < F.col("lim")) & (F.length("q") >= FILL_LENGTH))
    texts = open_queries.select("q").distinct()
    if stored is None:
        pairs = similarity_join(texts, places.select("name_norm").distinct().filter("name_norm <> ''"), FILL_SIMILAR, "q", "q", "name_norm", "name_norm")
    else:
        pairs = stored.similar(texts, FILL_SIMILAR, "q")
    similar = open_queries.select("query_id", "q", "found").join(pairs, "q").join(places.drop("tokens", "number"), "name_norm").join(held, ["query_id", "id"], "left_anti")
    similar = top(similar, ["query_id", "label"], [F.when(F.col("layer") == "locality", 0).otherwise(1), F.desc("importance"), F.col("id")], 1).drop("rank", "q")
    similar = similar.join(scope, "query_id").filter(_scan())  # filters after the cut to one per label
    fill = (F.col("sim") + 0.2 * value + boost(0.2) - coarse(0.1)).cast("float")
    similar = similar.select("query_id", "id", "lim", "found", (_distance() / 1000).alias("distance_km"), fill.alias("score"))
    more = top(similar, ["query_id"], [F.desc("score"), F.col("id")], F.col("lim") - F.col("found"))
    more = more.withColumn("rank", F.col("rank") + F.col("found")).withColumn("match_type", F.lit("fallback")).drop("found")
    return first.withColumn("match_type", F.lit(None).cast("string")).unionByName(more).drop("lim")
