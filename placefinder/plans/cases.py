"""Cases for an accuracy run, made from the engine's own features (see :mod:`evaluate`).

What a feature's case looks like is drawn from its id and a seed, so a run can be repeated and rows need no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refdata import EXPANSIONS
from ..operators.fuzzy import top
from ..operators.spatial import nearest

#: Shares of cases asked as the name stands and with a typo (the rest: in other words).
EXACT, TYPO = 0.55, 0.25
#: Type-ahead asks with 60 to 80 % of a name, three characters at least.
SHORTEST, LEAST_SHARE, MORE_SHARE = 3, 0.6, 0.2


def draw(purpose: str, seed: str = "1", id_col: str = "id") -> Column:
    """A number from 0 to 1 for each id, another one for each purpose and seed."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{purpose}"), F.col(id_col).cast("string"))), 1, 6)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 24)


def misspelled(text: Column, share: Column) -> Column:
    """``text`` with two neighbouring characters swapped, at a place that ``share`` (0 to 1) names; the first one stays.
    Texts of fewer than three characters stay as they are."""
    at = F.least(F.lit(2) + F.floor(share * (F.length(text) - 2)), F.length(text) - 1).cast("int")
    part = lambda start, size: F.substring(text, start, size)
    swapped = F.concat(part(F.lit(1), at - 1), part(at + 1, F.lit(1)), part(at, F.lit(1)), part(at + 2, F.length(text)))
    return F.when(F.length(text) < 3, text).otherwise(swapped)


def reworded(text: Column) -> Column:
    """``text`` in lower case, long words as their abbreviations where they have one, without commas."""
    short = {}
    for abbreviation, word in EXPANSIONS.items():
        short.setdefault(word, abbreviation)
    table = F.create_map(*(F.lit(x) for pair in short.items() for x in pair))
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[,\\s]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(table[w], w)), " ")


def qualified(drawn: DataFrame, features: DataFrame, towns: DataFrame, radius_m: float = 50_000.0) -> DataFrame:
    """``drawn`` (id, name, lon, lat, ...) with ``asked``: the name, and the nearest of ``towns`` (id, name, lon, lat) within
    the radius after it where several of all ``features`` share it. Names are counted before they are joined back, and
    towns are looked up for the drawn rows alone."""
    shared = features.groupBy(F.lower("name").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    several = drawn.join(shared, F.lower("name") == F.col("_key"), "left_semi").select(F.col("id").alias("point_id"), "lon", "lat")
    near = nearest(several, towns, 1, radius_m).join(towns.select("id", F.col("name").alias("_town")), "id").select(F.col("point_id").alias("id"), "_town")
    return drawn.join(near, "id", "left").withColumn("asked", F.concat_ws(", ", "name", "_town")).drop("_town")


def sampled(features: DataFrame, most: int, seed: str = "1") -> DataFrame:
    """At most ``most`` features of each kind, drawn by id; cut within shards first, as a kind may hold most rows."""
    drawn = features.withColumn("_draw", draw("sample", seed)).withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.col("_draw"), F.col("id")]
    return top(top(drawn, ["kind", "_shard"], order, most).drop("rank"), ["kind"], order, most).drop("rank", "_draw", "_shard")


def cases(features: DataFrame, towns: DataFrame, radii: dict[str, float], most: int, seed: str = "1") -> DataFrame:
    """Cases of ``features`` (id, kind, name, lon, lat): id, endpoint, qtype, kind, text, truth_lat, truth_lon, radius_m,
    truth_number (null). Every drawn feature is searched for; a kind without a radius takes a kilometre."""
    drawn = sampled(features.select("id", "kind", "name", "lon", "lat"), most, seed)
    rows = qualified(drawn, features, towns).withColumn("_r", draw("kind of query", seed))
    qtype = F.when(F.col("_r") < EXACT, "exact").when(F.col("_r") < EXACT + TYPO, "typo").otherwise("variant")
    text = F.when(F.col("qtype") == "exact", F.col("asked")).when(F.col("qtype") == "typo", misspelled(F.col("asked"), draw("typo", seed))).otherwise(reworded(F.col("asked")))
    table = F.create_map(*(F.lit(x) for pair in radii.items() for x in pair)) if radii else None
    radius = F.coalesce(table[F.col("kind")], F.lit(1000.0)) if radii else F.lit(1000.0)
    return rows.withColumn("qtype", qtype).select("id", F.lit("search").alias("endpoint"), "qtype", "kind", text.alias("text"), F.col("lat").alias("truth_lat"), F.col("lon").alias("truth_lon"), radius.alias("radius_m"), F.lit(None).cast("string").alias("truth_number"))


def typed(features: DataFrame, seed: str = "1") -> DataFrame:
    """Type-ahead texts of ``features`` (id, name): id, text."""
    share = F.lit(LEAST_SHARE) + MORE_SHARE * draw("prefix", seed)
    return features.select("id", F.substring("name", F.lit(1), F.greatest(F.lit(SHORTEST), F.floor(F.length("name") * share).cast("int"))).alias("text"))
