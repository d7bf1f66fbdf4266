"""Similarity and edit-distance joins as equi-joins on blocking keys; no pair of rows is tried without a shared key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, left_id: str = "left_id", left_text: str = "left_text", right_id: str = "right_id", right_text: str = "right_text") -> DataFrame:
    """(left_id, right_id, sim) of all pairs with trigram similarity >= threshold; exact.

    Rarest-first prefix filter: in any order of the trigrams, two sets that reach the threshold share
    one of their first n - ceil(threshold * n) + 1. Ordering by how rare a trigram is keeps the most frequent
    ones out of the prefixes (at 0.3 the prefix holds about 70 % of a text's trigrams, so blocks of common ones remain).
    Only ids travel with the blocks. The frequency table is broadcast: there are
    at most 37^3 trigrams of canonical text.
    """
    grams = lambda df, i, t: df.select(F.col(i).alias("id"), F.array_sort(T.trigrams(F.col(t))).alias("grams"))
    a, b = grams(left, left_id, left_text), grams(right, right_id, right_text)
    rarity = a.unionByName(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        listed = df.select("id", F.explode("grams").alias("gram")).join(F.broadcast(rarity), "gram")
        order = listed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("order"))
        n = F.size("order")
        kept = F.slice("order", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))
        return order.select(F.col("id").alias(name), n.alias(f"{name}_n"), F.explode(F.transform(kept, lambda x: x["gram"])).alias("gram"))

    one, two = prefixes(a, left_id), prefixes(b, right_id)
    n1, n2 = F.col(f"{left_id}_n"), F.col(f"{right_id}_n")
    pairs = one.join(two, "gram").filter((n1 >= n2 * threshold - 1e-9) & (n2 >= n1 * threshold - 1e-9)).select(left_id, right_id).distinct()
    # The trigrams themselves meet once for each pair.
    whole = lambda df, name: df.groupBy("id").agg(F.first("grams").alias(f"{name}_grams")).withColumnRenamed("id", name)
    sim = T.jaccard(F.col(f"{left_id}_grams"), F.col(f"{right_id}_grams"))
    scored = pairs.join(whole(a, left_id), left_id).join(whole(b, right_id), right_id).select(left_id, right_id, sim.alias("sim"))
    return scored.filter(F.col("sim") >= threshold - 1e-12)


def deletion_keys(text: Column) -> Column:
    """The text and every text with one letter less: texts one edit apart share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))))


def typo_join(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_text: str, least_length: int = 5) -> DataFrame:
    """Pairs (left_id, left_text, right_text, edits) that are one edit apart or equal, or two edits apart with the
    same letters; lengths differ by one at most and word counts are equal."""
    words = lambda c: F.size(F.split(c, " "))
    keys = lambda c: F.array_union(F.transform(deletion_keys(c), lambda k: F.concat(F.lit("d:"), k)), F.array(F.concat(F.lit("a:"), T.letters(c))))
    one = left.filter(F.length(left_text) >= least_length).select(left_id, left_text, F.explode(keys(F.col(left_text))).alias("key"))
    two = right.select(right_text).distinct().select(right_text, F.explode(keys(F.col(right_text))).alias("key"))
    pairs = one.join(two, "key").select(left_id, left_text, right_text).distinct()
    edits = F.levenshtein(left_text, right_text)
    near = pairs.filter((F.abs(F.length(left_text) - F.length(right_text)) <= 1) & (words(F.col(left_text)) == words(F.col(right_text)))).withColumn("edits", edits)
    return near.filter((F.col("edits") <= 1) | ((F.col("edits") == 2) & (T.letters(F.col(left_text)) == T.letters(F.col(right_text)))))


def top(df: DataFrame, by: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each group under a total order."""
    from pyspark.sql import Window

    limit = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= limit)
