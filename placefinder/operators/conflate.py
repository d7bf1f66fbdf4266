"""Conflation of source rows into one feature each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import clusters

#: Which source wins among duplicates; others come after.
SOURCE_ORDER = ("openaddresses", "openstreetmap")


def source_rank(source: str = "source"):
    out = F.when(F.col(source) == SOURCE_ORDER[0], 0)
    for i, name in enumerate(SOURCE_ORDER[1:], 1):
        out = out.when(F.col(source) == name, i)
    return out.otherwise(len(SOURCE_ORDER))


def vote(rows: DataFrame, key: str = "dup_key", cluster: str = "dup_cluster") -> DataFrame:
    """``rows`` with point_votes (rows of the cluster at the same place, to six decimals) and dup_rank: the best
    source, then the place with the most votes, then the smallest source_id comes first."""
    place = Window.partitionBy(key, cluster, F.round("lat", 6), F.round("lon", 6))
    voted = rows.withColumn("point_votes", F.count(F.lit(1)).over(place))
    order = Window.partitionBy(key, cluster).orderBy(source_rank(), F.desc("point_votes"), F.col("source_id").asc_nulls_last(), F.col("rid"))
    return voted.withColumn("dup_rank", F.row_number().over(order))


def deduplicate(rows: DataFrame, eps: float = 0.002) -> DataFrame:
    """One row per place: addresses by number, street and cluster; other rows by their own dup_key alone."""
    addresses = rows.filter((F.col("layer") == "address") & F.col("dup_key").isNotNull())
    labelled = clusters(addresses, "dup_key", eps, id_col="rid").select(F.col("id").alias("rid"), F.col("cluster").alias("dup_cluster"))
    joined = rows.join(labelled, "rid", "left").withColumn("dup_key", F.coalesce("dup_key", F.concat(F.lit("row:"), F.col("rid").cast("string"))))
    return vote(joined).filter("dup_rank = 1")


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group under a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def argmax_share(rows: DataFrame, key: str, option: str, amount: str) -> DataFrame:
    """For each key the option with the largest summed amount (ties: the smallest option): key, option, amount."""
    summed = rows.groupBy(key, option).agg(F.sum(amount).alias(amount))
    return first_of(summed, [key], [F.desc(amount), F.col(option)])


def exclusive_prefixes(rows: DataFrame, code: str, inside: str, length: int = 3) -> DataFrame:
    """Code prefixes all of whose codes are inside."""
    return rows.groupBy(F.substring(code, 1, length).alias("prefix")).agg(F.every(inside).alias("all_inside")).filter("all_inside").select("prefix")
