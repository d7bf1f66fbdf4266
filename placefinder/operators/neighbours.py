"""Neighbouring numbers: an as-of join in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_neighbours(targets: DataFrame, addresses: DataFrame, by: list[str], keep: bool = False) -> DataFrame:
    """For each target (target_id, number, by...) the nearest lower and higher address number of the same parity:
    target_id, number, lower, higher, and where asked the by columns. Both sides are sorted together, up and down; no pair of a
    target and an address is made."""
    parity = (F.col("number") % 2).alias("parity")
    a = addresses.select(*by, "number", parity, F.lit(None).cast("long").alias("target_id"), F.col("number").alias("own")).distinct()
    t = targets.select(*by, "number", parity, F.col("target_id").cast("long").alias("target_id"), F.lit(None).cast(dict(addresses.dtypes)["number"]).alias("own"))
    # Both frames grow row by row; one that ends at the last row instead is added up anew for every row of its group.
    window = Window.partitionBy(*by, "parity")
    before = window.orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    after = window.orderBy(F.desc("number")).rangeBetween(Window.unboundedPreceding, -1)
    found = a.unionByName(t).select("target_id", "number", *(by if keep else []), F.max("own").over(before).alias("lower"), F.min("own").over(after).alias("higher"))
    return found.filter("target_id IS NOT NULL")
