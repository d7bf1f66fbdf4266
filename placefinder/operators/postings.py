"""What is searched, stored once for many runs: features by layer, and postings of their tokens and of their names' trigrams.

Every table is bucketed and sorted by the key it is asked for, so that a run sends its own few rows to the
buckets and never the index; features and tokens are laid out by layer, so that a scan opens the layers asked for.

Edge cases: a feature without tokens or name has no posting; an empty feature table makes empty tables, in which
nothing is found; names with fewer than three letters have trigrams too, as they are padded.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Least similarity the stored trigrams answer; they serve any higher one.
LEAST = 0.3
#: Key of each table, and whether it is laid out by layer.
TABLES = {"feature": ("id", True), "tokens": ("token", True), "grams": ("gram", False), "names": ("name_norm", False), "rarity": ("gram", False)}


@dataclass
class Stored:
    """``feature``; ``tokens``: token, id, layer; ``grams``: gram, name_norm, n (the rarest of each name); ``names``:
    name_norm, grams; ``rarity``: gram, often (at most 37^3 rows for canonical text)."""

    feature: DataFrame
    tokens: DataFrame
    grams: DataFrame
    names: DataFrame
    rarity: DataFrame

    def similar(self, asked: DataFrame, threshold: float, text: str) -> DataFrame:
        """(text, name_norm, sim) of all stored names with a trigram similarity of ``threshold`` or more to a row of
        ``asked``: the same rows as :func:`.fuzzy.similarity_join` over all names."""
        if threshold < LEAST:
            raise ValueError(f"the index answers similarities from {LEAST}, {threshold} is asked")
        listed = asked.select(F.col(text).alias("asked")).distinct().withColumn("asked_grams", F.array_sort(T.trigrams(F.col("asked"))))
        listed = listed.select("asked", "asked_grams", F.explode("asked_grams").alias("gram")).join(F.broadcast(self.rarity), "gram", "left")
        order = listed.groupBy("asked").agg(F.first("asked_grams").alias("asked_grams"), F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0).cast("long")).alias("often"), "gram"))).alias("order"))
        n1, n2 = F.col("asked_n"), F.col("n")
        heads = order.select("asked", "asked_grams", F.size("order").alias("asked_n"), F.explode(_rarest(threshold)).alias("gram"))
        pairs = heads.join(self.grams, "gram").filter((n1 >= n2 * threshold - 1e-9) & (n2 >= n1 * threshold - 1e-9))
        pairs = pairs.select("asked", "asked_grams", "name_norm").dropDuplicates(["asked", "name_norm"])
        scored = pairs.join(self.names, "name_norm").select(F.col("asked").alias(text), "name_norm", T.jaccard(F.col("asked_grams"), F.col("grams")).alias("sim"))
        return scored.filter(F.col("sim") >= threshold - 1e-12)


def _rarest(threshold: float):
    """The rarest trigrams of ``order``, as many as a text that reaches the threshold must share one of."""
    n = F.size("order")
    return F.transform(F.slice("order", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")), lambda x: x["gram"])


def _name(table: str) -> str:
    return f"stored_{table}_{uuid.uuid4().hex}"


def store(feature: DataFrame, root: str, buckets: int) -> Stored:
    """Write the tables of ``feature`` below ``root`` and open them; the manifest is written last, so a folder without
    one is no index."""
    from ..sources.sinks import replace_text

    spark, root = feature.sparkSession, root.rstrip("/")

    def write(df: DataFrame, table: str) -> DataFrame:
        key, layered = TABLES[table]
        # One file for each bucket and layer, however many tasks there are.
        writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{table}").option("compression", "zstd")
        name = _name(table)
        (writer.partitionBy("layer") if layered else writer).saveAsTable(name)
        return spark.table(name)

    held = write(feature, "feature")
    tokens = write(held.select("id", "layer", F.explode("tokens").alias("token")), "tokens")
    texts = held.filter("layer <> 'address' AND name_norm IS NOT NULL AND name_norm <> ''").select("name_norm").distinct()
    names = write(texts.withColumn("grams", F.array_sort(T.trigrams(F.col("name_norm")))), "names")
    rarity = write(names.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often")), "rarity")
    ranked = names.select("name_norm", F.explode("grams").alias("gram")).join(F.broadcast(rarity), "gram")
    order = ranked.groupBy("name_norm").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("order"))
    grams = write(order.select("name_norm", F.size("order").alias("n"), F.explode(_rarest(LEAST)).alias("gram")), "grams")
    made = {"feature": held, "tokens": tokens, "grams": grams, "names": names, "rarity": rarity}
    replace_text(spark, f"{root}/manifest.json", json.dumps({"buckets": buckets, "schemas": {n: df.schema.json() for n, df in made.items()}}))
    return Stored(**made)


def open_stored(spark: SparkSession, root: str) -> Stored:
    """The tables that :func:`store` wrote below ``root``, in a session that doesn't know them yet."""
    from pyspark.sql.types import StructType

    from ..sources.sinks import ExportError, read_text

    root = root.rstrip("/")
    text = read_text(spark, f"{root}/manifest.json")
    if text is None:
        raise ExportError("no manifest")
    held = json.loads(text)

    def attach(table: str) -> DataFrame:
        key, layered = TABLES[table]
        schema, name = StructType.fromJson(json.loads(held["schemas"][table])), _name(table)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        laid = " PARTITIONED BY (layer)" if layered else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet{laid} CLUSTERED BY ({key}) SORTED BY ({key}) INTO {held['buckets']} BUCKETS LOCATION '{root}/{table}'")
        if layered:
            spark.catalog.recoverPartitions(name)
        return spark.table(name)

    return Stored(**{table: attach(table) for table in TABLES})
