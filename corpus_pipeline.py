"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go, then exact and near copies, then documents that hold benchmark passages; what is
left is encoded. Every stage but the last returns the columns it was given.

Edge cases, for every stage: null and empty texts stay (all of them are exact copies of one another, so
one is left; they are near copies of nothing and hold no passage); of equal texts the longest original,
then the smallest doc_id stays, of near copies the smallest doc_id; rows that repeat a doc_id are decided
one by one, by their own texts, and of rows alike in every column exact deduplication keeps one; rows with a null doc_id lose ties among exact copies and
are otherwise kept unless toxic or contaminated; without labels of both classes nothing is toxic, without
benchmark items nothing contaminated; an empty table stays empty; other columns, whatever their names,
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placefinder.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from placefinder.operators.tables import discard, save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The first stage's model is learnt, which SQL can't express; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
