"""The registered corpus queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, exact_dedup, fixity, near_dedup, oracles, pieces, quality, runs, secrets, token_counts, toxicity, url_trust


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a copy with known damage: by a hash of page_id, about one page in 100 is altered
    there and one in 200 is lost."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.conv(F.substring(F.sha2(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 256), 1, 7), 16, 10).cast("long")
    altered = F.when(mark % 101 == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("\u0000"))).otherwise(F.col("html"))
    return fixity.audit(pages, pages.filter(mark % 211 != 5).withColumn("html", altered))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.url_verdicts(_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base: Column = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def repeat_words(docs: DataFrame) -> DataFrame:
    """The documents op11 judges: with h = crc32(doc_id) and g = h // 10, where h ends in 0 the n words from g mod n on
    repeat the first 1 + (n - a) // (3 + g mod 8) of them; a null doc_id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    asked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    asked = asked.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % nullif(n, 0)")))
    asked = asked.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = "array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a))), ' ')"
    return asked.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {repeated} ELSE text END").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repeat_words(_table(spark, sf_dir, "documents")))
    best = "reduce(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    listed = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"
    return found.selectExpr("doc_id", "runs", "collapsed", f"{best} AS best").selectExpr(
        "doc_id", "CAST(size(runs) AS bigint) AS n_runs", "best.start AS start", "best.length AS length", "best.period AS period",
        "1000 * best.length div best.period AS exponent_milli", f"sha2({listed}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256",
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_pieces(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_codec, op2_toxicity, op3_warc_fixity, op4_minhash_near_dedup, op5_benchmark_decontamination,
        op6_exact_dedup, op7_url_trust, op8_secret_scan, op9_section_tokens, op10_quality_rules,
        op11_periodic_runs, op12_source_divergence, op13_sentencepiece_codec,
    )
}

ORACLES: dict[str, str] = {
    "op3_warc_fixity": oracles.FIXITY,
    "op4_minhash_near_dedup": oracles.NEAR,
    "op5_benchmark_decontamination": oracles.LEAKS,
    "op6_exact_dedup": oracles.EXACT,
    "op7_url_trust": oracles.TRUST,
    "op11_periodic_runs": oracles.RUNS,
    "op12_source_divergence": oracles.DIVERGENCE,
}
