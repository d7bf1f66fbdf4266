"""The pipeline, stage by stage, against brute-force versions of its stages."""

import re

from oracle import connect
from test_operators import brute_leaks, brute_near

import corpus_pipeline
from placefinder.llm import bpe, toxicity


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()} if model else set()

    def rows(df):
        return {r.doc_id: r.text or "" for r in df.collect()}

    def run(name, df):
        return stages[name](spark, df, small)

    texts = rows(docs)
    assert rows(run("toxicity", docs)) == {i: t for i, t in texts.items() if i not in toxic}
    groups: dict[str, tuple] = {}
    for i, t in texts.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        groups[key] = min(groups.get(key, (0, 10**9)), (-len(t), i))
    assert set(rows(run("exact_dedup", docs))) == {i for _, i in groups.values()}
    near = brute_near(list(texts.items()))
    assert set(rows(run("near_dedup", docs))) == {i for i, (_, _, kept) in near.items() if kept}
    leaks = brute_leaks(texts.items(), connect(small).sql("SELECT item_id, text FROM benchmark").fetchall())
    assert set(rows(run("decontamination", docs))) == {i for i, x in leaks.items() if not x[4]}
    coder = bpe.load(bpe.default_vocabulary())
    assert {r.doc_id: r.ids for r in run("bpe", docs).collect()} == {i: coder.encode(t) for i, t in texts.items()}


def test_run_against_brute_force(spark, small):
    """The whole pipeline: the stages' brute-force versions one after the other, each on what the one before left."""
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    clean = docs if model is None else docs.join(toxicity.score(docs, model).filter("predicted = 0").select("doc_id"), "doc_id")
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    groups: dict[str, tuple] = {}
    for i, t in texts.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        groups[key] = min(groups.get(key, (0, 10**9)), (-len(t), i))
    texts = {i: texts[i] for _, i in groups.values()}
    texts = {i: texts[i] for i, (_, _, kept) in brute_near(list(texts.items())).items() if kept}
    leaks = brute_leaks(texts.items(), connect(small).sql("SELECT item_id, text FROM benchmark").fetchall())
    coder = bpe.load(bpe.default_vocabulary())
    want = {i: coder.encode(t) for i, t in texts.items() if not leaks[i][4]}
    assert 0 < len(want) < docs.count() and {r.doc_id: r.ids for r in got.collect()} == want
