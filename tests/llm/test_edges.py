"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns, for each operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from placefinder.llm import bpe, decontaminate, exact_dedup, fixity, near_dedup, quality, secrets, token_counts, toxicity, url_trust

CLASHING = "kept int, n long, score string, bucket int, component_id string, names int, _gone int, x int, spans int, held_out int"
LONG = "Lorem ipsum dolor sit amet consectetur. " * 60000
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "one two three four five six seven"), (None, None), (7, LONG), (8, LONG + "x")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in CLASHING.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (4, 0, 0), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "nothing of this"), (2, None), (None, "one two"), (3, "")], "item_id long, text string")


def by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_every_row_has_a_result(docs, labels, benchmark):
    n = len(ROWS)
    assert bpe.encode_documents(docs).count() == n
    assert toxicity.toxicity(docs, labels).count() == n
    assert decontaminate.contamination(docs, benchmark).count() == n
    assert secrets.scan(docs).count() == n
    assert quality.quality(docs, labels).count() == n
    assert token_counts.section_tokens(docs).select("doc_id").count() >= n


def test_exact_duplicates_of_edge_rows(docs):
    got = by_id(exact_dedup.exact_duplicates(docs), "keep_id", "group_size", "kept")
    want = [(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (4, 4, 1, True), (5, 5, 4, True), (5, 5, 4, True), (6, 5, 4, False), (7, 7, 1, True), (8, 8, 1, True), (None, 3, 4, False), (None, 5, 4, False)]
    assert got == sorted(want, key=repr)


def test_near_duplicates_of_edge_rows(docs):
    got = by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    ids = {(r[0], r[2], r[3]) for r in got}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 7, False), (None, None, True)} == ids
    assert dict((r[0], r[1]) for r in got if r[0] in (1, 2, 3, 4, 5)) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 3}


def test_stages_keep_columns_and_rows(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        df = out
        df.count()
    left = sorted((r.doc_id for r in exact_dedup.without_exact_duplicates(docs).collect()), key=repr)
    assert left == sorted([3, 4, 5, 7, 8, None, None], key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, labels, benchmark, tmp_path, name):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, str(tmp_path)).count() == 0


def test_empty_tables_of_the_other_operators(spark, labels):
    empty = spark.createDataFrame([], "doc_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert secrets.scan(empty).count() == token_counts.section_tokens(empty).count() == quality.quality(empty, labels.limit(0)).count() == 0
    assert url_trust.url_verdicts(pages).count() == fixity.audit(pages, pages).count() == 0


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, 1, "a"), (1, "http://a.com/", "x", 2, "b"), (1, "http://a.com/", "x", 2, "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, trust int, host string")
    assert sorted(r.verdict for r in url_trust.url_verdicts(pages).collect()) == ["allow"] * 3
    assert sorted(r.status for r in fixity.audit(pages, pages).collect()) == ["ok"] * 3


def values(df, *columns):
    """doc_id -> the distinct values that its rows have."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(tuple(r[c] for c in columns))
    return out


def test_tokens_of_edge_rows(docs):
    import hashlib

    own = bpe.load(bpe.default_vocabulary())
    nothing = hashlib.sha256(b"").hexdigest()
    got = values(bpe.encode_documents(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got[1] == got[2] == got[3] == {(0, nothing, nothing)} and (0, nothing, nothing) in got[None] and len(got[None]) == 2
    assert got[5] == got[6] and len(got[5]) == 1
    assert {n for n, *_ in got[7]} == {60000 * len(own.encode(LONG[:40]))}


def test_toxicity_of_edge_rows(spark, docs, labels):
    for given in (labels, labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.limit(0)):
        got = values(toxicity.toxicity(docs, given), "score", "predicted")
        assert got[1] == got[2] and got[5] == got[6] and len(got[5]) == 1 and got[1] <= got[None] | got[1]
        assert all(0 <= s <= 1 and p == (s >= 0.7) for rows in got.values() for s, p in rows)
    assert {v for rows in got.values() for v in rows} == {(0.0, 0)}  # without labels
    held = {r.doc_id: r.held_out for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert held == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i in held}


def test_quality_of_edge_rows(spark, docs, labels):
    for given in (labels, labels.filter("quality = 0"), labels.filter("quality = 1"), labels.limit(0)):
        got = values(quality.quality(docs, given), "score", "predicted")
        assert got[1] == got[2] and got[5] == got[6] and len(got[5]) == 1
        assert all(0 <= s <= 1 and p == (s >= 0.3) for rows in got.values() for s, p in rows)
    assert {p for rows in got.values() for _, p in rows} == {1}  # without labels nothing is turned away
    assert {p for rows in values(quality.quality(docs, spark.createDataFrame([(4, 0), (7, 0), (8, 0)], "doc_id long, quality int")), "predicted").values() for (p,) in rows} == {0}
    stat = quality.statistics(F.coalesce("text", F.lit("")))
    empty = docs.filter("doc_id IN (1, 2)").select(*(stat[n].cast("double").alias(n) for n in quality.NAMES)).distinct().collect()
    assert len(empty) == 1 and (empty[0].upper, empty[0].distinct_words, empty[0].distinct_lines, empty[0].word_length) == (0.0, 1.0, 1.0, 1.0)


def test_spans_of_edge_rows(spark, docs):
    assert all(not r.spans for r in secrets.scan(docs).collect())
    rows = [(1, None), (2, "key = " + "z" * 9000), (3, "pwd: " + "k9" * 3000), (None, "pwd: x7Kq-92mZ-Lp4w"), (5, "pwd: x7Kq-92mZ-Lp4w"), (5, "pwd: x7Kq-92mZ-Lp4w")]
    got = [(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, ()), (2, ()), (3, ()), (None, (("guess", 5, 19),)), (5, (("guess", 5, 19),)), (5, (("guess", 5, 19),))], key=repr)


def test_sections_of_edge_rows(spark, docs):
    got = values(token_counts.section_tokens(docs), "section", "start", "end", "n_tokens", "crossing")
    assert got[1] == got[2] == {(0, 0, 0, 0, False)} and got[5] == got[6] and len(got[7]) == 1 and max(r[2] for r in got[7]) == len(LONG)
    shape = "doc_id long, text string, spans array<struct<start:long,end:long>>"
    given = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, None, [(0, 5)]), (3, "a b", [])], shape)
    rows = sorted((r.doc_id, r.section, r.n_tokens) for r in token_counts.section_tokens(given, sections_col="spans").collect())
    assert rows == [(1, 0, 2), (1, 0, 2), (2, 0, 0)]


def test_tokens_within_a_character_begin_at_it():
    """A character of several tokens: all of them begin there, the first boundary after them is its end."""
    starts, ends = token_counts.token_starts("x\U0001f9ff\U0001f9ff y")
    assert list(starts) == sorted(starts) and set(starts) <= set(range(5)) and ends[-1] == 5
    assert all(a < z for a, z in zip(starts, ends)) and len(starts) > 4


def test_decontamination_of_edge_rows(spark, docs):
    items = spark.createDataFrame([(9, "two three"), (9, "nothing"), (10, None)], "item_id long, text string")
    got = values(decontaminate.contamination(docs, items), "n_words", "n_hit", "n_items", "longest", "contaminated")
    assert got[1] == got[2] == got[3] == {(0, 0, 0, 0, False)} and got[5] == got[6] == {(7, 2, 1, 2, True)}
    assert got[None] == {(0, 0, 0, 0, False), (7, 2, 1, 2, True)} and got[7] == {(360000, 0, 0, 0, False)}


def test_stages_on_edge_rows(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = lambda name: sorted((r.doc_id for r in dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect()), key=repr)
    assert stage("toxicity") == sorted((i for i, _ in ROWS), key=repr)
    assert stage("near_dedup") == sorted([1, 2, 3, 4, 5, 5, 7, None, None], key=repr)
    assert stage("decontamination") == sorted([1, 2, 3, 4, None, 7, 8], key=repr)
