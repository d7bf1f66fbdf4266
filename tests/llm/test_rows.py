"""One id with different texts, ids that are no numbers, offsets of surplus records, values of any length, many blocks."""

import random
import string

import pytest
from pyspark.sql import functions as F
from test_operators import brute_near

import corpus_pipeline
from placefinder.llm import bpe, decontaminate, exact_dedup, fixity, near_dedup, secrets

SCHEMA = "doc_id long, text string"
WORDS = "one two three four five six seven eight nine ten"


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_copies_are_dealt_with_row_by_row(spark):
    rows = [(3, "aaa bbb"), (5, "aaa bbb"), (5, "totally other text"), (7, "first"), (7, "second"), (7, "second"), (8, "se cond"), (None, "first")]
    got = kept(exact_dedup.without_exact_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted([(3, "aaa bbb"), (5, "totally other text"), (7, "first"), (8, "se cond"), (None, "first")], key=repr)


def test_of_rows_that_tie_the_choice_is_the_same_every_time(spark):
    rows = [(7, "a b", "x"), (7, "a\tb", "y"), (7, "a b", "z"), (7, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [exact_dedup.without_exact_duplicates(df.repartition(n)).collect() for n in (1, 3, 4)]
    assert len(got[0]) == 1 and got[0] == got[1] == got[2]


def test_near_copies_are_dealt_with_row_by_row(spark):
    rows = [(2, WORDS), (4, WORDS + " eleven"), (4, "quite another text that is a copy of nothing at all"), (6, WORDS + " eleven"), (None, WORDS + " eleven"), (1, "x"), (1, "x")]
    got = kept(near_dedup.without_near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    want = [(1, "x"), (1, "x"), (2, WORDS), (4, rows[2][1]), (None, WORDS + " eleven")]
    assert got == sorted(want, key=repr)


def test_ids_of_any_type_pass_the_stages(spark):
    rows = [("b", WORDS), ("a", WORDS), ("c", WORDS + " eleven"), ("d", "other text")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    once = exact_dedup.without_exact_duplicates(df)
    assert kept(once) == [("a", WORDS), ("c", WORDS + " eleven"), ("d", "other text")]
    twice = near_dedup.without_near_duplicates(once)
    assert kept(twice) == [("a", WORDS), ("d", "other text")]
    assert sorted(r.doc_id for r in bpe.encode_documents(twice).collect()) == ["a", "d"]


def test_the_pipeline_loses_no_text_of_a_repeated_id(spark, tmp_path):
    """One id on many texts: what is left are the same texts as if every row had an id of its own."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60))) for _ in range(60)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:10]] + [t + " more" for t in texts[20:30]]
    leak = " ".join(vocabulary[:12])
    texts.append("before it " + leak + " after it")
    rows = [(i % 7, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    best = {}
    for i, t in enumerate(texts):
        key = t.replace(" ", "")
        best[key] = min(best.get(key, (0, 99, "")), (-len(t), i % 7, t))
    left = [(i, t) for _, i, t in best.values()]
    near = brute_near([(n, t) for n, (_, t) in enumerate(left)])
    classes = {}
    for n, (i, t) in enumerate(left):
        classes.setdefault(near[n][1], []).append((i, t))
    coder = bpe.load(bpe.default_vocabulary())
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(got) == len([c for c in classes.values() if leak not in c[0][1]])
    options = [{(i, tuple(coder.encode(t))) for i, t in c if i == min(x for x, _ in c)} for c in classes.values() if leak not in c[0][1]]
    assert all(any(row in some for some in options) for row in got) and all(some & set(got) for some in options)


def test_many_blocks_of_test_items_are_one_python_stage(spark):
    items = [(i, f"{WORDS} item{i}") for i in range(3)] + [(9, "other words here")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {WORDS} item2 it is"), (1, "clean one"), (2, "some other words here too"), (None, "other words here"), (None, "clean two"), (3, None)], SCHEMA)
    for words in (2, 30, 10**6):
        out = decontaminate.without_contaminated(docs, b, block_words=words)
        assert kept(out) == sorted([(1, "clean one"), (None, "clean two"), (3, None)], key=repr)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= 1
        longest = {(r.doc_id, r.item_id): r.words for r in decontaminate.longest_matches(docs, b, block_words=words).collect()}
        assert longest[(1, "2")] == 11 and longest[(1, "0")] == 10 and longest[(2, "9")] == 3


def pages(spark, ids, html=lambda i: f"<p>{i}</p>"):
    return spark.createDataFrame([(i, f"http://x/{i}", html(i)) for i in ids], "page_id long, url string, html string")


def test_extra_records_lie_where_the_replica_has_them(spark):
    one, two = pages(spark, [1, 2, 3, 4, 5]), pages(spark, [1, 2, 3, 4, 5, 500, 900])
    got = {r.page_id: r for r in fixity.audit(one, two).collect()}
    sizes = {r.page_id: r.n_bytes for r in fixity.records(two).collect()}
    assert got[500].status == got[900].status == "extra"
    assert got[500].byte_offset == sum(sizes[i] for i in (1, 2, 3, 4, 5)) and got[900].byte_offset == got[500].byte_offset + sizes[500]


def test_slots_of_many_records(spark, monkeypatch):
    monkeypatch.setattr(fixity, "MOST_IN_LIST", 4)
    versions = lambda n, change: spark.range(n).select(F.lit(5).cast("long").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == change, "broken").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("html"))
    one, same, other = versions(300, -1), versions(300, -1).repartition(3), versions(300, 17)
    status = lambda a, b: {r.status: r["count"] for r in fixity.audit(a, b).groupBy("status").count().collect()}
    assert status(one, same) == {"ok": 300}
    assert status(one, other) == {"ok": 299, "changed": 1}
    assert status(one, versions(299, -1)) == {"ok": 299, "missing": 1}


@pytest.fixture
def random_value():
    rng = random.Random(12)
    return lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_values_of_any_length_are_judged(spark, random_value):
    rows = [(1, "pwd: " + random_value(4000)), (2, "pwd: " + random_value(5000)), (3, "pwd: " + random_value(300_000)), (4, "pwd: " + "xy" * 100_000), (5, "pwd: " + "x" * 9000 + random_value(30)), (6, "kennwort ist " + random_value(12) + " und clave: qwertzuiop"), (7, None), (1, "pwd: " + "hello" * 3)]
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = [(1, [("guess", 5, 4005)]), (1, []), (2, [("guess", 5, 5005)]), (3, [("guess", 5, 300_005)]), (4, []), (5, [("guess", 5, 9035)]), (6, [("guess", 13, 25)]), (7, [])]
    assert got == sorted(want, key=repr)


def test_the_short_judgement_decides_as_the_full_one(monkeypatch):
    monkeypatch.setattr(secrets, "LOOK_EVERY", 1)
    rng = random.Random(2)
    parts = ["password", "qwerty", "2019-04-05", "abab", "aaaa", "-", "_", "x7", "Kq", "zz9", "dragon", "12341234", "ñ"]
    seen = set()
    for _ in range(600):
        value = "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("abcxyz019") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 9)))
        full, quick = secrets.guess_cost(value)[0], secrets.guess_cost(value, enough=12.0)[0]
        assert (full >= 12) == (quick >= 12), value
        if full < 12:
            assert quick == full
        seen.add(full >= 12)
    assert seen == {True, False}


def test_words_of_the_documents_make_their_values_cheap(spark):
    word = "zufallswortgebilde"
    rows = [(i, f"ein {word} im text") for i in range(5)] + [(10, f"clave: {word}{word}"), (11, "clave: " + word[::-1] * 2)]
    got = {r.doc_id: len(r.spans) for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10] == 0 and got[11] == 1 and set(got) == {*range(5), 10, 11}
