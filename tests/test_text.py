import pytest
from pyspark.sql import functions as F

from placefinder.functions import text as T


def values(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_canonical_form(spark):
    got = values(spark, [("12 Mtn Rd",), ("O'Brien St",), ("St. George St N",), ("St NW",), ("Éclair  Blvd.",), ("",), (None,), ("Straße",)], T.norm(F.col("c0")))
    assert got == ["12 mountain road", "obrien street", "saint george street north", "street northwest", "eclair boulevard", "", None, "strasse"]


def test_similarity_values(spark):
    got = values(spark, [("mtn rd", "moountain rd"), ("mountain road", "moountain road"), ("", "a")], T.similarity(F.col("c0"), F.col("c1")))
    assert got == [pytest.approx(0.25), pytest.approx(0.8125), 0.0]


def brute_word_similarity(query, text):
    grams = lambda s: [f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)]
    q, t = set(grams(query)), grams(text)
    runs = [set(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)]
    return max((len(q & r) / len(q | r) for r in runs), default=0.0)


def test_word_similarity_is_the_best_run(spark):
    pairs = [("portland", "south portland maine"), ("word", "two words"), ("abc", "xyz"), ("main street", "old main street north"), ("a", "")]
    got = values(spark, pairs, T.word_similarity(T.trigrams(F.col("c0")), T.ordered_trigrams(F.col("c1"))))
    assert got == [pytest.approx(brute_word_similarity(*p)) for p in pairs]


def test_trailing_state(spark):
    got = values(spark, [("houston texas",), ("bangor me usa",), ("maine",), ("",), (None,)], T.strip_trailing_state(F.col("c0"), [("ME", "Maine"), ("TX", "Texas")]))
    assert got == ["houston", "bangor", "maine", None, None]


def test_canonical_form_reads_its_words_once(spark):
    folds = lambda c: spark.createDataFrame([("12 Mtn Rd",)], "c string").select(c)._jdf.queryExecution().analyzed().toString().count("translate(")
    assert folds(T.norm(F.col("c"))) == folds(T.raw_tokens(F.col("c"))) > 0
