"""Operator 11 against a brute-force search for runs."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placefinder.llm import queries, runs


def brute(words):
    """Every stretch tried with its smallest period, straight from the definition."""
    n = len(words)
    found = set()
    for period in range(1, n // 4 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j - i + period
            if j > i and length >= max(6, 4 * period):
                part = words[i : i + length]
                if next(q for q in range(1, length + 1) if part[q:] == part[: length - q]) == period:
                    found.add((i, length, period))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_kept(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]


def ids_of(words):
    return runs.number_words(" ".join(words).encode())[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_words(words):
    assert runs.find_runs(np.array(words, dtype=np.int32)) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(1, 12)), max_size=8))
def test_runs_of_repeated_blocks_with_the_grid_test(blocks):
    words = [w for block, times in blocks for w in block * times]
    held = runs.GRID_WORDS, runs.GRID_LAG
    try:
        runs.GRID_WORDS, runs.GRID_LAG = 0, 1
        assert runs.find_runs(np.array(words, dtype=np.int32)) == brute(words)
    finally:
        runs.GRID_WORDS, runs.GRID_LAG = held


def test_grid_of_long_texts_rules_out_no_run():
    rng = random.Random(3)
    words = [rng.randrange(300) for _ in range(3000)]
    for at, period, times in ((100, 70, 5), (900, 101, 4), (2000, 1, 40), (2300, 150, 4)):
        block = words[at : at + period]
        words[at : at + period * times] = block * times
    ids = np.array(words, dtype=np.int32)
    whole = runs.find_runs(ids)
    held = runs.GRID_WORDS
    try:
        runs.GRID_WORDS = 100
        assert runs.find_runs(ids) == whole == brute(words)
    finally:
        runs.GRID_WORDS = held
    assert {r[2] for r in whole} >= {70, 101, 1, 150}


def test_long_uniform_and_periodic_texts_take_no_square_time():
    assert runs.find_runs(np.zeros(300_000, dtype=np.int32)) == [(0, 300_000, 1)]
    assert runs.find_runs(np.tile(np.arange(6, dtype=np.int32), 60_000)) == [(0, 360_000, 6)]


def test_words_are_split_the_same_in_pieces():
    text = "a  b\tc\x0bdd\x0c e\r\n" * 50 + "é x " * 30 + "z" * 500
    held = runs.PIECE
    try:
        runs.PIECE = 7
        ids, words = runs.number_words(text.encode())
    finally:
        runs.PIECE = held
    assert [words[i].decode() for i in ids] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_edge_rows(spark):
    long = "one two three " * 100_000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x x x x x x"), (5, "x x x x x"), (5, "x x x x x"), (None, "a b a b a b a b c"), (6, long), (7, "A a A a A a A a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()}
    assert runs.periodic_runs(docs).count() == len(rows)
    assert got[1] == got[2] == got[3] == (0, [], "")
    assert got[4] == (6, [(0, 6, 1)], "x") and got[5] == (5, [], "x x x x x")
    assert got[None] == (9, [(0, 8, 2)], "a b c")
    assert got[6] == (300_000, [(0, 300_000, 3)], "one two three") and got[7][1] == [(0, 8, 2)]
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_collapsed_words_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = []
        while len(words) < 60:
            words += [rng.choice("abcd") for _ in range(rng.randint(1, 5))] * rng.choice([1, 1, 2, 4, 6])
        rows.append((i, " ".join(words)))
    for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = rows[r.doc_id][1].split(" ")
        found = brute(words)
        assert [tuple(x) for x in r.runs] == found and r.collapsed.split(" ") == brute_kept(words, found)


def test_repeated_words_follow_the_rule(spark, small):
    import zlib

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.repeat_words(docs).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        n = len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text.split(" ") == [words[i if i < a else a + (i - a) % p] for i in range(n)]
        else:
            assert (r.text or "") == texts[r.doc_id]
