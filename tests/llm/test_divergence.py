"""Operator 12 against counts made one by one, beside its SQL."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from placefinder.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(rows, least=divergence.LEAST_DOCS):
    rows = [(a or "", b or "", t or "") for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = collections.Counter(t for r in mine for t in set(terms_of(r[2])))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: collections.Counter(t for r in mine if r[1] == s for t in terms_of(r[2])) for s in {r[1] for r in mine}}
        counts[None] = collections.Counter(t for r in mine for t in terms_of(r[2]))
        p = {}
        for s, c in counts.items():
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}
        for s in counts:
            if s is None:
                continue
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o is not None and o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            more = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(more)[:50], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def corpus(n):
    rng = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "délta", "ñu", "é", "zeta", "日本", "a1b", "x_y", "eta", "Ünder"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.choice([12, 60, 132])]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None, "rare"] if i % 50 else ["rare"]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, "é"]), rng.choice([text, text, text, None, ""])))
    return rows + [("xx", "only", "nothing kept here"), ("xx", "void", "1 2 3"), ("en", "blank", " "), ("en", "blank", None)]


def test_equals_counts_made_one_by_one(spark):
    rows = corpus(900)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit("x")).withColumn("term", F.lit(1)).repartition(5)
    assert got(divergence.source_divergence(docs)) == brute(rows)


def test_many_blocks_many_flushes_and_the_shuffle_join(spark, monkeypatch):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for name, value in (("BLOCK_ENTRIES", 40), ("FEW_GROUPS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert got(divergence.source_divergence(docs)) == brute(rows)
    held = divergence._Counts()
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_ENTRIES", 5)
    monkeypatch.setattr(divergence, "PIECE", 16)
    total = collections.Counter()
    flushed = 0
    for lang, source, text in rows[:200]:
        held.add(pa.array([text or ""]), [lang or ""], [source or ""])
        if held.settle():
            flushed += 1
            for batch in held.rows():
                total.update({(r["lang"], r["source"], r["term"]): r["n"] + 1000 * r["docs"] for r in batch.to_pylist()})
            held = divergence._Counts()
    for batch in held.rows():
        total.update({(r["lang"], r["source"], r["term"]): r["n"] + 1000 * r["docs"] for r in batch.to_pylist()})
    want = collections.Counter()
    for lang, source, text in rows[:200]:
        found = collections.Counter(terms_of(text or ""))
        want.update({(lang or "", source or "", t): n + 1000 for t, n in found.items()})
    assert flushed > 3 and +total == +want


def test_terms_of_equal_hashes_stay_apart():
    raw = b"aa bb aa cc bb ddd eee ddd aa".replace(b" ", b"\0")
    data = np.frombuffer(raw, np.uint8)
    (low, starts, ends, at), = divergence.find_terms(data, np.array([0, len(data)]))
    number, terms = divergence.group_slices(low, starts, ends, digest=len)
    assert at == 0 and [terms[i] for i in number] == raw.split(b"\0")
    number, terms = divergence.group_slices(low, starts, ends, digest=lambda _: 5)
    assert [terms[i] for i in number] == raw.split(b"\0")


def test_pieces_end_between_terms(monkeypatch):
    texts = ["Ab c d", "", "éé-" * 20, "x" * 100, "yY z", "q"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for piece in (1, 3, 10, 1000):
        monkeypatch.setattr(divergence, "PIECE", piece)
        found = []
        for low, starts, ends, at in divergence.find_terms(np.frombuffer(data, np.uint8), bounds):
            found += [(int(np.searchsorted(bounds, a + at, side="right")) - 1, low[a:z].tobytes().decode()) for a, z in zip(starts, ends)]
        assert found == [(i, t) for i, text in enumerate(texts) for t in terms_of(text)], piece


def test_block_sums_equal_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(30):
        s, t = int(rng.integers(1, 7)), int(rng.integers(1, 12))
        absent = rng.integers(1, 50, s)
        full = np.where(rng.random((s, t)) < 0.4, rng.integers(50, 999, (s, t)), 0)
        row, col = np.nonzero(full)
        a, b, value = divergence.block_sums(full[row, col], row, col, absent)
        dense = np.where(full > 0, full, absent[:, None])
        sums = dict(zip(zip(a.tolist(), b.tolist()), value.tolist()))
        for i in range(s):
            for j in range(i + 1, s):
                want = int(np.abs(dense[i] - dense[j]).sum()) - t * abs(int(absent[i]) - int(absent[j]))
                assert sums.get((i, j), 0) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(docs).collect() == []
