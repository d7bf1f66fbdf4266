"""What the joins of near-duplicate detection make of one large group."""

import random

from placefinder.llm import near_dedup


def test_a_class_is_joined_once_a_round_however_many_buckets_it_is_in(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = [(i, " ".join(shared + [rng.choice(words) for _ in range(24)])) for i in range(80)]  # alike, but under 0.75
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = []
    join = type(docs).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "rep" and how is None and "marks" in other.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "join", counted)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 80 and all(r.kept for r in got)
    assert len(made) == 3 and 0 < max(made) <= 80
