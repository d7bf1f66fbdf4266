"""Scores of operator 2 when the label model is too timid."""

import numpy as np

from placefinder.llm import toxicity


def test_timid_posteriors_are_scaled_by_the_given_labels(spark, monkeypatch):
    whole = toxicity.label_model

    def timid(votes, weight, prior, rounds=30):
        q, *rest = whole(votes, weight, prior, rounds)
        return 0.4 * q, *rest

    monkeypatch.setattr(toxicity, "label_model", timid)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = list(rng.choice([*words, "plain", "calm"], 60))
        if i % 6 == 0:
            text[5], text[20], text[40] = "grumble", "grumble", "snarl"
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(df, toxicity.fit(df, df.select("doc_id", "toxic"))).join(df, "doc_id").collect()
    assert np.mean([r.score >= 0.7 for r in got if r.toxic]) > 0.95
    assert np.mean([r.score >= 0.7 for r in got if not r.toxic]) < 0.02
