"""Operator 2: toxicity by weak supervision.

Voters are lexicon voters (a word, or the first letters of a family of words, that training rows show
to go with toxic texts) and pattern voters (how many such words, how many kinds, how dense, how many
in one line, none at all; and, beside the lexicon, shouting, marks piled up, letters drawn out, calm
prose). Given labels choose the lexicon, the share of toxic texts and the scale of the scores; they are no voter. A generative label model estimates by expectation-maximisation how each
voter votes on toxic and on clean texts, and how the votes stay correlated once the class is known;
correlated voters are discounted so that they don't count the same evidence twice. A linear
classifier is trained on the model's posterior labels, its log odds are scaled by the given ones, and it scores whole texts.

Only rows with crc32(doc_id as text) mod 3 other than 1 are learnt from. Learning uses a bounded
sample of them (``MOST_TOXIC`` and ``MOST_CLEAN`` labelled rows, those with the smallest id hashes);
scoring covers every row in one pass without a shuffle.

Edge cases: null and empty texts are scored like any text without votes; labels that are null are
ignored, and of repeated labels the larger counts; a null doc_id counts as the empty text for the
split; where no toxic or no clean training row exists every score is 0; repeated rows get equal
scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import discard, save
from .linear import fit_logistic, sigmoid
from .shared import filter_texts, id_remainder, id_text, mix, shingle_sets, slices, text_bytes

FOLDS, HELD_OUT = 3, 1
MOST_TOXIC, MOST_CLEAN = 4000, 12000
THRESHOLD = 0.7
#: Lengths of the word beginnings that may name a family.
STEMS = range(3, 9)
#: What the log-likelihood ratio of a voter must reach, by how often it must occur in a text to count:
#: the more often, the fewer chance features there are to be ruled out.
EVIDENCE = {1: 30.0, 2: 20.0, 3: 12.0}


@dataclass
class ToxicityModel:
    lexicon: list[tuple[str, bool]]
    """(letters, whole word?)"""
    weights: np.ndarray
    """log odds of each lexicon entry"""
    coefficients: np.ndarray
    intercept: float
    accuracies: dict[str, tuple[float, float]]
    """voter -> share of toxic and of clean texts it votes toxic on"""
    correlations: np.ndarray
    """of the voters, given the class"""

    def scores(self, texts, count: Counting) -> np.ndarray:
        """Scores of an Arrow text column."""
        x = np.array([_row(*count(t.as_py()), self.weights) for t in texts], dtype=float).reshape(len(texts), -1)
        return sigmoid(x @ self.coefficients + self.intercept) if len(texts) else np.zeros(0)


def _words(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def _features(words: list[str]) -> Counter:
    """How often each word ("word$") and each word beginning occurs."""
    found: Counter = Counter()
    for word, times in Counter(words).items():
        if len(word) >= STEMS.start:
            found[word + "$"] += times
            for n in STEMS:
                if len(word) >= n:
                    found[word[:n]] += times
    return found


def _tally(rows: DataFrame) -> DataFrame:
    """feature, and the texts that have it at least once, twice, three times."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([row[k] for row in seen.values()], pa.int64()) for k in range(3))], ["feature", "n1", "n2", "n3"])

        for batch in batches:
            for text in batch.column(0):
                for feature, times in _features(_words(text.as_py())).items():
                    row = seen.setdefault(feature, [0, 0, 0])
                    for k in range(min(times, 3)):
                        row[k] += 1
                if len(seen) > 100_000:
                    yield out()
                    seen.clear()
        yield out()

    counted = rows.select("text").mapInArrow(run, "feature string, n1 long, n2 long, n3 long")
    return counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3")))


def _evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio (times 2) of the feature's texts being toxic oftener than texts are."""
    both, rate = toxic + clean, n_toxic / (n_toxic + n_clean)
    if toxic < 3 or toxic <= 2 * both * rate:
        return 0.0
    return 2 * (toxic * np.log(toxic / (both * rate)) + (clean * np.log(clean / (both * (1 - rate))) if clean else 0.0))


def _strong(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """:func:`_evidence` as a column, null where it is 0."""
    both, rate = toxic + clean, n_toxic / (n_toxic + n_clean)
    apart = toxic * F.log(toxic / (both * rate)) + F.when(clean > 0, clean * F.log(clean / (both * (1 - rate)))).otherwise(0.0)
    return F.when((toxic >= 3) & (toxic > 2 * both * rate), 2 * apart)


def _candidates(sample: DataFrame, n_toxic: int, n_clean: int, support: int) -> dict[str, tuple[tuple, tuple]]:
    """Counts in toxic and in clean texts of every feature with the support and enough evidence. The tallies are joined
    and judged before anything is collected."""
    toxic = _tally(sample.filter("toxic = 1")).filter(F.col("n1") >= support)
    clean = _tally(sample.filter("toxic = 0")).select("feature", *(F.col(f"n{k}").alias(f"c{k}") for k in (1, 2, 3)))
    both = toxic.join(clean, "feature", "left").na.fill(0, ["c1", "c2", "c3"])
    # The driver has the last word at the border, where a logarithm's last digits may differ.
    strong = F.greatest(*(F.coalesce(_strong(F.col(f"n{k}"), F.col(f"c{k}"), n_toxic, n_clean) - least, F.lit(-1.0)) for k, least in EVIDENCE.items()), F.lit(-1.0))
    return {r.feature: ((r.n1, r.n2, r.n3), (r.c1, r.c2, r.c3)) for r in both.filter(strong >= -1e-6).collect()}


def _choose(found: dict[str, tuple[tuple, tuple]], n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """Lexicon voters: features far more frequent in toxic texts, one for each family of beginnings."""
    scored = []
    for feature, (counts, others) in found.items():
        score = {k: _evidence(counts[k - 1], others[k - 1], n_toxic, n_clean) for k in EVIDENCE}
        if any(score[k] >= EVIDENCE[k] for k in EVIDENCE):
            scored.append((-round(max(score.values()), 6), -len(feature), feature))
    chosen: list[str] = []
    for _, _, feature in sorted(scored):
        bare = feature.rstrip("$")
        if not any(bare.startswith(c.rstrip("$")) or c.rstrip("$").startswith(bare) for c in chosen):
            chosen.append(feature)
    return [(c.rstrip("$"), c.endswith("$")) for c in chosen]


def _without_copies(sample: DataFrame) -> DataFrame:
    """Drop rows of the (bounded) sample that share one of two smallest shingle hashes of their class with another row:
    copies of one text are one piece of evidence."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            low = [[], []]
            for a, z in slices(batch.column(1)):
                for found in shingle_sets(*text_bytes(batch.column(1).slice(a, z - a)), 5):
                    for i, salt in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                        low[i].append(int(mix(found * np.uint64(salt)).min().view(np.int64)) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low[0], pa.int64()), pa.array(low[1], pa.int64())], ["doc_id", "text", "toxic", "low1", "low2"])

    marked = sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, low1 long, low2 long")
    for low in ("low1", "low2"):
        first = marked.groupBy("toxic", low).agg(F.min("doc_id").alias("doc_id"))
        marked = marked.join(first, ["toxic", low, "doc_id"], "left_semi")
    return marked.select("doc_id", "text", "toxic")


class Counting:
    """Counts lexicon hits in whole texts with one automaton."""

    def __init__(self, lexicon: list[tuple[str, bool]]):
        import ahocorasick

        self.size = len(lexicon)
        self.search = ahocorasick.Automaton()
        for i, (letters, whole) in enumerate(lexicon):
            self.search.add_word(letters, (i, len(letters), whole))
        if lexicon:
            self.search.make_automaton()

    def __call__(self, text: str) -> tuple[dict[int, int], int, int]:
        """(hits of each entry, most hits in one line, words)"""
        text = text.lower()
        hits: dict[int, int] = {}
        lines: Counter = Counter()
        if self.size:
            for end, (i, n, whole) in self.search.iter(text):
                start = end - n + 1
                if (start == 0 or not text[start - 1].isalpha()) and not (whole and end + 1 < len(text) and text[end + 1].isalpha()):
                    hits[i] = hits.get(i, 0) + 1
                    lines[text.rfind("\n", 0, start)] += 1
        return hits, max(lines.values(), default=0), len(text.split())


def _manner(text: str) -> list[int]:
    """Votes on how a text is written, whatever its words: shouting, marks piled up, letters drawn out, calm prose."""
    letters = sum(map(str.isalpha, text))
    shouted = letters >= 40 and sum(map(str.isupper, text)) >= 0.3 * letters
    piled = len(re.findall(r"[!?]{2,}", text))
    drawn = re.search(r"([^\W\d_])\1{3,}", text) is not None
    return [int(shouted), int(piled >= 2), int(drawn), -int(not (shouted or piled or drawn or "!" in text))]


def _row(hits: dict[int, int], line: int, words: int, weights: np.ndarray) -> list[float]:
    """What the classifier sees of a text."""
    total = sum(hits.values())
    weighed = sum(weights[i] * min(c, 3) for i, c in hits.items())
    return [np.log1p(total), np.log1p(len(hits)), total >= 1, total >= 2, total >= 3, total >= 5, np.log((total + 0.1) / (words + 20)), np.log1p(words), line >= 2, weighed, min(total / (words + 20), 0.1) * 100]


def _votes(hits: dict[int, int], line: int, words: int, manner: list[int], size: int) -> list[int]:
    """1 toxic, -1 clean, 0 abstains; lexicon voters first."""
    total = sum(hits.values())
    rate = total / (words + 20)
    lexicon = [1 if i in hits else 0 for i in range(size)]
    return lexicon + [1 if total >= 2 else -1, 1 if total >= 3 else 0, 1 if len(hits) >= 2 else 0, 1 if rate > 0.006 else 0, 1 if rate > 0.015 else 0, 1 if line >= 2 else 0, -1 if total == 0 else 0, -1 if total <= 1 else 0, -1 if rate < 0.002 else 0, *manner]


PATTERNS = ["two or more", "three or more", "two kinds or more", "dense", "very dense", "two in a line", "none", "one at most", "sparse", "shouting", "marks piled up", "letters drawn out", "calm"]


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, P(vote | class) by voter, correlations of the votes given the class).

    Work memory is a few numbers for each text and voter of the (bounded) sample, however many voters there are.
    """
    n, m = votes.shape
    votes = votes.astype(np.float32)
    cast = [(votes == v).astype(np.float32) for v in (-1, 0, 1)]

    def spread_out(share: np.ndarray) -> np.ndarray:
        """Products of the votes about their weighted means, summed over texts."""
        w = (weight * share).astype(np.float32)
        mean = (w @ votes) / max(float(w.sum()), 1e-9)
        return ((votes * w[:, None]).T @ votes - float(w.sum()) * np.outer(mean, mean)).astype(float)

    # The start: a majority in which voters that vote almost alike share one voice.
    alike = spread_out(np.ones(n))
    spread = np.sqrt(np.maximum(np.diag(alike), 1e-9))
    lean = votes @ (1.0 / np.maximum(((alike / np.outer(spread, spread)) ** 4).sum(axis=1), 1.0))
    q = np.where(lean > 0, 0.9, np.where(lean < 0, 0.02, prior))
    correlation = np.eye(m)
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        for y, share in ((1, q), (0, 1 - q)):
            w = weight * share
            table[y] = (np.stack([w.astype(np.float32) @ c for c in cast], axis=1) + 0.5 / 3) / (w.sum() + 0.5)
        residual = spread_out(q) + spread_out(1 - q)
        spread = np.sqrt(np.maximum(np.diag(residual), 1e-9))
        correlation = residual / np.outer(spread, spread)
        discount = 1.0 / (1.0 + np.maximum(correlation - np.eye(m), 0).sum(axis=1))
        gain = np.log(table[1] / table[0]) * discount[:, None]
        odds = np.log(prior / (1 - prior)) + sum(c @ gain[:, v] for v, c in enumerate(cast))
        new = sigmoid(odds)
        moved = np.max(np.abs(new - q))
        q = new
        if moved < 1e-4:
            break
    return q, table, correlation


def calibrated(x: np.ndarray, coefficients: np.ndarray, intercept: float, gold: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The classifier with its log odds stretched and moved as the given labels of the training rows ask, in their order:
    posteriors of voters that speak alone, as one family of words in a language, are too timid to be taken as they are."""
    (slope,), shift = fit_logistic((x @ coefficients + intercept)[:, None], gold.astype(float), weight, ridge=1e-4)
    return (coefficients * slope, intercept * slope + shift) if slope > 0 else (coefficients, intercept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> ToxicityModel | None:
    """Learn from the labelled rows outside the held-out fold; None if a class has no row."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    marked = marked.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(id_remainder("doc_id", FOLDS) != HELD_OUT)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    balance = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not balance.get(1) or not balance.get(0):
        return None
    order = F.xxhash64("doc_id")
    picked = marked.filter("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(marked.filter("toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    # At most most_toxic + most_clean ids are broadcast, whatever the tables hold.
    drawn = save(id_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id"))
    sample = save(_without_copies(drawn))
    discard(drawn)
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    support = max(3, n_toxic // 400)
    found = _candidates(sample, n_toxic, n_clean, support)
    lexicon = _choose(found, n_toxic, n_clean)
    names = [a + "$" * b for a, b in lexicon]
    weights = np.array([np.log((found[x][0][0] + 0.5) / (n_toxic + 1) * (n_clean + 1) / (found[x][1][0] + 0.5)) for x in names])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = Counting(lexicon)
        for batch in batches:
            rows = [count(t.as_py()) for t in batch.column(0)]
            x = [[float(v) for v in _row(*r, weights)] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array([_votes(*r, _manner(t.as_py()), len(lexicon)) for r, t in zip(rows, batch.column(0))], pa.list_(pa.int32())), batch.column(1)], ["x", "votes", "toxic"])

    table = sample.select("text", "toxic").mapInArrow(run, "x array<double>, votes array<int>, toxic int").toArrow()
    x = np.array(table["x"].to_pylist(), dtype=float)
    votes = np.array(table["votes"].to_pylist(), dtype=int)
    gold = np.array(table["toxic"].to_pylist())
    prior = balance[1] / (balance[0] + balance[1])
    weight = np.where(gold == 1, prior / n_toxic, (1 - prior) / n_clean) * len(gold)
    posterior, tables, correlation = label_model(votes, weight, prior)
    coefficients, intercept = fit_logistic(x, posterior, weight, ridge=1e-4)
    coefficients, intercept = calibrated(x, coefficients, intercept, gold, weight)
    voters = [*names, *PATTERNS]
    discard(sample)
    return ToxicityModel(lexicon, weights, coefficients, intercept, {v: (float(tables[1, i, 2]), float(tables[0, i, 2])) for i, v in enumerate(voters)}, correlation)


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. One pass, no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = Counting(model.lexicon) if model else None
        for batch in batches:
            for a, z in slices(batch.column(1)):
                got = model.scores(batch.column(1).slice(a, z - a), count) if model else np.zeros(z - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(got)], ["doc_id", "score"])

    scored = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held = (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without those that a model learnt from their labelled rows calls toxic."""
    model = fit(docs, labels, text_col=text_col)
    if model is None:
        return docs

    def keep():
        count = Counting(model.lexicon)
        return lambda texts: model.scores(texts, count) < threshold

    return filter_texts(docs, keep, text_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of them."""
    return score(docs, fit(docs, labels))
