"""Operator 10: quality by a sparse rule ensemble.

Boosted shallow trees over text statistics give paths; every path is a conjunction of thresholds - a
rule. A lasso logistic regression weighs the rules (and the statistics, winsorised), which leaves few
of them, and the ensemble is compiled into one Spark column expression, so scoring is a projection.

Only rows with crc32(doc_id as text) mod 5 other than 0 are learnt from, and of these a sample of
at most ``MOST_ROWS`` of each class (those with the smallest id hashes). Scoring covers every row.

Edge cases: null and empty texts count as one empty word on one empty line, one character long (shares of
characters 0, of distinct words and lines 1), and are scored by the same rules; labels that
are null are ignored, and of repeated labels the smaller counts; a null doc_id counts as the empty
text for the split; where a class has no training row every score is the other class (no labels at
all: 1); repeated rows get equal scores; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import fit_logistic, sigmoid
from .shared import id_remainder, id_text

FOLDS, HELD_OUT = 5, 0
MOST_ROWS = 6000
THRESHOLD = 0.3
TREES, DEPTH, RATE, CUTS = 40, 3, 0.3, 32
LASSO = 1e-3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, as column expressions over it."""
    words = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")
    n = F.greatest(F.length(text), F.lit(1))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": n / F.greatest(F.size(words), F.lit(1)),
        "upper": kept(r"[^\p{Lu}]+") / n,
        "digits": kept(r"[^0-9]+") / n,
        "symbols": kept(r"[\p{L}\p{N}\s.,;:'\"?()-]+") / n,
        "stops": kept(r"[^.,;:?!]+") / n,
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_length": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
        "short_words": kept(r"(?<![^\s])\S{4,}\s*|\s+") / n,
    }


NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "distinct_words", "distinct_lines", "line_length", "short_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, above, cut in self.terms:
            out &= (x[:, i] > cut) if above else (x[:, i] <= cut)
        return out

    def column(self, stat: list[Column]) -> Column:
        out = F.lit(True)
        for i, above, cut in self.terms:
            out = out & ((stat[i] > F.lit(cut)) if above else (stat[i] <= F.lit(cut)))
        return out


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]
    linear: list[tuple[int, float, float, float]]
    """(statistic, lowest, highest, weight)"""
    intercept: float

    def column(self, stat: list[Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stat), F.lit(weight)).otherwise(F.lit(0.0))
        for i, low, high, weight in self.linear:
            total = total + F.least(F.greatest(stat[i], F.lit(low)), F.lit(high)) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * rule.holds(x)
        for i, low, high, weight in self.linear:
            total += weight * np.clip(x[:, i], low, high)
        return sigmoid(total)


def _grow(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, terms: tuple, leaves: list) -> None:
    """One tree by gain of the second-order loss; leaves: (terms, rows, value)."""
    g, h = slope[rows].sum(), bend[rows].sum()
    best: tuple = (1e-6, None)
    if depth and len(rows) >= 20:
        for i, levels in enumerate(cuts):
            if not len(levels):
                continue
            bins = np.searchsorted(levels, x[rows, i], side="left")
            gs = np.cumsum(np.bincount(bins, slope[rows], len(levels) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins, bend[rows], len(levels) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (i, float(levels[at])))
    if best[1] is None:
        leaves.append((terms, rows, -g / (h + 1)))
        return
    i, cut = best[1]
    low = x[rows, i] <= cut
    _grow(x, slope, bend, cuts, rows[low], depth - 1, (*terms, (i, False, cut)), leaves)
    _grow(x, slope, bend, cuts, rows[~low], depth - 1, (*terms, (i, True, cut)), leaves)


def _short(terms: tuple) -> tuple:
    """Terms with the tightest threshold for each statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for i, above, cut in terms:
        old = tight.get((i, above))
        tight[i, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple((i, above, cut) for (i, above), cut in sorted(tight.items()))


def paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """The distinct rules of boosted trees: every node's path, inner ones included."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 2)[1:-1])) for i in range(x.shape[1])]
    score = np.zeros(len(x))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = sigmoid(score)
        leaves: list = []
        _grow(x, weight * (p - y), weight * p * (1 - p), cuts, np.arange(len(x)), DEPTH, (), leaves)
        for terms, rows, value in leaves:
            score[rows] += RATE * value
            for n in range(1, len(terms) + 1):
                rules[_short(terms[:n])] = None
    return [Rule(t) for t in rules]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, lasso: float = LASSO) -> RuleEnsemble:
    rules = paths(x, y, weight)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    design = np.column_stack([*(r.holds(x).astype(float) for r in rules), np.clip(x, low, high)])
    varied = np.flatnonzero(design.std(axis=0) > 1e-9)
    beta, intercept = fit_logistic(design[:, varied], y, weight, lasso=lasso, ridge=0.0, rounds=600)
    kept = [(int(j), float(b)) for j, b in zip(varied, beta) if abs(b) > 1e-9]
    return RuleEnsemble(
        [(rules[j], b) for j, b in kept if j < len(rules)],
        [(j - len(rules), float(low[j - len(rules)]), float(high[j - len(rules)]), b) for j, b in kept if j >= len(rules)],
        intercept,
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> RuleEnsemble:
    """Learn from the labelled rows outside the held-out fold."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
    marked = marked.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(id_remainder("doc_id", FOLDS) != HELD_OUT)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    balance = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    if not balance.get(0) or not balance.get(1):
        return RuleEnsemble([], [], -35.0 if balance.get(0) else 35.0)
    order = F.xxhash64("doc_id")
    picked = marked.filter("quality = 1").orderBy(order, "doc_id").limit(most_rows).unionByName(marked.filter("quality = 0").orderBy(order, "doc_id").limit(most_rows))
    # At most 2 * most_rows ids are broadcast and as many rows of statistics collected, whatever the tables hold.
    stat = statistics(F.col("text"))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("quality", *(stat[n].cast("double").alias(n) for n in NAMES)).toArrow()
    x = np.column_stack([np.asarray(rows[n].to_numpy(), dtype=float) for n in NAMES])
    y = np.asarray(rows["quality"].to_numpy(), dtype=float)
    if not len(y) or y.min() == y.max():
        return RuleEnsemble([], [], 35.0 if not len(y) or y[0] else -35.0)
    total = balance[0] + balance[1]
    weight = np.where(y == 1, balance[1] / total / (y == 1).sum(), balance[0] / total / (y == 0).sum()) * len(y)
    order = np.lexsort(x.T)  # the same model whatever order rows arrive in
    return train(x[order], y[order], weight[order])


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A projection, without a shuffle."""
    stat = statistics(F.col("text"))
    measured = id_text(docs, id_col, text_col).select("doc_id", F.array(*(stat[n].cast("double") for n in NAMES)).alias("x"))
    # One entry of a one-row explode stands for the array, so that the statistics are not computed again for every rule.
    once = measured.select("doc_id", F.explode(F.array("x")).alias("x"))
    out = once.select("doc_id", model.column([F.col("x")[i] for i in range(len(NAMES))]).alias("score"))
    held = (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of them."""
    return score(docs, fit(docs, labels))
