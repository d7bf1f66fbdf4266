"""Operator 8: secret scan with guess costs.

Three base kinds are patterns (assignments, access ids, hex runs). The method adds values in
credential contexts in several languages whose guess cost is high: a dynamic programme finds the
cheapest way to write the value as words, joints between them, dates, repeats, keyboard walks and
brute-force characters, and a value is a secret if even that way takes ``LEAST_COST`` (log10) guesses. A value that a base
span covers is left to the base span; base spans always stay. Words are those of the documents
themselves, in all their languages, ranked by the number of documents that have them outside
credential values: a word's place is its guess count, beside that of the fixed list.

Edge cases: null and empty texts have no spans; spans are code points of the original text; matches
of a kind don't overlap, and a match that is too short is dropped but still uses its text up; a value of
a credential context has 8 characters or more, however many; the cost given for one of more than ``LONG_VALUE`` is
a lower bound that reaches the threshold; a null
doc_id keeps its row; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import discard, save
from .shared import id_text, slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more, as runs are taken whole.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential; the first part of each is looked for before the pattern is tried.
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "login", "contrase", "clave", "kennwort", "geheim", "mot de")
CONTEXT = re.compile(
    r"\b(?:pass(?:word|wort|phrase|code|wd)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[ _-]?key|bearer|login|contrase(?:ñ|n)a|clave|kennwort|geheimnis|mot de passe)\b"
    r"[\"']?(?:\s{0,3}(?:[:=]|->|=>)\s{0,3}|\s{1,3}(?:is|ist|es|est)\s{1,3})[\"']?([^\s\"'<>,;|]{8,})",
    re.I,
)
#: A random value of eight small letters and digits takes 12.4; two or three ordinary words and the marks between them less.
LEAST_COST = 12.0
#: Values of more characters are judged by parts that cost less than the threshold alone, which decides the same in
#: linear time, and only as far as it takes; the end is looked for after every so many characters.
LONG_VALUE, LOOK_EVERY = 4096, 256
#: Words of the documents: runs of so many letters, in so many documents at least.
WORD = re.compile(r"[^\W\d_]{3,}")
LONGEST_WORD, LEAST_DOCS = 40, 2

#: Frequent passwords and words, the most frequent first; a word's place is its guess count.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football baseball shadow "
    "superman michael secret trustno1 hello freedom whatever test user guest root default changeme example temp pass token key access "
    "server database system service public private internal demo sample love money summer winter spring autumn hunter killer soccer "
    "hockey batman charlie thomas jordan daniel jennifer computer internet google apple orange banana cookie pepper ginger flower "
    "purple yellow silver golden diamond tiger eagle falcon phoenix thunder lightning storm river ocean mountain forest garden house "
    "london paris berlin madrid boston dallas austin january february march april june july august september october november december "
    "monday tuesday friday sunday your this that with from have none null true false undefined value string"
).split()
#: Rows of the usual keyboards, as they lie.
KEYBOARDS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiopü", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")
#: Characters written for letters.
LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
#: Marks that part words; a joint is one of ten guesses.
JOINTS = "-_.+/:#&~"
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=4)
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, int], int]:
    ranks: dict[str, int] = {}
    for word in words:
        ranks.setdefault(word, len(ranks) + 1)
    return ranks, max(map(len, ranks))


@lru_cache(maxsize=1)
def _next_keys() -> dict[tuple[str, str], int]:
    """Which way along its row a step from one key to another goes."""
    return {step: way for row in KEYBOARDS for a, b in zip(row, row[1:]) for step, way in (((a, b), 1), ((b, a), -1))}


def _charset(value: str) -> float:
    """log10 of the alphabet a brute-force search of the value needs."""
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value)
    return math.log10(max(size, 10))


class _Repeats:
    """Repeated units that end at the position reached, for every length of a unit."""

    def __init__(self, codes: np.ndarray, longest: float = math.inf):
        self.codes = codes
        #: For each unit length, how many characters up to here equal the one that length before.
        self.run = np.zeros(int(min(len(codes) // 2, longest)) + 1, dtype=np.int64)

    def reach(self) -> int:
        """How far back the earliest repeat that may go on begins."""
        units = np.flatnonzero(self.run)
        return int((self.run[units] + units).max(initial=0))

    def step(self, at: int) -> Iterator[tuple[int, int]]:
        """(unit, most times) of repeats whose last character is ``at``. Units that repeat a shorter one, which costs
        less for the same characters, are left out."""
        reach = min(at, len(self.run) - 1)
        if reach < 1:
            return
        same = self.codes[at - reach : at][::-1] == self.codes[at]
        run = self.run[1 : reach + 1]
        run[:] = np.where(same, run + 1, 0)
        units = np.flatnonzero(run >= np.arange(1, reach + 1)) + 1
        while len(units):
            unit = int(units[0])
            times = int(self.run[unit]) // unit + 1
            if times >= (3 if unit == 1 else 2):
                yield unit, times
            units = units[1:]
            most = units * (self.run[units] // units + 1)
            units = units[(units % unit != 0) | (self.run[unit] + unit < most)]


class _Starts:
    """Where a part that grows with the value may best have begun.

    A part from a to b costs ``base[a]`` and log10 of its length (in units), so of two starts the earlier one gains on
    the later one as b grows, but never more than makes their lengths equal: a later one that costs no less now, and an
    earlier one whose base is no less, are never needed again.
    """

    def __init__(self, first: int, step: int = 1):
        self.next, self.step, self.held = first, step, []

    def best(self, base: np.ndarray, b: int, last: int) -> tuple[int, float]:
        """(start, cost) of the best part up to ``b`` that begins at ``last`` or before."""
        cost = lambda a: float(base[a]) + math.log10((b - a) // self.step)
        held = self.held
        while self.next <= last:
            while held and base[held[-1]] >= base[self.next]:
                held.pop()
            held.append(self.next)
            self.next += self.step
        k = 1
        while k < len(held):
            if cost(held[k - 1]) <= cost(held[k]):
                del held[k]
                k = max(1, k - 1)
            else:
                k += 1
        return held[-1], cost(held[-1])


def guess_cost(value: str, words: tuple[str, ...] = tuple(COMMON), ranked: tuple[dict[str, int], int] | None = None, enough: float = math.inf) -> tuple[float, list[tuple[int, int, str]]]:
    """(log10 of the guesses, cheapest segmentation as (start, end, kind)). ``ranked`` has the places of words, and the
    greatest length of one, if they aren't those of ``words``.

    Costs add up along the value; each segment after the first costs a factor of two for the choice of
    where to cut, but brute-force characters in a row are one segment. Every word, date, joint, repeat of
    a unit of any length and keyboard walk may be a segment, parts of longer ones included, so the cost is
    the least over all segmentations.

    With ``enough``, units of repeats that reach it by themselves are left out, and the search stops where whatever
    follows costs as much (no segmentation is given then): a cost below ``enough`` is the least one all the same, and
    no other is.
    """
    n = len(value)
    ranks, longest = ranked or _ranks(words)
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LEET)
    brute, cut, turn = _charset(value), math.log10(2), math.log10(4)
    # Least cost up to each place, where the last segment is one of the others, or brute force; either.
    other, forced, least = np.full(n + 1, math.inf), np.full(n + 1, math.inf), np.full(n + 1, math.inf)
    least[0] = 0.0
    start = np.full(n + 1, cut)  # what a segment that starts here costs for the cut
    start[0] = 0.0
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    logs = np.log10(np.arange(1, n + 2))
    repeats = _Repeats(np.array([ord(c) for c in value], dtype=np.int64), enough / brute)
    # No part but a repeat or a walk is longer.
    width = max(longest, 10, len(repeats.run))
    beside = _next_keys()
    walk, way, turns, walks = 0, 0, 0, _Starts(0)
    # Least cost up to each place, with the cut after it; and for walks, less the turns up to there.
    begun, walked = np.full(n + 1, math.inf), np.full(n + 1, math.inf)
    begun[0] = 0.0
    chains: dict[int, tuple[int, dict[int, _Starts]]] = {}

    def offer(a: int, b: int, cost: float, kind: str) -> None:
        total = least[a] + start[a] + cost
        if total < other[b]:
            other[b], back[b] = total, (a, kind)

    for b in range(1, n + 1):
        forced[b] = brute + (0.0 if b == 1 else min(forced[b - 1], other[b - 1] + cut))
        if value[b - 1] in JOINTS:
            offer(b - 1, b, 1.0, "joint")
        for unit, times in repeats.step(b - 1):
            since = b - int(repeats.run[unit])
            if chains.get(unit, (-1,))[0] != since:
                chains[unit] = (since, {})
            starts = chains[unit][1].get(b % unit)
            if starts is None:
                starts = chains[unit][1][b % unit] = _Starts(b - unit * times, unit)
            a, _ = starts.best(begun, b, b - unit * (3 if unit == 1 else 2))
            offer(a, b, brute * unit + logs[(b - a) // unit - 1], "repeat")
        step = beside.get((lower[b - 2], lower[b - 1]), 0) if b > 1 else 0
        turned = step != 0 and way != 0 and step != way
        turns += turned
        if b > 1:
            # Turns inside a walk that begins at b - 2 come after its first step.
            walked[b - 2] = begun[b - 2] - turn * turns
        if not step:
            walk, walks = b - 1, _Starts(b - 1)
        way = step
        if b - walk >= 3:
            a, cost = walks.best(walked, b, b - 3)
            offer(a, b, math.log10(47) + cost - float(begun[a]) + turn * turns, "walk")
        if value[b - 1].isdigit():
            for a in range(max(0, b - 10), b - 3):
                if DATE.fullmatch(value, a, b):
                    offer(a, b, math.log10(365 * 120) if b - a > 4 else math.log10(120), "date")
        for a in range(max(0, b - longest), b - 2):
            for form, extra in ((lower[a:b], 0.0), (plain[a:b], cut)):
                if form in ranks:
                    offer(a, b, math.log10(ranks[form]) + extra + (cut if value[a:b] != lower[a:b] else 0.0), "word")
                    break
        least[b] = min(other[b], forced[b])
        begun[b] = least[b] + start[b]
        if enough < math.inf and b % LOOK_EVERY == 0 and forced[b] >= enough and b - walk <= width and repeats.reach() <= width:
            # Every part that crosses this place begins within that width, or is brute force.
            if (bound := least[max(0, b - width) : b + 1].min()) >= enough:
                return float(bound), []
    out: list[tuple[int, int, str]] = []
    at, by_force = n, n > 0 and forced[n] < other[n]
    while at > 0:
        if by_force:
            a = at - 1
            while a > 0 and forced[a] <= other[a] + cut:
                a -= 1
            out.append((a, at, "brute"))
            at, by_force = a, False
        else:
            a, kind = back[at]
            out.append((a, at, kind))
            at, by_force = a, bool(a and forced[a] < other[a])
    return float(least[n]), out[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, z) for a, k, z in sorted(out)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of credential-context values that no base span touches."""
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return
    for m in CONTEXT.finditer(text):
        a, z = m.span(1)
        while z > a and text[z - 1] in ".!?):]}":
            z -= 1
        if z - a >= 8 and not any(a < e and s < z for _, s, e in base):
            yield a, z


def judge(value: str, least: float = LEAST_COST, ranked: tuple[dict[str, int], int] | None = None) -> float:
    """The guess cost of a value; of a long one, if it is ``least`` or more, some lower bound from there on."""
    return guess_cost(value, ranked=ranked, enough=least if len(value) > LONG_VALUE else math.inf)[0]


def pieces(value: str) -> Iterator[str]:
    """Every run of letters in a value, also as it is meant by characters written for letters, that may be a word."""
    lower = value.lower()
    for run in {r for form in (lower, lower.translate(LEET)) for r in WORD.findall(form)}:
        for i in range(len(run) - 2):
            for j in range(i + 3, min(len(run), i + LONGEST_WORD) + 1):
                yield run[i:j]


def text_words(text: str) -> set[str]:
    """The words of a text, without those of its credential values."""
    low = text.lower()
    if any(h in low for h in CONTEXT_HINTS):
        spans = sorted([m.span(1) for m in CONTEXT.finditer(text)] + [m.span(2) for m in ASSIGN.finditer(text)])
        kept, at = [], 0
        for a, z in spans:
            kept.append(text[at : max(a, at)])
            at = max(at, z)
        low = " ".join([*kept, text[at:]]).lower()
    return {w for w in WORD.findall(low) if len(w) <= LONGEST_WORD}


def _count_words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(text_words(text.as_py()))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
    yield out()


def guess_costs(values: DataFrame, docs: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """value and its cost, of distinct values. Words are ranked among all words of the documents (doc_id, text); those
    of equal counts share the last of their places. The places of a value's own words, no others, are joined to it."""
    keyed = values.select("value", F.xxhash64("value").alias("key"))  # values that share a key only get words they lack

    def inside(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, value in zip(batch.column("key"), batch.column("value")):
                words = pieces(value.as_py())
                while some := list(islice(words, 1 << 16)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(some), pa.int64()), pa.array(some, pa.string())], ["key", "word"])

    def cost(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common = _ranks(tuple(COMMON))[0]
        for batch in batches:
            costs = []
            for value, words in zip(batch.column("value"), batch.column("words")):
                ranks = dict(common)
                for w in words.as_py() or []:
                    ranks[w["word"]] = min(w["place"], ranks.get(w["word"], w["place"]))
                costs.append(judge(value.as_py(), least, (ranks, max(map(len, ranks)))))
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(costs, pa.float64())], ["value", "cost"])

    counted = save(docs.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS))
    # As many rows as there are different counts.
    places = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("place"))
    own = keyed.mapInArrow(inside, "key long, word string").distinct().join(counted, "word").join(places, "n")
    own = own.groupBy("key").agg(F.collect_list(F.struct("word", "place")).alias("words"))
    out = save(keyed.join(own, "key", "left").select("value", "words").mapInArrow(cost, "value string, cost double"))
    discard(counted)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COST) -> DataFrame:
    """doc_id and its spans (kind, start, end, log10 guesses of the added ones).

    One pass finds base spans and candidate values; only if there are any are words counted, in a second pass, and
    the distinct values judged.
    """
    rows = id_text(docs, id_col, text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = [("start", pa.int64()), ("place", pa.int64()), ("end", pa.int64())]
        spans_of, values_of = pa.list_(pa.struct([*span, ("cost", pa.float64())])), pa.list_(pa.struct([*span, ("value", pa.string())]))
        for batch in batches:
            for a, z in slices(batch.column(1)):
                spans, values = [], []
                for text in batch.column(1).slice(a, z - a):
                    text = text.as_py()
                    base = base_spans(text)
                    spans.append([{"start": s, "place": KINDS.index(k), "end": e, "cost": None} for k, s, e in base])
                    values.append([{"start": s, "place": KINDS.index("guess"), "end": e, "value": text[s:e]} for s, e in candidates(text, base)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(spans, spans_of), pa.array(values, values_of)], ["doc_id", "spans", "values"])

    span = "start:long,place:long,end:long"
    found = rows.mapInArrow(run, f"doc_id long, spans array<struct<{span},cost:double>>, values array<struct<{span},value:string>>")
    found = save(found.withColumn("row", F.monotonically_increasing_id()))
    asked = found.select("row", F.explode("values").alias("v")).select("row", "v.*")
    values = save(asked.select("value").distinct())
    spans = F.col("spans")
    if not values.isEmpty():
        costs = guess_costs(values, rows, least).filter(F.col("cost") >= least)
        added = asked.join(costs, "value").groupBy("row").agg(F.collect_list(F.struct("start", "place", "end", "cost")).alias("added"))
        found = found.join(added, "row", "left")
        spans = F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(f"array<struct<{span},cost:double>>"))))
    discard(values)
    kind = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(spans, lambda s: F.struct(F.get(kind, s["place"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["cost"].alias("cost"))).alias("spans"))
