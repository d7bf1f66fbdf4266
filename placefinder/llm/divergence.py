"""Operator 12: how the sources of each language differ in their words.

Texts are cut into terms without decoding them: a table of 256 entries, applied to the UTF-8 bytes of many
texts laid end to end, folds letters and marks what parts terms. Slices are grouped by a 64-bit hash, and
each slice is compared byte for byte with the first of its group, so equal hashes of different terms do no
harm. Tasks add up their counts before anything is shuffled; from then on terms travel as themselves.

Kept terms (in at least ``LEAST_DOCS`` documents of a language) are dealt to blocks by hash. A block is a
sparse matrix of sources and terms; what a pair of sources differs by is the difference of two absent terms,
times the number of terms, plus corrections at the entries either of them has, summed row by row with
``reduceat``. Smoothed shares are integers in units of 1e-9, so all sums are exact.

Edge cases: null texts, languages and sources count as empty; a source without terms is a group like others, and
where no term of a language is kept all its sources differ by 0; every row is a document, repeated ones too; an empty
table gives an empty result; a term may be as long as a text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import discard, save
from .shared import slices, small_batches, text_bytes

LEAST_DOCS, SMOOTHING, UNIT, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Bytes that are tokenised at once; entries and terms a task adds up before it hands them on; entries of a block.
PIECE, HELD_ENTRIES, HELD_TERMS, BLOCK_ENTRIES = 1 << 20, 1 << 20, 300_000, 250_000
#: Up to so many groups are broadcast (a few MB); more are joined by shuffle.
FEW_GROUPS = 50_000

#: What each byte counts as: A-Z as a-z, all other ASCII but letters as 0, which parts terms.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x80] = 0
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def find_terms(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Folded bytes, starts and ends of the terms of texts laid end to end (text i: bounds[i]..bounds[i+1]), piece by
    piece; starts and ends count from the piece, whose own place comes last. Pieces end where a term does."""
    at, n = 0, len(data)
    while at < n:
        end = _term_end(data, bounds, at + PIECE)
        low = FOLD[data[at:end]]
        edge = np.zeros(len(low) + 1, dtype=bool)
        inner = bounds[(bounds >= at) & (bounds <= at + len(low))] - at
        edge[inner] = True
        inside = low != 0
        left, right = edge[:-1].copy(), edge[1:].copy()
        left[0] = right[-1] = True
        left[1:] |= ~inside[:-1]
        right[:-1] |= ~inside[1:]
        yield low, np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1, at
        at = end


def _term_end(data: np.ndarray, bounds: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that no term crosses."""
    most = int(bounds[min(np.searchsorted(bounds, at), len(bounds) - 1)])
    while at < most:
        breaks = np.flatnonzero(FOLD[data[at : min(most, at + PIECE)]] == 0)
        if len(breaks):
            return at + int(breaks[0])
        at = min(most, at + PIECE)
    return most


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms by number. Slices of one hash are compared with the first of them
    byte for byte; those that differ are told apart by their bytes."""
    from xxhash import xxh3_64_intdigest

    digest = digest or xxh3_64_intdigest
    raw = data.tobytes()
    view = memoryview(raw)
    hashes = np.fromiter((digest(view[a:z]) for a, z in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [raw[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())]
    sizes = ends - starts
    like = first[number]
    differs = sizes != sizes[like]
    sizes_in_both = np.where(differs, 0, sizes)
    at = np.cumsum(sizes_in_both) - sizes_in_both
    steps = np.arange(int(sizes_in_both.sum())) - np.repeat(at, sizes_in_both)
    unequal = data[np.repeat(starts, sizes_in_both) + steps] != data[np.repeat(starts[like], sizes_in_both) + steps]
    if unequal.any():
        differs |= np.add.reduceat(np.append(unequal, False).astype(np.int64), at) * (sizes_in_both > 0) > 0
    if differs.any():
        numbers = {t: i for i, t in enumerate(terms)}
        for i in np.flatnonzero(differs).tolist():
            number[i] = numbers.setdefault(raw[starts[i] : ends[i]], len(numbers))
        terms = list(numbers)
    return number, terms


def _add_up(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each count over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts)


class _Counts:
    """What a task has counted: occurrences and documents by group and term."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, column, langs: list[str], sources: list[str]) -> None:
        data, bounds = text_bytes(column)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], dtype=np.int64)
        keys = []
        for low, starts, ends, at in find_terms(data, bounds):
            number, terms = group_slices(low, starts, ends)
            mine = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], dtype=np.int64)
            owner = np.searchsorted(bounds, starts + at, side="right") - 1
            keys.append(_add_up(owner << 32 | mine[number], np.ones(len(starts), np.int64)))
        if keys:
            # Of a text of several pieces a term is one document's all the same.
            key, n = _add_up(np.concatenate([k for k, _ in keys]), np.concatenate([n for _, n in keys]))
            self.parts.append(_add_up(group[key >> 32] << 32 | (key & 0xFFFFFFFF), n, np.ones(len(n), np.int64)))
            self.size += len(self.parts[-1][0])

    def settle(self) -> bool:
        """Add up what has come together, if that is much; whether it is still too much to hold."""
        if self.size > 2 * HELD_ENTRIES:
            self.parts = [_add_up(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = len(self.parts[0][0])
            return self.size > HELD_ENTRIES
        return len(self.terms) > HELD_TERMS

    def rows(self) -> Iterator:
        """Each group once with an empty term, and the counts."""
        import pyarrow as pa

        names = ["lang", "source", "term", "n", "docs"]
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        none = pa.array(np.zeros(len(self.groups), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(self.groups), pa.string()), none, none], names)
        if self.parts:
            key, n, docs = _add_up(*(np.concatenate(x) for x in zip(*self.parts)))
            terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
            for a in range(0, len(key), 1 << 16):
                some = slice(a, a + (1 << 16))
                group = pa.array(key[some] >> 32)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(pa.array(key[some] & 0xFFFFFFFF)), pa.array(n[some]), pa.array(docs[some])], names)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it); each group has a row of the empty term."""

    def run(batches: Iterator) -> Iterator:
        held = _Counts()
        for batch in batches:
            for a, z in slices(batch.column(0)):
                text, langs, sources = (batch.column(i).slice(a, z - a) for i in range(3))
                held.add(text, langs.to_pylist(), sources.to_pylist())
                if held.settle():
                    yield from held.rows()
                    held = _Counts()
        yield from held.rows()

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    counted = small_batches(docs).select(*filled).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (n + SMOOTHING) / (total + SMOOTHING terms)), exactly; null where there is no term."""
    wide = (n + F.lit(SMOOTHING)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    whole = F.call_function("div", wide, (total + F.lit(SMOOTHING) * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, F.lit(1) + whole)


def block_sums(p: np.ndarray, row: np.ndarray, col: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corrections of a block: for entries p at (source ``row``, term ``col``) and shares of absent terms by source, the
    sums over the terms that either source of a pair has of |p - p'| less the difference of two absent terms.

    Returns the lesser source, the greater and the sum, for all pairs with an entry.
    """
    order = np.lexsort((col, row))
    p, row, col = p[order], row[order], col[order]
    have, begin = np.unique(row, return_index=True)  # rows of the matrix that have entries, and where each starts
    width = int(col.max(initial=-1)) + 1
    out = []
    for other in range(len(absent)):
        dense = np.full(width, absent[other])
        k = np.searchsorted(have, other)
        mine = slice(begin[k], begin[k + 1] if k + 1 < len(have) else len(p)) if k < len(have) and have[k] == other else slice(0, 0)
        dense[col[mine]] = p[mine]
        has = np.zeros(width, dtype=bool)
        has[col[mine]] = True
        change = np.abs(p - dense[col]) - np.abs(absent[row] - absent[other])
        # An entry that both have is met from both sides and counts from the greater one.
        change = np.where(has[col] & (row < other), 0, change)
        out.append(np.add.reduceat(change, begin) if len(begin) else np.zeros(0, np.int64))
    one, two = np.meshgrid(have, np.arange(len(absent)))
    value = np.array(out, dtype=np.int64).reshape(one.shape)
    key, value = _add_up((np.minimum(one, two) * len(absent) + np.maximum(one, two)).ravel(), value.ravel())
    a, b = np.divmod(key, len(absent))
    return a[a < b], b[a < b], value[a < b]


def _pair_sums(entries: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """lang, one, two (sources, one < two) and the sum of all blocks' corrections."""

    def run(key, left, right):
        import pyarrow as pa

        place = {s: i for i, s in enumerate(sorted(right.column("source").to_pylist()))}
        absent = np.zeros(len(place), np.int64)
        absent[[place[s] for s in right.column("source").to_pylist()]] = right.column("absent").to_numpy()
        if len(left):
            row = np.array([place[s] for s in left.column("source").to_pylist()], np.int64)
            col = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            a, b, value = block_sums(left.column("p").to_numpy(), row, col, absent)
        else:
            a = b = value = np.zeros(0, np.int64)
        names = pa.array(sorted(place), pa.string())
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "one": names.take(pa.array(a)), "two": names.take(pa.array(b)), "value": pa.array(value)})

    dealt = entries.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "source", "term", "p").groupBy("lang", "block")
    all_groups = groups.filter("terms > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "source", "absent").groupBy("lang", "block")
    return dealt.cogroup(all_groups).applyInArrow(run, "lang string, one string, two string, value long").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: for each group every other source of its language by the sum of
    differences (part ``pair``), and the ``MOST_TERMS`` terms it has more of than its language (part ``term``)."""
    counts = save(term_counts(docs, text_col, lang_col, source_col))
    same_term = Window.partitionBy("lang", "term")
    kept = (
        counts.filter("term <> ''")
        .withColumns({"in_docs": F.sum("docs").over(same_term), "m": F.sum("n").over(same_term), "place": F.row_number().over(same_term.orderBy("source"))})
        .filter(F.col("in_docs") >= LEAST_DOCS)
        .select("lang", "source", "term", "n", "m", (F.col("place") == 1).cast("long").alias("first"))
    )
    kept = save(kept)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"), F.count(F.lit(1)).alias("entries"))
    whole = Window.partitionBy("lang")
    found = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total", "firsts", "entries"])
    groups = found.withColumns({"terms": F.sum("firsts").over(whole), "lang_total": F.sum("total").over(whole)})
    groups = save(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("terms"))))
    discard(counts)
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries")).first()
    few = F.broadcast(groups) if size["groups"] <= FEW_GROUPS else groups
    entries = kept.join(few, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("m"), F.col("lang_total"), F.col("terms"))})

    per_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = more.withColumn("rank", F.row_number().over(per_group)).filter(F.col("rank") <= MOST_TERMS)

    sums = _pair_sums(entries, groups, size["entries"] // BLOCK_ENTRIES + 1)
    both = sums.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").union(sums.select("lang", F.col("two"), F.col("one"), "value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other_absent"))
    pairs = (
        groups.select("lang", "source", "terms", "absent").join(other, "lang").filter("source <> item").join(both, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("absent") - F.col("other_absent")) + F.coalesce("value", F.lit(0))).otherwise(F.lit(0)).alias("value"))
        .withColumn("rank", F.row_number().over(per_group))
    )
    return pairs.unionByName(top)
