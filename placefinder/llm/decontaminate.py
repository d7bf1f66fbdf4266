"""Operator 5: benchmark decontamination with suffix arrays.

Each shard of the training texts (a run of whole documents) is turned into word numbers and its
suffixes are sorted by their first ``WINDOW`` words, which is as deep as a search looks. The suffixes
of the test items are located in that array by binary search: the run of shard suffixes that begin
with a test suffix's window gives all places of the window, and every match is then followed word by
word to its end, which gives the longest verbatim match of each item and where it lies. Two exact
short cuts keep the work in step with what is found: a shard suffix whose first two words never
follow each other in a test item is left out of the array, and only test suffixes whose first two
words follow each other in the shard are searched for.

Words are compared by 64-bit hashes; for n different words the chance that any two of them share one
is under n^2 / 2^65 (3e-6 for ten million).

Test items are taken in blocks of at most ``block_words`` words; only one block is held at a time, so
what is sent to executors has a fixed bound however many items there are.

Edge cases: null texts have no words; an item without words has no window; an item of fewer words
than a window is one window of its own length; repeated item ids count once and are hit if any of
their texts is; a null item_id is left out; a null doc_id keeps its own row; repeated document rows
give repeated results; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import discard, save
from .shared import ALNUM_BREAKS, FEW_IDS, filter_texts, id_text, row_hash, slices, small_batches, text_bytes, word_hashes

WINDOW = 10
#: Test words per block: the bound on what is broadcast (some 50 bytes a word) and on what a worker makes of it (40).
BLOCK_WORDS = 1_000_000
#: Bytes of text in a shard, unless one text is longer.
SHARD_BYTES = 4 << 20


class TestSuffixes:
    """The suffixes of one block of test items, as numbers of a vocabulary of test words."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        import pyarrow as pa

        self.window = window
        self.ids = [i for i, _ in items]
        words, _, first = word_hashes(*text_bytes(pa.array([t for _, t in items], pa.large_string())), ALNUM_BREAKS)
        self.vocab = np.unique(words)
        numbers = np.searchsorted(self.vocab, words).astype(np.int64) + 1
        #: Items end to end, each closed by zeros, which no training word is equal to.
        self.text = np.zeros(len(numbers) + len(items) + window, dtype=np.int64)
        starts, owner, length = [], [], []
        at = 0
        for n, (a, z) in enumerate(zip(first[:-1], first[1:])):
            self.text[at : at + z - a] = numbers[a:z]
            count = int(z - a) - window + 1 if z - a >= window else int(z > a)
            for i in range(count):
                starts.append(at + i)
                owner.append(n)
                length.append(min(window, int(z - a)))
            at += int(z - a) + 1
        self.starts, self.owner, self.length = (np.array(x, dtype=np.int64) for x in (starts, owner, length))
        follows = (self.text[:-1] << 32) | self.text[1:]
        self.pairs = np.unique(follows[(self.text[:-1] > 0) & (self.text[1:] > 0)])
        single = self.length == 1
        self.singles = np.unique(self.text[self.starts[single]])
        # Suffixes in the order of their first pair, and where each pair's begin; those of one word come last.
        pair = np.where(single, len(self.pairs), np.searchsorted(self.pairs, follows[self.starts]))
        order = np.argsort(pair, kind="stable")
        self.starts, self.owner, self.length = self.starts[order], self.owner[order], self.length[order]
        self.pair_begins = np.searchsorted(pair[order], np.arange(len(self.pairs) + 2))
        self.item_begins = np.concatenate(([0], np.cumsum(np.diff(first) + 1)))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest key that begins with each suffix's window; made once in each worker."""
        if not hasattr(self, "_bounds"):
            low = self.text[self.starts[:, None] + np.arange(self.window)].astype(">u4")
            beyond = np.arange(self.window) >= self.length[:, None]
            low[beyond] = 0
            short = self.length < self.window
            high = low[short]
            high[beyond[short]] = 0xFFFFFFFF
            as_key = lambda x: np.ascontiguousarray(x).view(f"S{4 * self.window}").ravel()
            low_key = as_key(low)
            high_key = low_key
            if short.any():
                high_key = low_key.copy()
                high_key[short] = as_key(high)
            self._bounds = low_key, high_key
        return self._bounds

    def keys(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A suffix's first words as bytes that sort as the words do."""
        wide = text[at[:, None] + np.arange(self.window)].astype(">u4")
        return np.ascontiguousarray(wide).view(f"S{4 * self.window}").ravel()

    def number(self, words: np.ndarray) -> np.ndarray:
        """Training words as test word numbers; others become one number that no test word has."""
        if not len(self.vocab):
            return np.full(len(words), 1, dtype=np.int64)
        near = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[near] == words, near + 1, len(self.vocab) + 1)


class Shard:
    """The suffix array of a run of documents."""

    def __init__(self, tests: TestSuffixes, data: np.ndarray, bounds: np.ndarray):
        words, _, self.first = word_hashes(data, bounds, ALNUM_BREAKS)
        self.tests, self.data, self.bounds = tests, data, bounds
        docs = len(bounds) - 1
        #: Words of all documents, each document closed by one more number, and room at the end.
        gap = np.arange(docs + 1)
        self.text = np.full(len(words) + docs + tests.window, len(tests.vocab) + 2, dtype=np.int64)
        self.begin = self.first + gap
        owner = np.repeat(np.arange(docs), np.diff(self.first))
        self.text[np.arange(len(words)) + owner] = tests.number(words)
        follows = (self.text[:-1] << 32) | self.text[1:]
        keep = np.zeros(len(self.text), dtype=bool)
        self.present = np.zeros(0, dtype=np.int64)
        if len(tests.pairs):
            near = np.minimum(np.searchsorted(tests.pairs, follows), len(tests.pairs) - 1)
            keep[:-1] = tests.pairs[near] == follows
            self.present = np.unique(near[keep[:-1]])
        if len(tests.singles):
            keep |= np.isin(self.text, tests.singles)
        at = np.flatnonzero(keep[: len(self.text) - tests.window])
        keys = tests.keys(self.text, at)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of a test suffix, place in the shard) of every occurrence of a window."""
        tests = self.tests
        if not len(self.suffixes) or not len(tests.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = tests.pair_begins
        first, size = begins[self.present], begins[self.present + 1] - begins[self.present]
        ones = np.arange(begins[-2], begins[-1])
        asked = np.concatenate((np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum()), ones))
        low_key, high_key = tests.bounds()
        low = np.searchsorted(self.keys, low_key[asked], side="left")
        high = np.searchsorted(self.keys, high_key[asked], side="right")
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return asked[which], self.suffixes[low[which] + within]

    def extend(self, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many words each match goes on for, verbatim."""
        tests = self.tests
        length = tests.length[which].copy()
        live = np.arange(len(which))
        while len(live):
            a = tests.starts[which[live]] + length[live]
            b = at[live] + length[live]
            inside = (a < len(tests.text)) & (b < len(self.text))
            live, a, b = live[inside], a[inside], b[inside]
            same = tests.text[a] == self.text[b]
            live = live[same]
            length[live] += 1
        return length


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str]]]:
    """The test items in blocks of at most about ``block_words`` words, one block at a time on the driver.

    Rows are streamed partition by partition, so the driver never holds all of a large benchmark.
    """
    items = benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("i IS NOT NULL")
    block: list[tuple[object, str]] = []
    held = 0
    for row in items.toLocalIterator():
        size = len(row.t) // 2 + 1  # a word and its gap take two characters at least
        if block and held + size > block_words:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += size
    if block:
        yield block


def _spans(hit: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.tolist()


def find_matches(docs: DataFrame, items: list[tuple[object, str]], window: int = WINDOW) -> DataFrame:
    """For each document: n_words, the hit words as span edges, the items that occur, and for
    each such item its longest verbatim match (item, words, place in the document, place in the item)."""
    tests = TestSuffixes(items, window)
    sent = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tests = sent.value
        for batch in batches:
            for a, z in slices(batch.column(1), SHARD_BYTES, 4096):
                shard = Shard(tests, *text_bytes(batch.column(1).slice(a, z - a)))
                which, at = shard.matches()
                owner = np.searchsorted(shard.begin, at, side="right") - 1
                order = np.argsort(owner, kind="stable")
                which, at, owner = which[order], at[order], owner[order]
                edges = np.searchsorted(owner, np.arange(z - a + 1))
                data, bounds = shard.data, shard.bounds
                keys = [int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little", signed=True) for x, y in zip(bounds[:-1], bounds[1:])]
                spans: list[list[int]] = []
                found: list[list[str]] = []
                best: list[list[dict]] = []
                for d in range(z - a):
                    w, p = which[edges[d] : edges[d + 1]], at[edges[d] : edges[d + 1]]
                    if not len(w):
                        spans.append([])
                        found.append([])
                        best.append([])
                        continue
                    size = int(shard.first[d + 1] - shard.first[d])
                    p = p - shard.begin[d]
                    step = np.zeros(size + 1, dtype=np.int64)
                    np.add.at(step, p, 1)
                    np.add.at(step, p + tests.length[w], -1)
                    spans.append(_spans(np.cumsum(step[:-1]) > 0))
                    found.append(sorted({str(tests.ids[i]) for i in np.unique(tests.owner[w])}))
                    length = shard.extend(w, p + shard.begin[d])
                    top: dict[str, dict] = {}
                    for i in np.lexsort((tests.starts[w], p, -length)):
                        name = str(tests.ids[tests.owner[w[i]]])
                        if name not in top:
                            start = int(tests.item_begins[tests.owner[w[i]]])
                            top[name] = {"item_id": name, "words": int(length[i]), "doc_word": int(p[i]), "item_word": int(tests.starts[w[i]] - start)}
                    best.append([top[k] for k in sorted(top)])
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(keys, pa.int64()), pa.array(np.diff(shard.first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string())), pa.array(best, kind)],
                    ["doc_id", "text_key", "n_words", "edges", "items", "matches"],
                )

    schema = "doc_id long, text_key long, n_words long, edges array<long>, items array<string>, matches array<struct<item_id:string,words:long,doc_word:long,item_word:long>>"
    return docs.mapInArrow(run, schema)


def _merge(batches: Iterator) -> Iterator:
    """Union of the span edges and items that several blocks found in a document, and its longest match."""
    import pyarrow as pa

    for batch in batches:
        edges_of, items_of = batch.column("edges").to_pylist(), batch.column("items").to_pylist()
        hits, counts, digests = [], [], []
        for edges, items in zip(edges_of, items_of):
            total, end = 0, -1
            for a, z in sorted((e[i], e[i + 1]) for e in edges for i in range(0, len(e), 2)):
                total += max(0, z - max(a, end))
                end = max(end, z)
            names = sorted({name for group in items for name in group})
            hits.append(total)
            counts.append(len(names))
            digests.append(hashlib.sha256(",".join(names).encode("utf-8")).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), batch.column("longest")],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of its longest
    verbatim match with an item, 0 without one; :func:`longest_matches` has them all, with their places).

    With one block of test items there is no shuffle at all. With more, each block's finds are saved
    and only documents that were hit are regrouped, by id and a hash of the text.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
    base = id_text(docs, id_col, text_col)
    blocks = item_blocks(benchmark, item_id, item_text, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long").alias("longest")
    finds = lambda block: find_matches(base, block, window).select("doc_id", "text_key", "n_words", "edges", "items", longest)
    if second is None:
        return finds(first).select("doc_id", "n_words", F.array("edges").alias("edges"), F.array("items").alias("items"), "longest").mapInArrow(_merge, schema)
    key = ["doc_id", "text_key", "n_words"]
    tables = [save(finds(first))]
    for block in chain([second], blocks):
        tables.append(save(finds(block).filter("size(edges) > 0")))
    found = tables[0].filter("size(edges) > 0")
    for more in tables[1:]:
        found = found.unionByName(more)
    merged = found.groupBy(*key).agg(F.collect_set("edges").alias("all_edges"), F.collect_set("items").alias("all_items"), F.max("longest").alias("most"))
    same = reduce(and_, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key))
    rows = tables[0].alias("l").join(merged.alias("r"), same, "left")
    edges = F.coalesce("all_edges", F.array().cast("array<array<long>>")).alias("edges")
    items = F.coalesce("all_items", F.array().cast("array<array<string>>")).alias("items")
    return rows.select("l.doc_id", "l.n_words", edges, items, F.coalesce("most", F.lit(0)).cast("long").alias("longest")).mapInArrow(_merge, schema)


def _hits(tests: TestSuffixes, texts) -> np.ndarray:
    """Which texts share a window with a test item."""
    shard = Shard(tests, *text_bytes(texts))
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(shard.begin, shard.matches()[1], side="right") - 1] = True
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, all columns, without those that share a window with an item.

    One block of test items is one pass without a shuffle. Of more blocks, each makes a pass of its own over the
    documents and saves the hashes of the rows it hits, which are taken out together in the end: however many blocks there are, a task runs one Python stage and holds one block.
    """
    blocks = item_blocks(benchmark, item_id, item_text, block_words)
    first = next(blocks, None)
    if first is None:
        return docs
    second = next(blocks, None)
    send = lambda block: docs.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))
    if second is None:
        sent = send(first)
        return filter_texts(docs, lambda: lambda texts: ~_hits(sent.value, texts), text_col)

    hashed = small_batches(docs).select(row_hash(docs).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = []
    for block in chain([first, second], blocks):
        sent = send(block)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for a, z in slices(batch.column(1), SHARD_BYTES, 4096):
                    part = batch.slice(a, z - a)
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(_hits(sent.value, part.column(1))))], ["row"])

        found.append(save(hashed.mapInArrow(run, "row long")))
        sent.unpersist()
    hit = save(reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("row", "_hit"))
    discard(*found)
    # Rows of equal hashes are alike in every column, so in their text too.
    return docs.join(F.broadcast(hit) if hit.count() <= FEW_IDS else hit, row_hash(docs) == hit["_hit"], "left_anti")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item that share a window: the longest verbatim match and its places. The finds of each
    block of test items are saved."""
    base = id_text(docs, id_col, text_col)
    find = lambda block: find_matches(base, block, window).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    parts = [save(find(block)) for block in item_blocks(benchmark, item_id, item_text, block_words)]
    return reduce(DataFrame.unionByName, parts) if parts else base.sparkSession.createDataFrame([], "doc_id long, item_id string, words long, doc_word long, item_word long")
