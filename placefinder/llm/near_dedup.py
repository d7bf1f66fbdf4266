"""Operator 4: near-duplicate detection with fast similarity sketching.

A sketch has ``COORDINATES`` bins. In round i every shingle is hashed into a bin; a bin that was
empty before the round takes the smallest hash it receives. After as many rounds as there are bins,
round COORDINATES + i offers every shingle to bin i, so every coordinate is filled however small the
set is. Two sets agree in a coordinate with a probability equal to their similarity, and the share of
agreeing coordinates concentrates as if they were drawn without replacement.

Sketches are cut in bands of ``ROWS`` coordinates; documents that share a band are candidates, which
are confirmed on their full shingle sets. Sets linked at exactly 0.75 share no band with a
probability of 5e-6, and the estimate that spares hopeless pairs the exact test (share of agreeing
coordinates under ``LEAST_ESTIMATE``) loses such a pair with a probability under 1e-6.

Large buckets: identical sets are one class before anything else. Then each bucket's smallest member
is compared with all others, and linked classes are merged. Only buckets that still hold several
unlinked classes go on: their members are compared in blocks, inside tasks, by their sketches. Twice
each class names its likeliest partner, which is confirmed and merged; then all likely pairs that are
left are confirmed on full sets inside tasks, which return links alone. No bucket is cut short, no
pair of one class is compared and no pairs of a group are listed.

A shingle stands in its set by a 64-bit hash. For two sets of m and n shingles the chance that a pair
of different shingles counts as one is m * n / 2^64: 2e-11 for two texts of 20,000 words.

Edge cases: null or blank texts have an empty set, are linked with nothing and stay; fewer words than
k make one shingle; a null doc_id is linked with nothing, has a null component and stays; repeated
rows share a set and so a class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.tables import discard, save
from .shared import FEW_IDS, id_text, mix, row_hash, shingle_sets, slices, text_bytes, without_rows

COORDINATES, ROWS = 128, 4
LEAST_ESTIMATE = 0.55
#: Members of a bucket that are compared with as many others in one task, and how many shingles these have together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Shares that the partners of one document are dealt to.
SALTS = 256
_BITS = np.uint64(64 - COORDINATES.bit_length() + 1)
_SEEDS = np.random.default_rng(0xFA57).integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64) | np.uint64(1)
_BAND = np.random.default_rng(0xBA2D).integers(1, 2**63, (COORDINATES // ROWS, ROWS), dtype=np.uint64) | np.uint64(1)
_EDGES = np.arange(COORDINATES, dtype=np.uint64) << _BITS


def sketch(elements: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.zeros(COORDINATES, dtype=np.uint64)
    empty = np.ones(COORDINATES, dtype=bool)
    for i in range(COORDINATES):
        thrown = np.sort(mix(elements * _SEEDS[i] + _SEEDS[i]))
        at = np.searchsorted(thrown, _EDGES)
        found = np.minimum(at, len(thrown) - 1)
        fits = empty & (at < len(thrown)) & ((thrown[found] >> _BITS) == (_EDGES >> _BITS))
        out[fits] = thrown[found[fits]]
        empty &= ~fits
        if not empty.any():
            return out
    for i in np.flatnonzero(empty):
        seed = _SEEDS[COORDINATES + i]
        out[i] = mix(elements * seed + seed).min()
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One key for each band of a sketch."""
    rows = coordinates.reshape(-1, ROWS)
    keys = (rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64)
    return mix(keys)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n (set size), digest of the set, band keys, and a byte of each sketch coordinate."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, z in slices(batch.column(1)):
                digests, keys, marks, sizes = [], [], [], []
                for found in shingle_sets(*text_bytes(batch.column(1).slice(a, z - a)), k):
                    sizes.append(len(found))
                    if len(found):
                        drawn = sketch(found)
                        digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        keys.append(bands(drawn).view(np.int64))
                        marks.append((drawn & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    else:
                        digests.append(None)
                        keys.append(None)
                        marks.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    ["doc_id", "n", "digest", "bands", "marks"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>, marks binary")


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, marks_a, marks_b) whose estimated similarity is not hopeless."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for c in ("marks_a", "marks_b"))
                good = (one == two).sum(axis=1) >= LEAST_ESTIMATE * COORDINATES
                import pyarrow as pa

                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "a long, b long")


def _sets_of(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """rep and its shingle set (sorted 64-bit hashes, as bytes) for the ``ids`` (one column), one row each, saved.

    The only time that whole texts are looked up: all later stages send and compare sets.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, z in slices(batch.column(1)):
                found = shingle_sets(*text_bytes(batch.column(1).slice(a, z - a)), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([x.tobytes() for x in found], pa.binary())], ["rep", "elements"])

    needed = save(ids.select(ids[0].alias("doc_id")).distinct())
    few = needed.count() <= FEW_IDS
    held = save(texts.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi").mapInArrow(run, "rep long, elements binary"))
    discard(needed)
    if held.groupBy("rep").count().filter("count > 1").isEmpty():
        return held
    once = save(held.dropDuplicates(["rep"]))
    discard(held)
    return once


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those pairs whose full shingle sets are similar enough.

    For each a, and each of up to ``SALTS`` shares of its partners, a's set comes first and the partners'
    follow; a task holds one set and a batch, however many partners an a has.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            good = []
            for b, held in zip(batch.column(2), batch.column(3)):
                other = np.frombuffer(held.as_buffer(), dtype=np.uint64)
                if b.is_valid:
                    good.append(similar(own, other, percent))
                else:
                    own = other.copy()
                    good.append(False)
            yield batch.select([0, 2]).filter(pa.array(good, pa.bool_()))

    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    first = dealt.select("a", "salt").distinct().join(sets.withColumnRenamed("rep", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "elements")
    rows = dealt.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "salt", "b", "elements").unionByName(first)
    return save(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(run, "a long, b long"))


def _by_group(rows: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` (Arrow table of one group -> record batches) for every group of rows, a group at a time."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        last = None
        for batch in batches:
            found = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            start = 0
            for at in range(1, len(found) + 1):
                if at == len(found) or found[at] != found[start]:
                    if held and last != found[start]:
                        yield from work(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    held.append(batch.slice(start, at - start))
                    last, start = found[start], at
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, schema)


class _Block:
    """Members of a bucket in two blocks, to be compared block against block."""

    def __init__(self, rows, percent: int):
        self.ids, self.n, self.component, own = (rows.column(c).to_numpy() for c in ("rep", "n", "component", "own"))
        self.marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
        self.i, self.j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        self.left, self.right, self.percent = np.flatnonzero(own == self.i), np.flatnonzero(own == self.j), percent

    def likely(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(x, partners, agreeing coordinates): partners of other components that x may be linked with."""
        for x in self.left:
            y = self.right[self.component[self.right] != self.component[x]]
            if self.i == self.j:
                y = y[self.ids[y] > self.ids[x]]
            y = y[100 * np.minimum(self.n[y], self.n[x]) >= self.percent * np.maximum(self.n[y], self.n[x])]
            if len(y):
                share = (self.marks[y] == self.marks[x]).sum(axis=1)
                good = share >= LEAST_ESTIMATE * COORDINATES
                if good.any():
                    yield x, y[good], share[good]


def _blocks(members: DataFrame) -> DataFrame:
    """Members (bucket, size, total, rep, n, component, marks) once for each pair of blocks that theirs is in. A block
    has about ``BLOCK`` members, or fewer where their sets hold more than ``BLOCK_SHINGLES`` together."""
    count = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    spread = members.withColumn("own", F.pmod(F.xxhash64("rep"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "component", "marks")


def _best_partners(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each component its likeliest pair with another one. A task returns one row a component at most."""

    def work(rows) -> Iterator:
        import pyarrow as pa

        block = _Block(rows, percent)
        # Of every member its best share, and with whom.
        top, partner = np.zeros(len(block.ids), dtype=np.int64), np.zeros(len(block.ids), dtype=np.int64)
        for x, partners, share in block.likely():
            better = share > top[partners]
            top[partners[better]], partner[partners[better]] = share[better], x
            at = int(np.argmax(share))
            if share[at] > top[x]:
                top[x], partner[x] = share[at], partners[at]
        order = np.lexsort((block.ids, -top, block.component))
        order = order[top[order] > 0]
        if len(order):
            of = block.component[order]
            order = order[np.concatenate(([True], of[1:] != of[:-1]))]
            one, two = block.ids[order], block.ids[partner[order]]
            columns = block.component[order], top[order], np.minimum(one, two), np.maximum(one, two)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["component", "share", "a", "b"])

    found = _by_group(_blocks(members), ["bucket", "i", "j"], work, "component long, share long, a long, b long")
    return found.groupBy("component").agg(F.max(F.struct("share", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def _remaining_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components, found by comparing in full all likely pairs that are left.

    A first pass names the members that have a likely partner in their blocks; their sets are brought
    there, and pairs are confirmed inside the task, which returns only links that join what it has not
    joined yet.
    """

    def flag(rows) -> Iterator:
        block = _Block(rows, percent)
        wanted = np.zeros(rows.num_rows, dtype=bool)
        for x, partners, _ in block.likely():
            wanted[x] = True
            wanted[partners] = True
        if wanted.any():
            import pyarrow as pa

            yield from rows.filter(pa.array(wanted)).to_batches()

    def confirm(rows) -> Iterator:
        import pyarrow as pa

        block = _Block(rows, percent)
        held = rows.column("elements")
        set_of = lambda at: np.frombuffer(held[int(at)].as_buffer(), dtype=np.uint64)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out = []
        for x, partners, share in block.likely():
            for y in partners[np.argsort(-share, kind="stable")]:
                one, two = root(int(block.component[x])), root(int(block.component[y]))
                if one != two and similar(set_of(x), set_of(y), percent):
                    parent[one] = two
                    out.append((int(block.ids[x]), int(block.ids[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    schema = "bucket long, i int, j int, own int, rep long, n long, component long, marks binary"
    keys = ["bucket", "i", "j"]
    flagged = save(_by_group(_blocks(members), keys, flag, schema))
    found = save(_by_group(flagged.join(sets, "rep"), keys, confirm, "a long, b long"))
    discard(flagged)
    return found


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the links ``found`` (a, b): only the components that they join are looked at."""
    side = lambda s: labels.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    joined = found.join(side("a"), "a", "left").join(side("b"), "b", "left")
    moved = connected_components(joined.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    old = labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = save(old.select("node", F.coalesce("to", "component").alias("component")).unionByName(moved.join(labels, "node", "left_anti")))
    discard(labels, moved)
    return new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = id_text(docs, id_col, text_col)
    signed = save(signatures(texts, k))
    sets = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = save(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")))

    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    pivots = save(banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1"))
    members = save(banded.join(pivots, "bucket"))
    elements = _sets_of(members.select("rep"), texts, k)
    ratio = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("marks_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("marks_b"))
    stars = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    tried = save(_likely(stars.join(right, "b").join(left, "a").filter(ratio).select("a", "b", "marks_a", "marks_b")))
    links = _verify(tried, elements, percent)
    labels = connected_components(links)
    discard(pivots, tried, links)

    for last in (False, False, True):
        placed = members.filter("size > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = save(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket"))
        # A class looks up its marks once, with the list of its open buckets (as many as bands at most), not once for each of them.
        still = placed.filter("rep <> pivot").join(mixed, "bucket").groupBy("rep").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.collect_list(F.struct("bucket", "size", "total")).alias("held"))
        open_members = save(still.join(classes.select("rep", "marks"), "rep").select("rep", "n", "component", "marks", F.inline("held")).select("bucket", "size", "total", "rep", "n", "component", "marks"))
        if last:
            found = _remaining_links(open_members, elements, percent)
        else:
            new = save(_best_partners(open_members, percent))
            found = _verify(new, elements, percent)
            discard(new)
        if not found.isEmpty():
            labels = _merged(labels, found)
        discard(mixed, open_members, found)

    discard(members, elements)
    of_set = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs``, all columns, with one document of each group: the one of the smallest id.

    Rows are told apart by a hash of all their columns, so one id may stand for different texts, and ids may be of any
    type; rows alike in every column share a fate, rows with a null id stay.
    """
    named = docs.select(row_hash(docs).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = save(near_duplicates(named, "row", "text", **settings).select(F.col("doc_id").alias("row"), "component_id", "kept"))
    shared = found.filter(~F.col("kept")).select("component_id").distinct()
    members = found.join(shared, "component_id", "left_semi").select("row", "component_id").distinct()
    members = save(members.join(named.select("row", "id").distinct(), "row"))
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    lost = members.join(best, "component_id").filter(F.col("row") != F.col("best.row"))
    out = without_rows(docs, lost.select("id", "row"), id_col)
    discard(found, members)
    return out
