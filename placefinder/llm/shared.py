"""Helpers the corpus operators share: texts by id, filters of whole texts, and byte-level word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import xxhash64

from ..operators.tables import save

#: Rows that Spark hands to Python at once, unless the session says otherwise than Spark's default: texts are wide, and
#: a batch is held by the executor and by its worker.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after seeing to it that its session hands over ``BATCH_ROWS`` rows at once."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key, DEFAULT_ROWS) == DEFAULT_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly two columns, ``doc_id`` and ``text`` (null text becomes empty), whatever else the input has. Ids are
    integers, or texts of integers."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; an id that is null counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def slices(column, most_bytes: int = 1 << 20, most_rows: int = 512):
    """Cut an Arrow text column into runs of about ``most_bytes``; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most_bytes or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield start, len(sizes)


#: Up to so many ids (8 MB) are broadcast; more are joined by shuffle.
FEW_IDS = 500_000


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed: rows of one id that differ at all are told apart by it."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return xxhash64(F.struct(*[docs[f"`{name}`"] for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind]))


def without_rows(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id and :func:`row_hash` are in ``rows`` (two columns); rows with a null id stay.

    They are saved and counted first: few are broadcast, so the texts don't move.
    """
    gone = save(rows.select(rows[0].alias("_gone"), rows[1].alias("_gone_hash")).filter("_gone IS NOT NULL").distinct())
    few = gone.count() <= FEW_IDS
    on = (docs[id_col] == gone["_gone"]) & (row_hash(docs) == gone["_gone_hash"])
    return docs.join(F.broadcast(gone) if few else gone, on, "left_anti")


def filter_texts(docs: DataFrame, keep: Callable[[], Callable], text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, for which a test of whole texts holds; one pass, no shuffle.

    ``keep()`` is called once in each task and returns a function from an Arrow text column without
    nulls to booleans.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        test = keep()
        for batch in batches:
            for a, z in slices(batch.column(at)):
                part = batch.slice(a, z - a)
                yield part.filter(pa.array(test(pc.fill_null(part.column(at), "")), pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


# -- hashing words straight from UTF-8 bytes ------------------------------------------------

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WEIGHTS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_PIECE = 1 << 18

#: Bytes that part words for near-duplicate search: space and 0x09-0x0D.
SPACE_BREAKS = np.zeros(256, dtype=bool)
SPACE_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that part words for decontamination: all of ASCII but digits and letters.
ALNUM_BREAKS = np.zeros(256, dtype=bool)
ALNUM_BREAKS[:0x80] = True
ALNUM_BREAKS[0x30:0x3A] = ALNUM_BREAKS[0x41:0x5B] = ALNUM_BREAKS[0x61:0x7B] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _piece_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up * inside, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word of several texts laid end to end in ``data`` (text i: bounds[i]..bounds[i+1]).

    Returns the words' 64-bit hashes, their byte starts, and for each text the index of its first
    word (one more entry closes the last). Work memory is bounded by pieces of about 256 KB that are
    cut at word ends, however long a text is.
    """
    n = len(data)
    inside = ~breaks[data]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    left = np.ones(n, dtype=bool)
    left[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (left | first[:n]))
    right = np.ones(n, dtype=bool)
    right[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (right | first[1:])) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _PIECE, side="right")))
        end = ends[j - 1]
        hashes[i:j] = _piece_hashes(data[at:end], inside[at:end], starts[i:j] - at, ends[i:j] - at)
        i = j
    return hashes, starts, np.searchsorted(starts, bounds)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column without nulls, and the bounds of its texts."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; fewer words than k make one shingle."""
    words, _, first = word_hashes(data, bounds, SPACE_BREAKS)
    out = []
    joined = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for i in range(k):
        joined += words[i : len(joined) + i] * _WEIGHTS[i]
    joined = mix(joined)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            short = np.uint64(int(np.sum(words[a:b] * _WEIGHTS[: b - a])) + int(b - a) & (2**64 - 1))
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
