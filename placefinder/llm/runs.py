"""Operator 11: periodic runs of words, found with bit-parallel lags.

The words of a text become dense numbers, the numbers bit planes: one big integer for each binary digit,
one bit for each word. For a lag q every plane is XORed with itself shifted by q and the results are ORed:
a zero says that two words q apart are the same. Shift-doubling AND keeps only stretches of zeros that are
long enough for a run of period q. A run is a stretch of words with smallest period q, as long as
``LEAST_LENGTH`` words and ``LEAST_PERIODS`` periods at least, that no neighbouring word extends.

Of a text with more than ``GRID_WORDS`` words, lags over ``GRID_LAG`` are tried only where words on a grid of
step q let them succeed: a run of 4q words covers four grid words in a row, which are then equal. That test reads
n/q words a lag, so a text of n words takes about n log n steps instead of n^2, and it rules out no run. Hits that a
run already found explains (its period divides q) are not tried again.

Edge cases: a null or blank text has no words and no runs; words are compared byte for byte, letters' case counts;
runs of different periods may overlap, and a word is dropped if any run has it after its first period; a null doc_id
keeps its row; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .shared import id_text, slices

#: A run has so many words and so many periods at least.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: From so many words on, and above this lag, the grid test comes first.
GRID_WORDS, GRID_LAG = 4096, 64
#: Planes that are compared before the first look for a stretch.
FIRST_PLANES = 3
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"


def number_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as dense numbers in order of first use, and the words by number. A text of any length is
    split piece by piece, so that only distinct words are held."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            while end < len(raw) and raw[end] not in BLANKS:
                end += 1
        words = raw[at:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), list(numbers)


def bit_planes(ids: np.ndarray) -> list[int]:
    """One big integer for each binary digit of the numbers; bit i belongs to word i."""
    digits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> d & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for d in range(digits)]


def long_ones(bits: int, least: int) -> int:
    """Bit i is set where bits i to i + least - 1 are all set."""
    have = 1
    while bits and have < least:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    return bits


def _stretches(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of set bits."""
    flags = np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    steps = np.diff(flags, prepend=0, append=0)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) - 1


def lag_stretches(planes: list[int], n: int, lag: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of words that repeat after ``lag`` and are long enough for a run."""
    least = max(LEAST_LENGTH, LEAST_PERIODS * lag) - lag
    every = (1 << (n - lag)) - 1
    differ = 0
    for plane in planes[:FIRST_PLANES]:
        differ |= plane ^ (plane >> lag)
    if not long_ones(every & ~differ, least):
        return []
    for plane in planes[FIRST_PLANES:]:
        differ |= plane ^ (plane >> lag)
    found = long_ones(every & ~differ, least)
    if not found:
        return []
    first, last = _stretches(found, n)
    return [(int(a), int(z - a) + least + lag) for a, z in zip(first, last)]


def _grid_allows(ids: np.ndarray, lag: int, runs: list[tuple[int, int, int]]) -> bool:
    """Whether four equal words in a row on the grid of step ``lag`` lie outside every run that explains them."""
    on = ids[::lag]
    same = on[1:] == on[:-1]
    hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * lag
    for start, length, period in runs:
        if not len(hits):
            return False
        if length > 3 * lag and lag % period == 0:
            hits = hits[(hits < start) | (hits + 3 * lag >= start + length)]
    return len(hits) > 0


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a list of numbers as (start, length, period), by start, then period."""
    n = len(ids)
    if n < LEAST_LENGTH:
        return []
    planes = bit_planes(ids)
    seen: set[tuple[int, int]] = set()
    runs: list[tuple[int, int, int]] = []
    for lag in range(1, n // LEAST_PERIODS + 1):
        if n > GRID_WORDS and lag > GRID_LAG and not _grid_allows(ids, lag, runs):
            continue
        for start, length in lag_stretches(planes, n, lag):
            # A stretch of four periods that has a smaller period too was found with that one, at the same place.
            if (start, length) not in seen:
                seen.add((start, length))
                runs.append((start, length, lag))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run holds after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def collapse(raw: bytes) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """(number of words, runs, the kept words joined by one blank) of a text."""
    ids, words = number_words(raw)
    runs = find_runs(ids)
    kept = ids[kept_words(len(ids), runs)] if runs else ids
    return len(ids), runs, b" ".join(map(words.__getitem__, kept.tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without the
    repeated periods. One pass over whole texts, no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for a, z in slices(batch.column(1)):
                found = [collapse(text.as_buffer().to_pybytes()) for text in batch.column(1).slice(a, z - a)]
                flat = np.array([r for _, runs, _ in found for r in runs], dtype=np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *(len(runs) for _, runs, _ in found)])
                spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
                arrays = [batch.column(0).slice(a, z - a), pa.array([n for n, _, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([c for _, _, c in found], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
