"""Operator 9: token counts by section, with tokens mapped to their characters.

A whole text is encoded once. Token lengths give every token's span; spans of sections are joined to
them by binary search over the ordered token starts. A token counts for each section that holds its
first character: a token that crosses a boundary belongs to the section where it begins, and sections
that part a text between them share out all its tokens.

Edge cases: null and empty texts have one empty section without tokens; without given sections a
text's lines are its sections (a line break ends its own line); a token that begins within a
character (a character of several tokens) begins at that character; a null doc_id keeps its rows;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, slices


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def load(path: str):
    """(encoding, bytes of each token) of a file of byte-pair ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_starts(text: str, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first character, end character) of every token of a whole text."""
    encoding, sizes = load(path or default_vocabulary())
    ids = np.array(encoding.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte is of
    return char[starts], np.append(char, len(text))[ends - 1] + 1 if len(ids) else ends


def lines_of(text: str) -> list[tuple[int, int]]:
    """Spans of the lines, each with its line break."""
    at, out = 0, []
    for line in text.split("\n"):
        out.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    if len(out) > 1 and out[-1][0] >= len(text):
        out.pop()
    return out


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per section: doc_id, section (number), start, end, n_tokens, crossing.

    ``sections_col``: an array of structs (start, end) in characters, else lines. ``crossing`` is true
    if a token of the section ends beyond it. One pass, no shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            given = batch.column(2) if sections_col else None
            for a, z in slices(batch.column(1)):
                ids = batch.column(0).slice(a, z - a).to_pylist()
                texts = batch.column(1).slice(a, z - a).to_pylist()
                named = given.slice(a, z - a).to_pylist() if given is not None else [None] * len(ids)
                parts = []
                for doc_id, text, sections in zip(ids, texts, named):
                    spans = lines_of(text) if sections is None else [(s["start"], s["end"]) for s in sections]
                    begin, end = np.array(spans, dtype=np.int64).reshape(-1, 2).T
                    first, last = token_starts(text, vocabulary)
                    low, high = np.searchsorted(first, begin), np.searchsorted(first, end)
                    high = np.maximum(low, high)
                    over = np.zeros(len(begin), dtype=bool)
                    some = high > low
                    if some.any():
                        over[some] = last[high[some] - 1] > end[some]
                    parts.append((doc_id, begin, end, high - low, over))
                counts = [len(p[1]) for p in parts]
                owner = pa.array(np.repeat(np.arange(len(ids)), counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()).take(owner),
                        pa.array(np.concatenate([np.arange(c) for c in counts]), pa.int64()),
                        *(pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3, 4)),
                    ],
                    ["doc_id", "section", "start", "end", "n_tokens", "crossing"],
                )

    base = id_text(docs, id_col, text_col)
    if sections_col:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(sections_col).alias("sections"))
    return base.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, crossing boolean")
