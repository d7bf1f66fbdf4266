"""Operator 1: byte-pair encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; candidate merges wait in a priority queue ordered by
(rank, position). A popped entry whose symbols have changed since is stale and is skipped. Decoding
concatenates vocabulary strings.

Edge cases: a null text counts as empty (no tokens, empty decoded text); special tokens written out
in a text become their own id, as the file's added tokens say; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored; ids keep their type.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches

#: What a worker's memory of words and their ids may take (bytes, about), and the longest word it holds. Bounds on
#: memory only: other words are encoded again. Words are forgotten by halves, those not met lately first.
REMEMBERED_BYTES, REMEMBERED_LENGTH, PER_WORD = 36 << 20, 64, 220


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    shown = {b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of the word-end kind (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        letters = byte_alphabet()
        #: The symbol of each byte, within a word and at its end.
        self.of_byte = [self.vocab[x] for x in letters]
        self.of_last = [self.vocab[x + self.suffix] for x in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_word(self, word: str) -> list[int]:
        """The ids of one word, by merging its symbols in rank order."""
        raw = word.encode("utf-8")
        ids = [self.of_byte[b] for b in raw]
        ids[-1] = self.of_last[raw[-1]]
        last = len(ids) - 1
        merges = self.merges.get
        # (rank, place, left id, right id, merged id)
        queue = [(found[0], at, ids[at], ids[at + 1], found[1]) for at in range(last) if (found := merges((ids[at], ids[at + 1])))]
        if not queue:
            return ids
        heapify(queue)
        after = [*range(1, last + 1), -1]
        before = list(range(-1, last))
        while queue:
            _, at, left, right, merged = heappop(queue)
            nxt = after[at]
            if ids[at] != left or nxt < 0 or ids[nxt] != right:
                continue  # stale: one of the two has been merged since
            ids[at], ids[nxt] = merged, -1
            after[at] = nxt = after[nxt]
            if nxt >= 0:
                before[nxt] = at
                if found := merges((merged, ids[nxt])):
                    heappush(queue, (found[0], at, merged, ids[nxt], found[1]))
            prev = before[at]
            if prev >= 0 and (found := merges((ids[prev], merged))):
                heappush(queue, (found[0], prev, ids[prev], merged, found[1]))
        return [i for i in ids if i >= 0]

    def _packed(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                ids = self.merge_word(word)
                found = pack(f"<{len(ids)}I", *ids)
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.known) * PER_WORD * 2 >= REMEMBERED_BYTES:
                    self.older, self.known = self.known, {}
                self.known[word] = found
        return found

    def _encode_plain(self, text: str) -> bytes:
        import unicodedata

        # One character at a time: no final-sigma rule.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = self.words(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self._packed(w) for w in words])

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.marks and any(x in text for x in self.special):
            parts = self.marks(text)
            return b"".join(int(self.special[p]).to_bytes(4, "little") if p in self.special else self._encode_plain(p) for p in parts)
        return self._encode_plain(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, parted by blanks as the file (which names no decoder) asks."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and on request the ids and the decoded
    text themselves. One pass, no shuffle; a text is held once, whatever its length.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = load(vocabulary or default_vocabulary())
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for a, z in slices(texts):
                rows: dict[str, list] = {"n": [], "ids": [], "dec": [], "list": [], "text": []}
                for text in texts.slice(a, z - a):
                    packed = coder.encode_bytes(text.as_py())
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    decoded = coder.decode(ids)
                    rows["n"].append(len(ids))
                    rows["ids"].append(hashlib.sha256(packed).hexdigest())
                    rows["dec"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_ids:
                        rows["list"].append(packed)
                    if with_text:
                        rows["text"].append(decoded)
                arrays = [ids_of.slice(a, z - a), pa.array(rows["n"], pa.int64()), pa.array(rows["ids"], pa.string()), pa.array(rows["dec"], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *rows["n"]])
                    flat = np.frombuffer(b"".join(rows["list"]), dtype="<u4").astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                    names.append("ids")
                if with_text:
                    arrays.append(pa.array(rows["text"], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    texts = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)
