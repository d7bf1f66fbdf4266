"""Operator 13: encoding and decoding with a public SentencePiece model of the merge (BPE) type.

A sequence of pieces is what merging would give if, and only if, merging each two neighbours' text alone
gives these two again: a merge across a border would show in the pair beside it. So a text is encoded from
the left without merging it: an Aho-Corasick automaton names the longest piece that starts at each place,
pieces that don't fit their left neighbour are replaced by the next shorter piece, and where none fits the
place is marked in a bitfield as one where no piece may end, and the piece before it is tried again. As the
encoding of every prefix is unique, a marked place never has to be looked at twice. Checks of pairs are
made by merging and remembered.

Texts are cut first where two neighbouring characters are together in no piece, as no merge crosses such a
place; the ids of short stretches are remembered.

Edge cases: a null text counts as empty, whose only id is the end id; characters without a piece become
their UTF-8 bytes' pieces; control pieces written out in a text are ordinary text; a null doc_id keeps its row;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from struct import pack

import numpy as np
from pyspark.sql import DataFrame

from .shared import id_text, slices

SPACE, UNKNOWN_SHOWN = "▁", " ⁇ "
#: Piece types, as the file format numbers them.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_PIECE = float("-inf")
#: What a worker remembers: so many stretches and pairs, twice at most, none longer than this. Bounds on memory only.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64
#: Characters whose longest pieces are looked up at once, and that are cut into stretches at once.
WINDOW, PART = 1 << 12, 1 << 20

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Remembered(dict):
    """Values by key, made when first asked for; forgotten by halves, those not met lately first."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceModel:
    """Encoder and decoder for a model file of the merge type with byte pieces and no rules of normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        form = spec.normalizer_spec
        kinds = [p.type for p in spec.pieces]
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or form.precompiled_charsmap or form.remove_extra_whitespaces or not form.escape_whitespaces or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge model with byte pieces, plain normalisation and no user-defined or unused pieces is needed")
        self.prefix = SPACE if form.add_dummy_prefix else ""
        self.strings, self.kinds = [p.piece for p in spec.pieces], kinds
        self.byte_of = {i: int(s[3:5], 16) for i, (s, k) in enumerate(zip(self.strings, kinds)) if k == BYTE}
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        self.end = next(i for i, s in enumerate(self.strings) if s == spec.trainer_spec.eos_piece)
        self.ids = {s: i for i, (s, k) in enumerate(zip(self.strings, kinds)) if k == NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.longest_piece = max(map(len, self.ids))
        #: The next shorter piece that a piece begins with; a single character always counts as one.
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.ids) for p in self.ids if len(p) > 1}
        self.backwards = ahocorasick.Automaton()
        for p in self.ids:
            self.backwards.add_word(p[::-1], p)
        self.backwards.make_automaton()
        #: Stretches that no merge leaves: a space joins what follows it and other spaces only, if the pieces say so, and
        #: a character of no longer piece stands alone.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        joined = "".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE}))
        group = f"[{re.escape(joined)}{SPACE if inner else ''}]"
        self.stretches = re.compile(f"{SPACE}*{group}+|{SPACE}+|[^{SPACE}]", re.S)
        #: Whether two pieces, or one after nothing, are what merging their text gives.
        self.fits = Remembered(lambda pair: self.merge(pair[0] + pair[1]) == [x for x in pair if x])
        self.known = Remembered(self._packed)
        #: What each id is decoded to, but for bytes.
        self.shown = ["" if k == CONTROL else UNKNOWN_SHOWN if k == UNKNOWN else s.replace(SPACE, " ") for s, k in zip(self.strings, kinds)]

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, the leftmost of equal ones."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NO_PIECE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != NO_PIECE:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], NO_PIECE)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], NO_PIECE)
        return parts

    def _longest(self, text: str) -> list[str]:
        """The longest piece that starts at each character."""
        found, last, before = list(text), len(text) - 1, -1
        for end, piece in self.backwards.iter(text[::-1]):
            if end != before:  # of pieces that end at one place the automaton names the longest first
                found[last - end] = piece
                before = end
        return found

    def _windows(self, text: str) -> Callable[[int], str]:
        """The longest piece at a place of a long text, looked up window by window; two are held."""
        windows: dict[int, list[str]] = {}

        def longest(at: int) -> str:
            k = at // WINDOW
            if k not in windows:
                for old in [w for w in windows if w not in (k - 1, k + 1)]:
                    del windows[old]
                windows[k] = self._longest(text[k * WINDOW : (k + 1) * WINDOW + self.longest_piece])
            return windows[k][at - k * WINDOW]

        return longest

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text, the same as merging gives."""
        n = len(text)
        if not n:
            return []
        failed = bytearray(n // 8 + 1)
        longest = self._longest(text).__getitem__ if n <= WINDOW else self._windows(text)
        fits, shorter = self.fits, self.shorter.get
        out: list[str] = []
        at, piece, before = 0, longest(0), ""
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and fits[before, piece]:
                out.append(piece)
                if end == n:
                    return out
                at, before, piece = end, piece, longest(end)
                continue
            piece = shorter(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""

    def _packed(self, stretch: str) -> bytes:
        ids: list[int] = []
        for piece in self.backtrack(stretch):
            found = self.ids.get(piece)
            if found is None:
                ids += [self.of_byte[b] for b in piece.encode("utf-8")]
            else:
                ids.append(found)
        return pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, and the end id."""
        out = []
        if text:
            text = self.prefix + text.replace(" ", SPACE)
        at, width = 0, PART
        while at < len(text):
            found = self.stretches.findall(text, at, at + width)
            if at + width < len(text):
                if len(found) == 1:
                    width *= 2
                    continue
                at += width - len(found.pop())  # the last one may go on
                width = PART
            else:
                at = len(text)
            out.append(b"".join(map(self.known.__getitem__, found)))
        out.append(np.array([self.end], "<i4").tobytes())
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: pieces side by side, bytes read as UTF-8 (each that can't be read as U+FFFD), controls as
        nothing, and without the one blank that encoding puts before a text."""
        shown, byte_of = self.shown, self.byte_of
        out: list[str] = []
        for raw, some in groupby(ids, byte_of.__contains__):
            if raw:
                out.append(bytes(map(byte_of.__getitem__, some)).decode("utf-8", "each_byte"))
            else:
                out += map(shown.__getitem__, some)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None) if self.prefix else None
        text = "".join(out)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and self.strings[first].startswith(SPACE) else text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, the ids of every whole text with the end id, and the text decoded from them. One pass, no shuffle; a text
    is held once, whatever its length."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = load(model or default_model())
        for batch in batches:
            for a, z in slices(batch.column(1)):
                ids = [coder.encode(text.as_py()) for text in batch.column(1).slice(a, z - a)]
                decoded = pa.array([coder.decode(some.tolist()) for some in ids], pa.string())
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), listed, decoded], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
