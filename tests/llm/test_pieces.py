"""Operator 13 against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from placefinder.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.load(pieces.default_model())


def check(library, own, text):
    ids = library.encode(text, add_eos=True)
    assert own.encode(text).tolist() == ids, repr(text)
    assert own.decode(ids) == library.decode(ids), repr(text)


def test_every_document_equals_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op13_sentencepiece_codec(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_odd_texts(library, own):
    rng = random.Random(5)
    pool = [chr(c) for a, z in ((0, 0x250), (0x391, 0x3CA), (0x410, 0x450), (0x3041, 0x3090), (0x4E00, 0x4E80), (0xAC00, 0xAC40), (0x1F600, 0x1F640), (0x300, 0x320)) for c in range(a, z)]
    pool += ["<s>", "</s>", "<0x0A>", "▁", "▁▁", " ", "  ", " " * 17, "\n", "�", "⁇", "▁the", "ing", "the ", "'s", "\r\n"]
    for _ in range(3000):
        check(library, own, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60))))


def test_texts_made_of_pieces_and_few_letters(library, own):
    rng = random.Random(6)
    for _ in range(3000):
        check(library, own, "".join(own.strings[rng.randrange(259, 32000)].replace("▁", " ") for _ in range(rng.randint(1, 12))))
    for letters in ("ab", "aeinrst ", "01 ", "e ", "-=_ ", "hatin"):
        for _ in range(400):
            check(library, own, "".join(rng.choice(letters) for _ in range(rng.randint(1, 120))))


def test_every_piece_is_what_merging_gives(library, own):
    for piece in list(own.ids)[::7]:
        assert own.backtrack(piece) == own.merge(piece), piece


def test_stretches_longer_than_a_window(library, own, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 32)
    monkeypatch.setattr(pieces, "PART", 50)
    rng = random.Random(8)
    for letters in ("aaab", "etaoinsh", "ab c", "日本a "):
        for size in (49, 50, 51, 400, 3000):
            check(library, own, "".join(rng.choice(letters) for _ in range(size)))


def test_what_is_remembered_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    coder = pieces.PieceModel(pieces.default_model())
    check(library, coder, " ".join(f"word{i}" for i in range(300)))
    assert len(coder.known) <= 10 and len(coder.known.older) <= 10 and len(coder.fits) <= 10


def test_decoding_of_any_ids(library, own):
    rng = random.Random(9)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 28705, 0, 1, 2, 259, 3 + rng.randrange(128, 256)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_edge_rows(spark, library):
    long = "Lorem ipsum dolor sit amet. " * 20_000
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b"), (None, "x"), (5, long), (6, "y" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("z")).withColumn("decoded", F.lit(1))
    got = pieces.encode_pieces(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text, add_eos=True) and r.decoded == text
    assert pieces.encode_pieces(docs.limit(0)).collect() == []
