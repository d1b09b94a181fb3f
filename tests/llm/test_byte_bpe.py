"""Byte-level BPE against the library whose ranks it uses."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cueflow.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n  x", "it's we'll 'tis don'there", "a" * 700, "été ß 漢字かな 🙂🙂", "<|endoftext|>",
    "123 4567  89\t\tq", "!!!???###", "the cat sat " * 30, "x" * 300 + "ab" * 300, "\x1c \x85　z",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH),
                             special_tokens={})


def test_ids_and_round_trip(spark, library):
    docs = spark.createDataFrame(
        [(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "twice", "n"), (None, "twice", "n")],
        "doc_id long, text string, n_tokens string")
    rows = byte_bpe.encode(docs, PATH, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = "twice" if row.doc_id is None else TEXTS[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert row.n_tokens == len(row.ids) and bytes(row.decoded) == text.encode()


def test_digests_and_decode(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in byte_bpe.encode(docs, PATH, P.PATTERN, digest=True).collect():
        ids = library.encode_ordinary(TEXTS[row.doc_id] or "")
        assert row.ids == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    ids = byte_bpe.encode(docs, PATH, P.PATTERN).select("doc_id", "ids")
    for row in byte_bpe.decode(ids, PATH, P.PATTERN).collect():
        assert bytes(row.decoded) == (TEXTS[row.doc_id] or "").encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(docs, PATH, P.PATTERN).count() == 0


def test_long_pieces_agree_with_the_recursion():
    bpe = byte_bpe.RecursiveBpe(PATH)
    for piece in ("abc" * 60, "q" * 90, "hereinafter" * 9, "thththt" * 20):
        ids, _ = bpe.encode([piece])
        assert ids.tolist() == bpe.contract_long(piece.encode()).tolist()


def test_a_trimmed_store_gives_the_same_ids(library):
    from cueflow.llm.pieces import PieceStore

    bpe = byte_bpe.RecursiveBpe(PATH)
    store = PieceStore(P.PATTERN, bpe.encode, bpe.decode, kept=20)
    texts = [f"word{i} and other{i * 7} things {i}" for i in range(60)]
    for i in range(0, 60, 7):
        for text, (ids, at) in zip(texts[i:i + 7], store.ids_of(texts[i:i + 7])):
            assert ids.tolist() == library.encode_ordinary(text)
            assert b"".join(store.bytes[k] for k in at.tolist()) == text.encode()
        store.trim(10)
        assert len(store.place) == len(store.bytes) == len(store.starts) == 10
