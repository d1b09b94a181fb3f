"""Packing: every id in one piece, gapless sequences, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cueflow.llm import packing
from cueflow.llm.queries import op9

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def test_pieces_cover_documents_and_fill_sequences(spark, model):
    texts = [None, "", "a", "ab <|endoftext|> cd", "<|endoftext|><|endoftext|>", "<|endoftext|", " " * 9000] + [f"word {i} " * (i * 3) for i in range(120)]
    texts += ["long text, " * 3000, "same", "same"]
    docs = spark.createDataFrame(
        [(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length long")
    rows = packing.pack(docs.repartition(3), PATH, P.PATTERN, capacity=256).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        want = model.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [t for p in pieces for t in p.ids] == want
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert all(p.doc_tokens == len(want) and p.length == len(p.ids) for p in pieces)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        total = sum(p.length for p in pieces)
        assert total <= 256 and total & (total - 1) == 0  # a power of two: no padding


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x"), (1, None)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, P.PATTERN, with_ids=False).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows)[0] == (0, 2) and len(rows) == 3
    assert packing.pack(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_capacity_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN, 1000)


def test_ids_are_those_of_the_plain_library(model):
    rng = random.Random(1)
    odd = [0x85, 0xA0, 0x1680, 0x2028, 0x200B, 0x3000, 0xB2, 0xBD, 0x2164, 0x660, 0x1D7CE, 0x345,
           0x301, 0xDF, 0x1E9E, 0x10400, 0xFEFF, *range(9, 14), 0x1C, 0x1F]
    pool = [chr(c) for c in [*range(32, 127), *odd]] + ["<|endoftext|>"]
    encoder = packing.Encoder(PATH, P.PATTERN)
    assert encoder.ranks is not None
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        assert encoder.ids(text).tolist() == model.encode(text, add_special_tokens=False).ids
    for text in (" " * 100_000 + "a", "a" * 100_000, " \n" * 50_000, "漢" * 50_000):
        assert encoder.ids(text).tolist() == model.encode(text, add_special_tokens=False).ids


def test_query_packs_every_document(spark, model):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = defaultdict(list)
    for r in op9(spark, folder).collect():
        rows[r.doc_id].append(r)
    assert set(rows) == set(texts)
    for i, text in texts.items():
        want = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(rows[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(want[at:at + r.length].tobytes())
            at += r.length
        assert at == len(want)
