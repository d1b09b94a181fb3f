"""Language identification: exact code lengths, held-out accuracy, odd inputs."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cueflow.llm import byte_runs
from cueflow.llm import language_id as L
from cueflow.llm.queries import op5

TRAIN = [
    ("the cat sat on the mat, the end.", "en"), ("a dog and the hat", "en"),
    ("le chat était là, été", "fr"), ("der Hund und die Katze", "de"), ("no language", None),
    (None, "en"), ("", "fr"),
]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.createDataFrame(TRAIN, "text string, lang string"))


def brute_bits(text, lang):
    """Code length by walking the contexts, longest first, for every byte."""
    counts = defaultdict(Counter)
    for t, own in TRAIN:
        if own == lang and t is not None:
            data = L._bytes_of(t)
            for i in range(L.ORDER, len(data)):
                for k in range(L.ORDER + 1):
                    counts[data[i - k:i]][data[i]] += 1
    data, bits = L._bytes_of(text), 0.0
    for i in range(L.ORDER, len(data)):
        for k in range(L.ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts.get(data[i - k:i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
    return bits


def test_code_lengths_are_exact(model):
    assert model.languages == ["de", "en", "fr"]
    texts = ["the hat", "été zzz Ω", "", "Katze", "q" * 50, "the cat " * 40]
    got = L.code_lengths(model, texts)
    for i, text in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits(text, lang), rel=1e-5, abs=1e-4)


def test_portions_do_not_change_the_length(model, monkeypatch):
    texts = ["the cat sat " * 50, "und die Katze", "x"]
    whole = L.code_lengths(model, texts)
    monkeypatch.setattr(byte_runs, "BYTES_AT_ONCE", 17)
    assert np.allclose(whole, L.code_lengths(model, texts), rtol=1e-6)


def test_odd_texts(spark, model):
    docs = spark.createDataFrame(
        [(1, None, "en", "x"), (2, "123 !", "en", "x"), (None, "the cat", None, "x"),
         (None, "the cat", None, "x"), (4, "", "de", "x")],
        "doc_id long, text string, lang string, score string")
    rows = L.identify(docs, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows] == [
        (1, "und"), (2, "und"), (None, "en"), (None, "en"), (4, "und")]
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == 0
    assert L.identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = L.train(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([("abc", 1)], "text string, n int")
    assert [r.lang_pred for r in L.identify(docs, empty).collect()] == ["und"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in op5(spark, folder).collect() if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in rows)
    assert len(rows) > 200 and right / len(rows) > 0.98


def test_only_letters_count_as_letters():
    for text in ("²", "½", "①", "Ⅳ", "12 ³", "_", "٣", "🙂"):
        assert not L.LETTER.search(text)
    for text in ("a", "é", "漢", "ª", "1b"):
        assert L.LETTER.search(text)
