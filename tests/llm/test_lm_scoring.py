"""Language-model scoring: counts and base score by brute force, a normalised model, odd inputs."""

import math
from collections import Counter

import numpy as np
import pytest

from cueflow.llm import lm_scoring as L
from cueflow.llm.queries import op4, remainder


def plain_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def check_base(rows, docs):
    train = Counter(t for i, (text, out) in docs.items() if not out for t in plain_tokens(text))
    n, v = sum(train.values()), len(train)
    for r in rows:
        own = plain_tokens(docs[r.doc_id][0])
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (
            len(own), sum(train[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{folder}/documents.parquet").withColumn(
        "out", remainder("doc_id", 7) == 2)
    docs = {r.doc_id: (r.text, r.out) for r in source.collect()}
    return op4(spark, folder).collect(), docs


def test_base_scores_of_all_documents(scored):
    rows, docs = scored
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == docs[r.doc_id][1] for r in rows)
    check_base(rows, docs)


def test_model_is_better_than_counts_on_held_out_texts(scored):
    rows, _ = scored
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / n > 0.1
    assert np.mean([r.score > r.base_score for r in held]) > 0.85


def test_joined_counts_give_the_same_base(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD_TOKENS", 3)
    monkeypatch.setattr(L, "OWN_CLASSES", 2)
    texts = ["a b c a", "A  B\td", "", None, "x y z", "a\x0bb", "é É a", "rare words here b"]
    docs = {i: (t, i in (4, 6)) for i, t in enumerate(texts)}
    frame = spark.createDataFrame(
        [(i, t, o, 1.5) for i, (t, o) in docs.items()],
        "doc_id long, text string, held boolean, score double")
    check_base(L.train_and_score(frame, "held").collect(), docs)


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([("a b c a b d e", False), ("b b a", False)],
                                 "text string, out boolean")
    counts = L.count_tokens(docs)
    vocab = L.vocabulary(counts)
    model = L.train(docs, vocab)
    p = np.exp(model.log_probabilities(np.arange(vocab.classes + 1), np.arange(vocab.classes + 1)))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    # within a shared class: every known token's share, and one unseen token's
    within = (vocab.shape_tokens + vocab.shape_distinct + 1) / (
        vocab.shape_tokens + vocab.shape_distinct + 1)
    assert np.allclose(within, 1)


def test_score_follows_the_model_token_by_token(spark):
    train = spark.createDataFrame([("a b c a b d e " * 20, False)], "text string, out boolean")
    counts = L.count_tokens(train)
    vocab, = (L.vocabulary(counts),)
    model = L.train(train, vocab)
    docs = spark.createDataFrame([(1, "a c zz"), (2, "")], "doc_id long, text string")
    for r in L.score(docs, vocab, model, counts).collect():
        text = {1: "a c zz", 2: ""}[r.doc_id]
        words, total = L.tokens(text), 0.0
        classes = vocab.classes_of(words, vocab.places(words))
        for i, (w, c) in enumerate(zip(words, classes.tolist(), strict=True)):
            near = classes[i - 1] if i else vocab.classes
            far = classes[i - 2] if i > 1 else vocab.classes
            total += model.log_probabilities(np.array([near]), np.array([far]))[0, c] / math.log(10)
            if c >= vocab.own:
                k = c - vocab.own
                n = vocab.head_count[vocab.head[w]] if w in vocab.head else 0
                total += math.log10((n + 1) / (vocab.shape_tokens[k] + vocab.shape_distinct[k] + 1))
        assert r.score == pytest.approx(total, rel=1e-4)


def test_empty_and_null(spark):
    frame = spark.createDataFrame(
        [(None, "a b", False), (None, "a b", False), (1, None, True)],
        "doc_id long, text string, out boolean")
    rows = L.train_and_score(frame, "out").collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3]
    assert L.train_and_score(frame.limit(0), "out").count() == 0
    nothing = L.train_and_score(frame.filter("out"), "out").collect()
    assert nothing[0].train_tokens == 0 and math.isfinite(nothing[0].score)


def test_merged_triples_give_the_gradient_of_all_occurrences(monkeypatch):
    rng = np.random.default_rng(2)
    classes = 40
    unigram = np.full(classes, 1 / classes)
    size = classes + 1
    # some triples thousands of times, most once
    triples = np.concatenate([np.repeat(rng.integers(0, size * size, 5) * size + 3, 3000),
                              rng.integers(0, size * size, 2000) * size + rng.integers(0, classes, 2000)])
    trainer = L.Trainer(L.LogBilinear.start(unigram), unigram, 1)
    steps = []
    monkeypatch.setattr(trainer, "_step", lambda *of: steps.append(of))
    trainer.learn(triples)
    assert len(steps) > 2
    near, far, klass, weight = (np.concatenate(c) for c in zip(*steps, strict=True))
    noise = rng.integers(0, classes, L.NOISE)
    merged = trainer.gradients(near, far, klass, weight, noise)
    rest, own = np.divmod(triples, size)
    whole = trainer.gradients(rest % size, rest // size, own, np.ones(len(own), np.float32), noise)
    scale = len(near) / len(triples)
    for a, b in zip(merged, whole, strict=True):
        assert np.allclose(a, b * scale, rtol=1e-2, atol=1e-2 * np.abs(b * scale).max())
