"""Repeated passages against all windows of LEAST words of all documents."""

import random
from collections import defaultdict

import pytest

from cueflow.llm import suffix_dedup as S
from cueflow.llm.queries import op6


def brute(texts):
    """By document: word positions in a window that other documents have, and that smaller have."""
    where = defaultdict(set)
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i, own in words.items():
        for p in range(len(own) - S.LEAST + 1):
            where[tuple(own[p:p + S.LEAST])].add(i)
    shared, gone = {}, {}
    for i, own in words.items():
        shared[i], gone[i] = set(), set()
        for p in range(len(own) - S.LEAST + 1):
            holders = where[tuple(own[p:p + S.LEAST])]
            if len(holders) > 1:
                shared[i] |= set(range(p, p + S.LEAST))
            if min(holders) < i:
                gone[i] |= set(range(p, p + S.LEAST))
    return shared, gone


def covered(text):
    return {p for part in text.split(",") if part
            for p in range(*map(int, part.split("-")))}


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(n) for n in (49, 50, 51, 60, 120, 300)]
    texts = {}
    for i in range(docs):
        own = draw(rng.randint(0, 200))
        for p in rng.sample(passages, rng.randint(0, 2)):
            own = own + p + draw(rng.randint(0, 80))
        if rng.random() < 0.1 and texts:
            own = texts[rng.choice(list(texts))].split()
        texts[i] = " ".join(own)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_are_those_of_all_windows(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()],
                                 "doc_id long, text string, spans int")
    shared, gone = brute(texts)
    named = docs.select("doc_id", S.document_key().alias("doc"))
    rows = {r.doc_id: r for r in named.join(S.repeated_passages(docs), "doc").collect()}
    for i in texts:
        spans = {p for s in (rows[i].spans if i in rows else []) for p in range(s.start, s.stop)}
        out = {p for s in (rows[i].gone if i in rows else []) for p in range(s.start, s.stop)}
        assert spans == shared[i]
        assert out == gone[i]


def test_removal_keeps_one_copy_of_each_passage(spark):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()],
                                 "doc_id long, text string, __gone2 string")
    left = {r.doc_id: r.text for r in S.drop_repeated_passages(docs).collect()}
    assert set(left) == set(texts)
    shared, gone = brute(texts)
    for i, t in texts.items():
        assert left[i].split() == [w for p, w in enumerate(t.split()) if p not in gone[i]]
        if not gone[i]:
            assert left[i] == t
    # every window that two documents have stays somewhere, but for those that reach over passages
    # with different first documents: at each end of what is gone a window loses words
    holders = defaultdict(set)
    for i, t in texts.items():
        own = t.split()
        for p in range(len(own) - S.LEAST + 1):
            holders[tuple(own[p:p + S.LEAST])].add(i)
    kept = " | ".join(left.values())
    repeated = [w for w, docs_ in holders.items() if len(docs_) > 1]
    lost = [w for w in repeated if " ".join(w) not in kept]
    assert len(repeated) > 500
    for w in lost:
        first = min(holders[w])
        own = texts[first].split()
        at = next(p for p in range(len(own)) if tuple(own[p:p + S.LEAST]) == w)
        # in its first document a part of it is a copy of an earlier document's passage
        assert gone[first] & set(range(at, at + S.LEAST))


def test_periodic_texts_and_odd_rows(spark):
    run = "be " * 300
    rows = [(1, "a b " + run + "c"), (2, "d " + run + "e f"), (3, run), (4, None), (5, ""),
            (None, run + "x"), (None, run + "x"), (6, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = docs.select("doc_id", S.document_key().alias("doc"))
    found = named.join(S.repeated_passages(docs), "doc").collect()
    assert {r.doc_id for r in found} == {1, 2, 3, None}
    assert all(sum(s.stop - s.start for s in r.spans) >= 250 for r in found)
    assert not [r for r in found if r.doc_id == 1][0].gone
    assert S.repeated_passages(docs.limit(0)).count() == 0


def test_ranges_meet_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(S, "NEIGHBOURS", 2)
    texts = {i: t for i, t in enumerate([" ".join(f"p{k}" for k in range(80))] * 40)}
    texts = {i: f"{t} tail{i}" for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    named = docs.select("doc_id", S.document_key().alias("doc"))
    rows = {r.doc_id: r for r in named.join(S.repeated_passages(docs), "doc").collect()}
    assert set(rows) == set(texts) and not rows[0].gone
    assert all(rows[i].gone for i in texts if i)


def test_registered_query_against_all_windows(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    shared, gone = brute(texts)
    rows = {r.doc_id: r for r in op6(spark, folder).collect()}
    assert set(rows) == {i for i in texts if shared[i]}
    for i, r in rows.items():
        assert covered(r.spans) >= shared[i] and covered(r.gone) >= gone[i]
        assert r.repeated_words == len(covered(r.spans)) and r.gone_words == len(covered(r.gone))


def found_and_brute(docs, texts):
    named = docs.select("doc_id", S.document_key().alias("doc"))
    rows = {r.doc_id: r for r in named.join(S.repeated_passages(docs), "doc").collect()}
    words = lambda i, c: {
        p for s in (rows[i][c] if i in rows else []) for p in range(s.start, s.stop)}
    shared, gone = brute(texts)
    return rows, {i: words(i, "spans") for i in texts}, {i: words(i, "gone") for i in texts}, shared, gone


def test_short_passage_next_to_a_line_of_thousands(spark):
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(1 << 30)}" for _ in range(n)]
    line = draw(34)
    texts = {i: " ".join(draw(20) + line + draw(5)) for i in range(3000)}
    for a in range(0, 3000, 75):  # 54 words that two documents share, the line among them
        own = draw(20)
        texts[a], texts[a + 3000] = (" ".join(draw(9) + own + line + draw(40)) for _ in range(2))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows, spans, out, shared, gone = found_and_brute(docs, texts)
    assert spans == shared and out == gone
    assert all(len(out[a + 3000]) == 54 for a in range(0, 3000, 75))


def test_hot_passage_in_differing_contexts_over_eight_tasks(spark):
    rng = random.Random(4)
    draw = lambda n: [f"w{rng.randrange(1 << 30)}" for _ in range(n)]
    passage = draw(60)
    texts = {i: " ".join(draw(60) + passage + draw(60)) for i in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rows, spans, out, shared, gone = found_and_brute(docs, texts)
    finally:
        spark.conf.set(setting, before)
    assert spans == shared and out == gone
    assert [i for i in texts if not out[i]] == [0]
    # an anchor that only some contexts choose may name a further partner
    assert rows[0].partners[0] == 1 and all(rows[i].partners[0] == 0 for i in texts if i)
