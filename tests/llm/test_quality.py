"""Quality: the n-gram model by brute force, thresholds, and labels that were not trained on."""

import math
from collections import Counter, defaultdict

import pytest

from cueflow.llm import quality as Q

TRUSTED = ["the cat sat on the mat", "the dog and the hat", "a cat and a dog", "on and on, the end"]


def brute_model():
    """p(byte | context) by the textbook recursion over dictionaries."""
    runs = Counter()
    for t in TRUSTED:
        data = Q._data(t)
        runs.update(data[i:i + 4] for i in range(len(data) - 3))
    levels = {4: runs}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, totals = {}, {}
    for k, counts in levels.items():
        t = [max(sum(c == n for c in counts.values()), 1) for n in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        raw = (1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2])
        discounts[k] = [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]
        totals[k] = defaultdict(lambda: [0, 0.0])
        for g, c in counts.items():
            totals[k][g[:-1]][0] += c
            totals[k][g[:-1]][1] += discounts[k][min(c, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        total, off = totals[k].get(gram[:-1], (0, 0))
        if not total:
            return p(gram[1:])
        c = levels[k].get(gram, 0)
        own = (c - discounts[k][min(c, 3) - 1]) / total if c else 0
        return own + off / total * p(gram[1:])

    return p


def test_perplexity_is_the_interpolated_one(spark):
    rows = spark.createDataFrame([(7, t) for t in TRUSTED], "doc_id long, text string")
    (model,) = Q.train(rows).values()
    p = brute_model()
    for text in ["the cat", "zzz", "a dog and été 漢", "THE", "t"]:
        data = Q._data(text)
        bits = -sum(math.log2(p(data[i:i + 4])) for i in range(len(data) - 3))
        assert model.perplexities([text])[0] == pytest.approx(
            2 ** (bits / (len(data) - 3)), rel=1e-4)


def test_probabilities_add_up_to_one():
    p = brute_model()
    for context in (b"the", b"\n\n\n", b"zzz", b" an"):
        assert sum(p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, TRUSTED[0], "en"), (2, TRUSTED[1], "en"), (3, None, "en"), (4, "", None),
         (5, "##!!%%##!!%%", "en"), (None, TRUSTED[2], None), (None, TRUSTED[2], None),
         (6, TRUSTED[3], "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 1, 0), (5, 1, 1), (6, 0, 0), (None, 1, 0)],
        "doc_id long, quality int, toxic int")
    rows = Q.judge(docs, labels).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].kept and by[2].kept and not by[3].kept and not by[4].kept and not by[5].kept
    assert by[3].perplexity is None and by[6].threshold is not None
    assert Q.judge(docs.limit(0), labels).count() == 0
    none = Q.judge(docs, labels.limit(0)).collect()
    assert [r.doc_id for r in none if not r.kept] == [3, 4]


def test_labels_not_trained_on(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    half = labels.filter("doc_id % 2 = 0")
    rows = [r for r in Q.judge(docs, half).collect() if r.doc_id in truth and r.doc_id % 2]
    kept = [r for r in rows if truth[r.doc_id] == 1]
    junk = [r for r in rows if truth[r.doc_id] == 0]
    print(sum(r.kept for r in kept), len(kept), sum(r.kept for r in junk), len(junk))
    assert sum(r.kept for r in kept) > 0.95 * len(kept)
    assert sum(not r.kept for r in junk) > 0.5 * len(junk)
