"""Ranked search against scores of all documents; blocks that stay packed."""

import random
import re
from collections import Counter
from math import floor, log

import duckdb
import pytest

from cueflow.llm import queries as Q
from cueflow.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    """(item, rank, id, score) by scoring every row."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return out


def corpus(seed, rows):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "Ε2", "x-y", "naïve"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 400]))))
            for i in range(rows)]


def found(spark, docs, items, **how):
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs],
                                  "doc_id long, text string, item int, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, "a") for i, t in items],
                                  "item_id long, text string, rank string")
    index = R.build_index(frame, **how)
    return sorted((tuple(r) for r in R.best_documents(index, asked, at_once=4).collect()), key=str)


@pytest.mark.parametrize("block, span, rows", [(128, 2048, 500), (4, 16, 60), (2, 7, 9)])
def test_results_are_those_of_all_documents(spark, monkeypatch, block, span, rows):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "RANGE", span)
    docs = corpus(3, 700)
    docs += [(1000 + k, "W1 w7 w90 w91") for k in range(120)]  # ties beyond the last rank
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randint(1, 30))))
             for k in range(9)] + [(9, "w90 W91."), (10, "ünï Ünï ε2 Ε2"), (11, "nowhere"), (12, "")]
    want = sorted(plain(docs, items), key=str)
    # one batch of rows is taken at least before a segment is full
    assert found(spark, docs, items, segment_rows=256 + rows) == want


def test_blocks_stay_packed():
    docs = [["rare", *["often"] * (k % 3 + 1)] if k % 400 == 0 else ["often"] * (k % 3 + 1)
            for k in range(6000)]
    import pyarrow as pa
    names = [f.split()[0] for f in R.INDEX_FIELDS.split(", ")]
    row = dict(zip(names, R.segment_row(docs, pa.array(range(6000))), strict=True))
    total = sum(map(len, docs))
    corpus_ = R.Corpus(6000, total, {b"rare": R.weight(6000, 15), b"often": R.weight(6000, 6000) or 1})
    segment = R.Segment(row, corpus_)
    lists = [segment.lists[b"rare"], segment.lists[b"often"]]
    numbers, _ = R.search_segment(lists, 6000, 5)
    assert len(numbers) >= 5
    # the frequent list is opened only where candidates of the rare one are
    assert len(segment.lists[b"often"].kept) < 0.7 * len(segment.lists[b"often"].bounds)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "Cat"), (4, "cat"), (None, "cat dog"), (7, "cat " * 900)]
    items = [(1, "CAT"), (1, "cat"), (None, "dog"), (3, None), (4, "")]
    want = sorted(plain(docs, items), key=str)
    assert found(spark, docs, items) == want
    assert found(spark, docs[:3], items) == [] and found(spark, [], items) == []
    assert found(spark, docs, []) == []


def test_query_is_its_sql_twin(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({Q.OP13_SQL})").fetchall())
    got = Q.op13(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
