"""MinHash near-dedup and the near stage against the Jaccard similarity of all pairs."""

import random
from math import comb

import duckdb
import numpy as np
import pytest

import corpus_pipeline as C
from cueflow.llm import minhash as M
from cueflow.llm import queries as Q


def plain_set(text, words):
    own = (text or "").encode().lower().split()
    each = min(words, len(own))
    return {tuple(own[i:i + each]) for i in range(len(own) - each + 1)} if own else set()


def plain_roots(docs, words, hundredths):
    """Smallest id of each document's component over all pairs."""
    ids = sorted(docs)
    sets = {i: plain_set(docs[i], words) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= hundredths * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, sets


def corpus():
    """Texts with edits around the limits, chains, and a group of near copies unlike each other."""
    rng = random.Random(8)
    draw = lambda n: [f"W{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        own = draw(rng.randint(1, 400))
        texts.append(own)
        for _ in range(rng.randint(0, 4)):
            own = list(own)
            for _ in range(rng.randint(0, 1 + len(own) // 30)):
                own[rng.randrange(len(own))] = draw(1)[0]
            texts.append(own)
    hot = draw(150)
    for k in range(200):
        own = list(hot)
        for _ in range(k % 14):
            own[rng.randrange(150)] = f"t{k}"
        texts.append(own)
    texts += [[], [], draw(6000)]
    texts.append(texts[-1][:5600] + draw(100))
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("leaders, block", [(3, 512), (1, 40), (0, 512)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, leaders, block):
    monkeypatch.setattr(M, "LEADERS", leaders)
    monkeypatch.setattr(M, "BLOCK", block)
    docs = corpus()
    frame = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in docs.items()],
        "doc_id long, text string, node int, digest string").repartition(5)
    roots, sets = plain_roots(docs, 3, 85)
    assert len(set(roots.values())) < len(docs) - 100
    got = M.near_copies(frame, carry=("digest",)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept, r.digest) for r in got} == {
        i: (len(sets[i]), roots[i], roots[i] == i, "x") for i in docs}


def test_near_stage_keeps_what_all_pairs_keep(spark):
    docs = corpus()
    frame = spark.createDataFrame(
        [(i, t, 1) for i, t in docs.items()], "doc_id long, text string, node int").repartition(5)
    roots, _ = plain_roots(docs, 5, 80)
    empty = sorted(i for i in docs if not docs[i])[1:]  # equal texts without words meet too
    got = C.near(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({*roots.values()} - {*empty})


def test_posterior_bound():
    like = M.NEAR_COPIES
    bounds = like.least_matches()
    assert [n for n, _ in bounds] == [32, 64, 96, 128, 160, 192]
    p = 0.85 + 0.15 / 256
    for n, least in bounds:
        # numeric integral of the posterior above the limit, on either side of the bound
        x = np.linspace(0, 1, 200_001)
        for m, enough in ((least, True), (least - 1, False)):
            density = (n + 1) * comb(n, m) * x ** m * (1 - x) ** (n - m)
            mass = density[x >= p].sum() * (x[1] - x[0])
            assert (mass >= 1e-6 / 6 * 0.999) == enough
    rng = random.Random(3)
    words = [str(k) for k in range(3000)]
    miss = 0
    for _ in range(300):  # texts alike to just the limit pass
        a = rng.sample(words, 1000)
        b = a[:919] + [f"x{k}" for k in range(81)]
        s, t = (M.signature_of(M.minima(M.shingle_set(" ".join(x), 1), like)) for x in (a, b))
        miss += any((s[:n] == t[:n]).sum() < least for n, least in bounds)
    assert miss <= 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a  B"), (None, "a b"), (None, "z"), (None, "z"),
            (5, " "), (6, "Ä b"), (7, "ä b"), (3, "A b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), str(r.kept))
                 for r in M.near_copies(docs).collect())
    assert got == sorted([
        ("1", 0, "1", "True"), ("2", 0, "2", "True"), ("5", 0, "5", "True"),
        ("3", 1, "3", "True"), ("3", 1, "3", "True"), ("4", 1, "3", "False"),
        ("None", 1, "3", "None"), ("None", 1, "None", "None"), ("None", 1, "None", "None"),
        ("6", 1, "6", "True"), ("7", 1, "7", "True")])
    assert M.near_copies(docs.limit(0)).count() == 0
    stays = sorted(str(r.doc_id) for r in C.near(spark, docs, "").collect())
    assert stays == ["1", "3", "5", "6", "7", "None"]
    assert C.near(spark, docs.limit(0), "").count() == 0


def test_query_is_its_sql_twin(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(
        f"SELECT doc_id, n_shingles, component_id, kept FROM ({Q.OP11_SQL})").fetchall())
    got = sorted(tuple(r) for r in Q.op11(spark, folder).select(
        "doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want and any(not r[3] for r in want)
