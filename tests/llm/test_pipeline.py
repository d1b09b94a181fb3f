"""The pipeline stage by stage against brute force, on a small table and on odd rows."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as C
from cueflow.llm import language_id, packing
from tests.llm.test_minhash import plain_roots
from tests.llm.test_suffix_dedup import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows after each stage, by name."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        out[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_language_goes_only_for_texts_without_one(steps):
    before = {r.doc_id: r for r in steps["documents"]}
    kept = {r.doc_id: r for r in steps["language"]}
    assert all(kept[i] == before[i] for i in kept)
    assert len(kept) >= 0.98 * len(before)
    assert all(language_id.LETTER.search(r.text) for r in kept.values())


def test_language_goes_for_gibberish(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rng = random.Random(12)
    strange = [("".join(rng.choices("bcdfghjklmnpqrstvwxyz0123456789+/=%&", k=500)), None),
               (" ".join("".join(rng.choices("qxzwkvjy", k=7)) for _ in range(70)), None)]
    plain = [("the", "en"), ("und", "de")]
    rows = [(9000 + i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(strange + plain)]
    added = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in C.by_language(spark, added, FOLDER).select("doc_id").collect()}
    assert not kept & {9000, 9001}
    assert kept >= {r.doc_id for r in C.by_language(spark, docs, FOLDER).select("doc_id").collect()}


def test_exact_copies(steps):
    last = defaultdict(int)
    for r in steps["language"]:
        last[r.text] = max(last[r.text], r.doc_id)
    assert sorted(r.doc_id for r in steps["exact"]) == sorted(last.values())


def test_near_copies(steps):
    """Against the Jaccard similarity of all pairs of five-word shingle sets."""
    docs = {r.doc_id: r.text for r in steps["exact"]}
    roots, _ = plain_roots(docs, 5, 80)
    assert sorted(r.doc_id for r in steps["near"]) == sorted({*roots.values()})


def test_passages(steps):
    texts = {r.doc_id: r.text for r in steps["near"]}
    _, gone = brute(texts)
    after = {r.doc_id: r.text for r in steps["passages"]}
    for i, text in texts.items():
        want = [w for p, w in enumerate(text.encode().split()) if p not in gone[i]]
        assert (after[i].encode().split() if i in after else []) == want
        if not gone[i]:
            assert after[i] == text
    assert all(r.n_chars == len(r.text) for r in steps["passages"])


def test_packing(steps):
    rows = steps["packing"]
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps["passages"]}
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in rows)
    assert packing.END_ID == 1


def test_run_gives_the_last_stage(spark, steps):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, C.run(spark, FOLDER).collect())) == sorted(map(key, steps["packing"]))


def test_odd_rows(spark):
    prose = "the cat and the dog sat on the mat and looked at the hat of the man " * 3
    docs = spark.createDataFrame(
        [(1, prose, "en", None, 1), (2, prose, None, "s", None), (2, prose, None, "s", None),
         (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "123", "en", "s", 3),
         (None, prose + "x", "en", "s", 9), (None, prose + "x", "en", "s", 9)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name == "exact":
            assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["2", "None"]
    assert docs.select("doc_id").distinct().count() >= 1
    empty = spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0


def test_clashing_names(spark):
    """Columns named like those that the stages make come through unchanged."""
    prose = "the cat and the dog sat on the mat and looked at the hat of the man " * 3
    clash = ["lang_pred", "score", "bits", "row", "usual", "__id", "__digest", "__stays", "__times",
             "node", "digest", "size", "keys", "signature", "row_id", "id", "root", "doc", "words"]
    docs = spark.createDataFrame(
        [(1, prose + "a"), (2, prose + "a"), (3, prose + "b c d e f g h i j k l m n o p q r s")],
        "doc_id long, text string").selectExpr(
        "*", "'en' lang", "'s' source", "length(text) n_chars", *(f"'x{i}' `{c}`" for i, c in enumerate(clash)))
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        assert rows and all(r[c] == f"x{i}" for r in rows for i, c in enumerate(clash))
    assert C.packed(spark, docs, FOLDER).count() >= len(rows)
