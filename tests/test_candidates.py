import math
import itertools
import random
import re
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from cueflow.operators import candidates as C
from cueflow.operators import prompts, stats, tenant
from cueflow.operators.diffs import preserved_terms
from tests.test_knowledge import kb_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_neighbours_against_brute_force(spark):
    rng = random.Random(13)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(400)}
    known = {w: rng.randint(2, 9) for w in sorted(words) if rng.random() < 0.6}
    unknown = sorted(words - set(known))
    got = {}
    near = C.edit_neighbours(
        spark.createDataFrame([(w, 1) for w in unknown], "word string, uses long"),
        spark.createDataFrame(list(known.items()), "word string, uses long"))
    for r in near.orderBy("word", "rank").collect():
        got.setdefault(r["word"], []).append((r["distance"], r["candidate"]))
    for w in unknown:
        ranked = sorted((d, -n, k) for k, n in known.items() if (d := distance(w, k)) <= 2)
        assert got.get(w, []) == [(d, k) for d, _, k in ranked[:12]]


def test_deletion_keys_are_all_ways_and_compiled(spark):
    """Keys are those of every choice of up to two characters; no function runs over an array."""
    from tests.test_plans import plan_of

    rng = random.Random(4)
    words = {"", "a", "aa", "aba", "aab", "ñandú"} | {
        "".join(rng.choice("aabcñ") for _ in range(rng.randint(1, 16))) for _ in range(200)}
    left = []
    for w in words:
        for n in range(3):
            for out in itertools.combinations(range(len(w[:12])), n):
                left.append((w, "".join(c for i, c in enumerate(w[:12]) if i not in out)))
    expected = spark.createDataFrame(left, "word string, left string").select(
        "word", F.xxhash64("left").alias("key")).distinct().collect()
    table = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, uses long")
    keyed = C.with_deletion_keys(table)
    assert {(r.word, r.key) for r in keyed.collect()} == {tuple(r) for r in expected}
    assert "lambda" not in plan_of(C.edit_neighbours(table, table))


def test_vocabulary_and_unknown_words(spark):
    texts = spark.createDataFrame([("The cat, the café",), ("cat's 42 ab " + "x" * 41,)], "text string")
    counts = C.token_counts(texts)
    assert {(r["word"], r["uses"]) for r in C.vocabulary(counts).collect()} == {("the", 2), ("cat", 2)}
    assert {r["word"] for r in C.unknown_words(counts).collect()} == {"café"}


def test_gates_and_guards(spark):
    rows = spark.createDataFrame(
        [("the contrast was", "the contract was"), ("abc", "xyz"), ("", "")], "a string, b string")
    got = [tuple(r) for r in rows.select(
        C.passes_edit_gate(F.col("a"), F.col("b"), 0.15), C.edit_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [(True, 1 / 16), (False, 1.0), (True, 0.0)]
    text = "Paid €5.50 on 2024-01-02 at 10:30, see https://x.y/z or 7"
    row = spark.createDataFrame([(text,)], "t string").select(*C.guard_counts(F.col("t"))).first()
    assert row["url_spans"] == 1 and row["date_spans"] == 1 and row["time_spans"] == 1
    assert row["currency_spans"] == 1
    touched = spark.createDataFrame([("at 10:30",), ("Paid",), ("0:3",), ("see",)], "o string").select(
        C.touches_guard(F.lit(text), F.col("o"), F.array(F.lit("see"))).alias("t")).collect()
    assert [r["t"] for r in touched] == [True, False, True, True]


def test_guards_go_by_position(spark):
    rng = random.Random(2)
    rows = [("Paid €5.50 on monday", "Paid €5"), ("a 5 b a c", "a "), ("5 5", "5"), ("x", "")]
    for _ in range(200):
        text = "".join(rng.choice("a1 €.:/5\x01\x02\U0001f600") for _ in range(rng.randint(1, 14)))
        at = rng.randrange(len(text))
        rows.append((text, text[at:at + rng.randint(1, 4)]))

    rows += [("aa 5" * 300 + "aaa", "aaa"), ("1 aa" * 300 + "aaa", "aa"), ("9 " * 400 + "x9", "x9")]

    def plain(text, original):
        spans = [m.span() for p in C.GUARDS.values() for m in re.finditer(p, text)]
        places = [(i, i + len(original)) for i in range(len(text) - len(original) + 1)
                  if original and text[i:i + len(original)] == original]
        return any(a < d and c < b for a, b in places for c, d in spans)

    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                  "i int, text string, original_text string")
    kept = {r.i for r in C.unguarded_proposals(table).collect()}
    assert kept == {i for i, r in enumerate(rows) if not plain(*r)}


def test_equal_scores_go_to_the_smaller_neighbour(spark):
    rows = [("d", i, [1.0, 0.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id string, pos long, vector array<double>")
    for block in (8, 512):
        near = C.context_neighbours(table, floor=0.1, top=3, block=block)
        got = [r.neighbour for r in near.where("pos = 20").orderBy("rank").collect()]
        assert got == [19, 21, 18]


def test_blocks_too_far_apart_are_not_built(spark):
    """Four topics of 32 segments each: blocks of 8 meet those of their own topic only."""
    rng = np.random.default_rng(6)
    axes = np.eye(12)[:4]
    vectors = np.vstack([axis + rng.normal(scale=0.03, size=(32, 12)) for axis in axes])
    vectors[5] = 0
    table = spark.createDataFrame(
        [("d", i, v.tolist()) for i, v in enumerate(vectors)], "doc_id string, pos long, vector array<double>")
    assert C.near_blocks(table, 0.5, block=8).count() == 4 * (4 * 5 // 2)
    assert C.near_blocks(table, -1.0, block=8).count() == 16 * 17 // 2
    few, one = (sorted(map(tuple, C.context_neighbours(table, top=5, block=b).collect()))
                for b in (8, 512))
    assert [r[:3] for r in few] == [r[:3] for r in one] and len(few) == 127 * 5


def test_blocks_hold_consecutive_segments_where_numbers_lack(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 6))
    rows = [("d", 1000 * i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(
        [*rows, ("d", 7, None), ("e", 1, None)], "doc_id string, pos long, vector array<double>")
    kept = table.where("vector is not null")
    assert C.near_blocks(kept, -1.0, block=8).count() == 5 * 6 // 2
    few, one = (sorted((r.pos, r.rank, r.neighbour) for r in C.context_neighbours(
        table, floor=0.1, top=3, block=b).collect()) for b in (8, 512))
    assert few == one and len({pos for pos, _, _ in few}) == 40


def test_context_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = {"a": rng.normal(size=(50, 6)), "b": rng.normal(size=(7, 6)), "c": rng.normal(size=(1, 6))}
    rows = [(d, i, v.tolist()) for d, m in docs.items() for i, v in enumerate(m)]
    near = C.context_neighbours(
        spark.createDataFrame(rows, "doc_id string, pos long, vector array<double>"),
        floor=0.2, top=4, block=8)
    got = {}
    for r in near.orderBy("doc_id", "pos", "rank").collect():
        got.setdefault((r["doc_id"], r["pos"]), []).append(r["neighbour"])
    for d, m in docs.items():
        for i in range(len(m)):
            scored = []
            for j in range(len(m)):
                sim = m[i] @ m[j] / np.linalg.norm(m[i]) / np.linalg.norm(m[j])
                if i != j and sim >= 0.2:
                    scored.append((-(0.7 * sim + 0.3 * math.exp(-abs(i - j) / 7.0)), j))
            assert got.get((d, i), []) == [j for _, j in sorted(scored)[:4]]


def test_ranking(spark):
    features = {n: F.lit(0.0) for n in
                ["delta_logp", "edit_penalty", "vocab_support", "neighbor_support", "locked_penalty"]}
    score = spark.range(1).select(C.linear_score(features)).first()[0]
    assert abs(score - 1 / (1 + math.exp(0.4))) < 1e-12
    scored = spark.createDataFrame(
        [("d", 0, "b", 0.9), ("d", 0, "a", 0.9), ("d", 1, "c", 0.5)],
        "doc_id string, pos long, candidate string, score double")
    assert [r["candidate"] for r in C.best_candidates(scored, 0.75).collect()] == ["a"]


def test_scores_go_by_the_nearest_exponential(spark):
    """Spark's own `exp` is one unit off for about a tenth of these."""
    rng = random.Random(3)
    values = [0.0, -1.174, 1.86, 1.884] + [rng.uniform(-30, 30) for _ in range(4000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", C.nearest_exp(F.col("x")).alias("y")).collect()
    assert [r.x for r in got if r.y != float(Decimal(r.x).exp())] == []


def test_missing_scores_come_last(spark):
    scored = spark.createDataFrame(
        [("d", 0, "a", None), ("d", 0, "b", 0.9), ("d", 1, "a", 0.9), ("d", 1, "b", float("nan")),
         ("d", 2, "a", 0.9), ("d", 2, None, 0.9), ("d", 3, "a", None)],
        "doc_id string, pos long, candidate string, score double")
    best = C.best_candidates(scored, 0.75).orderBy("pos").collect()
    assert [(r.pos, r.candidate) for r in best] == [(0, "b"), (1, "b"), (2, "a")]


def test_tenant_memory(spark):
    bands = spark.createDataFrame([(x,) for x in (0.0, 0.49, 0.5, 0.75, 0.9, 1.0, 1.1)], "c double").select(
        tenant.confidence_band(F.col("c"))).collect()
    assert [r[0] for r in bands] == ["low", "low", "medium", "high", "very_high", "very_high", None]
    history = spark.createDataFrame(
        [("t", 1, True, "2024-01-01 10:00:00"), ("t", 1, None, "2024-01-02 10:00:00"),
         ("t", 2, False, "2024-01-01 11:00:00")],
        "tenant_id string, correction_id long, was_successful boolean, applied_at string",
    ).withColumn("applied_at", F.to_timestamp("applied_at"))
    known = spark.createDataFrame(
        [("t", 1, "a", "x", 0.8), ("t", 2, "a", "y", 0.8), ("t", 3, "a", "z", 0.7)],
        "tenant_id string, id long, original_text string, corrected_text string, confidence double")
    full = tenant.with_outcomes(known, history)
    assert {(r["id"], r["usage_count"], r["success_rate"]) for r in full.collect()} == {
        (1, 2, 0.5), (2, 1, 0.0), (3, 0, 0.0)}
    asked = spark.createDataFrame([("t", "a"), ("t", "q")], "tenant_id string, original_text string")
    best = {r["original_text"]: r["id"] for r in tenant.best_tenant_corrections(full, asked).collect()}
    assert best == {"a": 1, "q": None}
    assert tenant.daily_history(history).count() == 2


def test_sample_text(segments):
    small = [("s", i + 1, i, i + 1, f"s{i}") for i in range(100)]
    large = [("l", i + 1, i, i + 1, f"l{i}") for i in range(101)]
    got = {r["doc_id"]: r["sample_text"] for r in stats.context_sample(segments(small + large)).collect()}
    assert got["s"] == "\n".join(f"s{i}" for i in range(100))
    assert got["l"] == "\n".join([f"l{i}" for i in range(50)] + ["..."] + [f"l{i}" for i in range(50, 100)])


def test_request_rows(spark, segments):
    entity = "struct<name:string,type:string,description:string,common_misspellings:array<string>>"
    manifest = spark.createDataFrame(
        [("d", "Football", "Talk", "Sport", "Spain", "Std", "s",
          [("Xavi", "Person", "coach", ["Chavi"]), ("Barça", "Org", None, [])], [f"p{i}" for i in range(7)], "Loose")],
        "doc_id string, topic string, genre string, industry string, country string, dialect string, "
        f"summary string, entities array<{entity}>, preservation_list array<string>, style_guide string")
    manifests = manifest.select("doc_id", F.struct(*manifest.columns[1:]).alias("manifest"))
    kb = kb_of(spark, [("b", "B", "football", "x", "x", 1), ("a", "A", "x", "x", "general", 1), ("c", "C", "x", "x", "x", 1)])
    seg = segments([("d", i + 1, i, i + 1, f"t{i}") for i in range(31)])
    rows = prompts.prompt_requests(seg, manifests, kb).orderBy("chunk_no").collect()
    assert [r["chunk_text"].count("\n") for r in rows] == [30, 1]
    assert rows[1]["chunk_text"] == "[31] t30\n"
    assert rows[0]["kb_lines"] == "- a -> A\n- b -> B"
    assert rows[0]["preserved_terms"] == "p0, p1, p2, p3, p4"
    assert rows[0]["manifest_text"].endswith(
        "KEY ENTITIES:\n- Barça (Org):  (Watch out for: )\n- Xavi (Person): coach (Watch out for: Chavi)\n")


def test_preserved_terms(spark):
    before = spark.createDataFrame([("d", "definately ABEG")], "doc_id string, content string")
    after = spark.createDataFrame([("d", "definitely abeg")], "doc_id string, content string")
    wanted = spark.createDataFrame(
        [("d", ["Abeg", "wahala"], "Pidgin", "Nigerian pidgin")],
        "doc_id string, terms array<string>, dialect string, found_dialect string")
    [row] = preserved_terms(before, after, wanted).collect()
    assert tuple(row) == ("d", 1, 2, True, True)


def test_requests_and_presets_lose_no_document(spark, segments):
    from cueflow.plans.validation import preset_issues

    seg = segments([("a", 1, 0, 5, "x"), ("b", 1, 0, 5, "y")])
    none = spark.createDataFrame([], "doc_id string, payload string")
    from cueflow.sources.payloads import read_manifests
    rows = prompts.prompt_requests(seg, read_manifests(none), kb_of(spark, [])).collect()
    assert {r.doc_id for r in rows} == {"a", "b"}
    preset = F.when(F.col("doc_id") == "a", "no such preset")
    issues = preset_issues(seg.withColumn("preset", preset)).collect()
    assert {(r.doc_id, r.preset) for r in issues} == {("a", "no such preset"), ("b", None)}
