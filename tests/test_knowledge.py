import random

from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.operators import knowledge as KB

SCHEMA = (
    "id long, wrong_term string, correct_term string, topic string, industry string, "
    "country string, tags array<string>, confidence double, count long"
)


def kb_of(spark, rows):
    return spark.createDataFrame(
        [(i, *r[:5], ["t"], 1.0, r[5]) for i, r in enumerate(rows, 1)], SCHEMA)


def test_upsert_counts_and_keeps_first_values(spark):
    kb = kb_of(spark, [("a", "b", "general", "general", "general", 3)])
    batch = spark.createDataFrame(
        [("a", "b", None, None, None, ["new"], 1), ("x", "y", "t", "i", "c", ["2nd"], 3),
         ("x", "y", "t", "i", "c", ["1st"], 2), ("p", "q", "t", "i", "c", [], 4)],
        "wrong_term string, correct_term string, topic string, industry string, country string, "
        "tags array<string>, seq long")
    rows = {r["wrong_term"]: r for r in KB.upsert(kb, batch).collect()}
    assert (rows["a"]["id"], rows["a"]["count"], rows["a"]["tags"]) == (1, 4, ["t"])
    assert (rows["x"]["id"], rows["x"]["count"], rows["x"]["tags"]) == (2, 2, ["1st"])
    assert (rows["p"]["id"], rows["p"]["count"], rows["p"]["confidence"]) == (3, 1, 1.0)


def _entries(rng, n):
    pick = lambda *values: rng.choice(values)
    keys = set()
    while len(keys) < n:
        keys.add((pick("w1", "w2", "W1"), pick("c1", "c2", "c3"), pick("general", "Tech", "tech", "x"),
                  pick("general", "Media", "y"), pick("general", "General", "Spain", "spain")))
    return [(*k, rng.randint(1, 15)) for k in sorted(keys)]


def test_best_correction_against_a_loop(spark):
    rng = random.Random(2)
    entries = _entries(rng, 60)
    contexts = [(t, i, c) for t in ("tech", "general", "none") for i in ("media", "GENERAL")
                for c in ("SPAIN", "general")]
    lookups = [(w, *c) for w in ("w1", "w2", "W1", "w9") for c in contexts]
    got = KB.best_corrections(
        kb_of(spark, entries), spark.createDataFrame(lookups, "term string, topic string, industry string, country string"))
    got = {tuple(r)[:4]: (r["correct_term"], r["score_tenths"]) for r in got.collect()}
    for term, topic, industry, country in lookups:
        best, best_score = None, -1
        for w, right, t, i, c, n in sorted(e for e in entries if e[0] == term):
            score = min(n, 10)
            score += 100 * (c.lower() == country.lower() != "general")
            score += 50 * (t.lower() == topic.lower() != "general")
            score += 50 * (i.lower() == industry.lower() != "general")
            if score > best_score:
                best, best_score = right, score
        expected = None if best is None else (best, best_score)
        assert got.get((term, topic, industry, country)) == expected


def test_relevance_classes_against_a_loop(spark):
    entries = _entries(random.Random(5), 300)
    kb = kb_of(spark, entries)
    asked = [("TECH", "media", "Spain"), ("none", "none", "none"), ("x", "general", "general"),
             (None, "media", "Spain")]
    contexts = spark.createDataFrame(asked, "topic string, industry string, country string")
    low = lambda v: None if v is None else v.lower()
    want = {}
    for topic, industry, country in asked:
        for _, _, t, i, c, _ in entries:
            same = [low(country) == c.lower(), low(topic) == t.lower(), low(industry) == i.lower()]
            mask = sum(1 << n for n, s in enumerate(same) if s)
            score = 2 * same[0] + same[1] + same[2] + 0.5 * (c == "general")
            if score > 0:
                key = (topic, industry, country, mask, c == "general", score)
                want[key] = want.get(key, 0) + 1
    classes = KB.relevance_classes(kb, contexts)
    assert {tuple(r)[:6]: r.entries for r in classes.collect()} == want
    best = classes.where("mask = 7")
    assert KB.class_members(kb, best).count() == sum(n for k, n in want.items() if k[3] == 7)


def test_relevance_and_top_entries_against_a_loop(spark):
    entries = _entries(random.Random(4), 80)
    kb = kb_of(spark, entries)
    contexts = spark.createDataFrame(
        [("TECH", "media", "Spain"), ("none", "none", "none"), ("x", "general", "general")],
        "topic string, industry string, country string")
    scores = {(r["topic"], r["id"]): r["score"] for r in KB.relevant_entries(kb, contexts).collect()}
    expected, listed = {}, {}
    for ctx in contexts.collect():
        for n, (w, right, t, i, c, _) in enumerate(entries, 1):
            s = 2 * (c.lower() == ctx["country"].lower()) + (t.lower() == ctx["topic"].lower())
            s += (i.lower() == ctx["industry"].lower()) + 0.5 * (c == "general")
            if s > 0:
                expected[(ctx["topic"], n)] = s
                listed.setdefault(ctx["topic"], []).append((w, n, right))
    assert scores == expected
    lines = {r["topic"]: r["kb_lines"] for r in KB.entry_lines(KB.top_entries(kb, contexts, 5)).collect()}
    for topic, found in listed.items():
        assert lines[topic] == "\n".join(f"- {w} -> {r}" for w, _, r in sorted(found)[:5])


def manifest_of(spark, entities, style="Loose"):
    entity = "struct<name:string,type:string,description:string,common_misspellings:array<string>>"
    return spark.createDataFrame(
        [("d", [(n, "T", None, m) for n, m in entities], style)],
        f"doc_id string, entities array<{entity}>, style_guide string",
    ).select("doc_id", F.struct("entities", "style_guide").alias("manifest"))


def test_replacement_map_order_and_precedence(spark):
    kb = kb_of(spark, [
        ("Chavi", "KB", "general", "general", "general", 1), ("k", "1", "general", "general", "general", 1),
        ("m2", "K2", "general", "general", "general", 1), ("k", "2", "t", "general", "general", 1)])
    manifests = manifest_of(spark, [("Name", ["Nam", "m1", "Xvi"]), ("Other", ["m1", "m2", "Chavi"])])
    replacements = dict(K.BUILTIN_SPELLINGS)
    for name, wrongs in [("Name", ["m1", "Xvi"]), ("Other", ["m1", "m2", "Chavi"])]:
        for wrong in wrongs:
            replacements[wrong] = name
    replacements.update({"Chavi": "KB", "k": "2", "m2": "K2"})
    own = KB.document_rules(manifests, kb).collect()
    mine = {r["wrong"] for r in own}
    rest = [r for r in KB.corpus_rules(kb).collect() if r["wrong"] not in mine]
    ordered = sorted([*own, *rest], key=lambda r: (r["stage"], r["n"]))
    assert [(r["wrong"], r["right"]) for r in ordered] == list(replacements.items())


def test_abbreviation_guard(spark):
    wrongs = lambda style: {r["wrong"] for r in KB.misspellings(
        manifest_of(spark, [("Manchester City", ["City", "city", "Man City", "Manchester Citi"])], style)).collect()}
    assert wrongs("Loose") == {"city", "Man City", "Manchester Citi"}
    assert wrongs("Strict news") == {"City", "city", "Man City", "Manchester Citi"}


def test_remove_entries(spark):
    kb = kb_of(spark, [("a", "b", "t", "i", "c", 1), ("c", "d", "t", "i", "c", 1)])
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    assert [r["id"] for r in KB.remove_entries(kb, ids).collect()] == [2]


def test_document_rules_are_dealt_out_before_they_are_sorted(spark):
    """One shuffle by document; nothing is aggregated before it, and terms meet the KB where they are."""
    from tests.test_plans import plan_of

    manifests = manifest_of(spark, [("Xavier", ["Chavi", "own", "kb"]), ("Iniesta", ["Chavi"])])
    kb = kb_of(spark, [("kb", "KB", "general", "general", "general", 1),
                       ("kb", "Kb", "news", "general", "general", 1)])
    rules = KB.document_rules(manifests, kb)
    plan = plan_of(rules)
    got = {r["wrong"]: (r["right"], r["stage"]) for r in rules.collect()}
    assert got == {"Chavi": ("Iniesta", 0), "own": ("Xavier", 1), "kb": ("Kb", 1)}
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan
    below = plan[plan.index("Exchange hashpartitioning(doc_id"):]
    assert "Aggregate" not in below.split("BroadcastExchange")[0]
