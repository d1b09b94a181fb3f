import random

from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.ordered import number_in_order, running_sum, with_next, with_previous
from cueflow.functions.skew import join_spread
from cueflow.functions.text import one_decimal, squash, strip, words
from cueflow.operators import intervals, rules, stats
from cueflow.operators.cleaning import drop_empty
from cueflow.plans import validation
from tests.test_plans import plan_of


def found(issues):
    return sorted((r["doc_id"], r["segment_idx"], r["issue_type"], r["severity"]) for r in issues.collect())


def test_every_segment_rule(segments):
    seg = segments([
        ("a", 1, 0, 499, "x"), ("a", 2, 0, 1499, "x"), ("a", 3, 0, 10001, "x"),
        ("a", 4, 0, 6001, "x"), ("a", 5, 0, 2000, "x" * 51), ("a", 6, 0, 2000, "x" * 35),
        ("a", 7, 0, 2000, " \t"), ("a", 8, 0, 2000, "a\nb\nc"), ("a", 9, 0, 6000, "x" * 81),
        ("a", 10, 0, 6000, "ok\n" + "x" * 43), ("a", 11, -5, 2000, "x"), ("a", 12, 5, 5, "x"),
        ("a", 13, 900, 100, "x"), ("a", 14, 0, 1500, "x"),
    ])
    kinds = {}
    for _, idx, kind, severity in found(rules.segment_issues(seg)):
        kinds.setdefault(idx, []).append((kind, severity))
    assert kinds == {
        1: [("duration_too_short", "error")], 2: [("duration_short", "warning")],
        3: [("duration_too_long", "error")], 4: [("duration_long", "warning")],
        5: [("cps_too_high", "error"), ("line_long", "warning")],
        6: [("cps_high", "warning")], 7: [("empty_text", "error")],
        8: [("too_many_lines", "warning")], 9: [("line_too_long", "warning")],
        10: [("line_long", "warning")], 11: [("negative_start", "error")],
        12: [("duration_too_short", "error"), ("invalid_timing", "error")],
        13: [("duration_too_short", "error"), ("invalid_timing", "error")],
    }
    strict = dict((i, s) for _, i, k, s in found(
        rules.segment_issues(seg, ["too_many_lines", "line_too_long"], strict=True)))
    assert strict == {8: "error", 9: "error"}


def test_messages_and_details(segments):
    seg = segments([("a", 1, 0, 2000, "x" * 40), ("a", 2, 0, 2000, "y\n" + "x" * 50)])
    rows = {r["issue_type"]: r for r in rules.segment_issues(seg).where("segment_idx = 2").collect()}
    assert rows["cps_too_high"]["message"] == "CPS (26.0) exceeds maximum (25.0)"
    assert rows["line_long"]["message"] == "Line 2 has 50 characters (target: 42)"
    assert rows["line_long"]["details"] == {"line_number": "2", "line_length": "50"}
    [first] = rules.segment_issues(seg, ["cps_high"]).collect()
    assert first["message"] == "CPS (20.0) exceeds target (17.0)"


def test_one_decimal_rounds_as_python_does(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(20, 3000), rng.randint(500, 9000)) for _ in range(3000)]
    pairs += [(n, 1000 * d) for n in range(20, 1500) for d in (1, 2, 4)]
    pairs += [(n, d) for n in range(343, 700) for d in (20000, 4000, 8000) if n * 1000 / d > 16]
    pairs = [(c, d) for c, d in pairs if c / (d / 1000) >= 16]
    rows = spark.createDataFrame(pairs, "c int, d long").select(
        "c", "d", one_decimal(F.col("c"), F.col("d")).alias("t")).collect()
    assert [r for r in rows if r["t"] != f"{r['c'] / (r['d'] / 1000):.1f}"] == []


def test_text_helpers_match_python(spark):
    texts = ["  a b ", "　x ", "\x1c a b \x1f", "", " \n", "a​b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip(F.col("t")).alias("s"), words(F.col("t")).alias("w"), squash(F.col("t")).alias("q")
    ).collect()
    for r in rows:
        assert (r["s"], r["w"], r["q"]) == (r["t"].strip(), r["t"].split(), " ".join(r["t"].split()))


def brute_pairs(rows):
    return {
        (d, i, j)
        for d, spans in rows.items()
        for i in range(len(spans)) for j in range(i + 1, len(spans))
        if not (spans[i][1] <= spans[j][0] or spans[i][0] >= spans[j][1])
    }


def test_overlaps_against_brute_force(segments):
    rng = random.Random(11)
    docs = {}
    for d in range(40):
        scale = rng.choice([50, 5_000, 400_000, 90_000_000])
        spans = []
        for _ in range(rng.randint(1, 40)):
            start = rng.randint(-scale, 3 * scale)
            length = rng.choice([0, 1, rng.randint(0, scale), -rng.randint(0, scale // 3)])
            spans.append((start, start + length))
        docs[f"d{d}"] = spans
    seg = segments([(d, i, s, e, "x") for d, spans in docs.items() for i, (s, e) in enumerate(spans)])
    expected = brute_pairs(docs)
    pairs = intervals.overlap_pairs(seg).collect()
    assert len(pairs) == len(expected)
    assert {(r["doc_id"], r["pos_i"], r["pos_j"]) for r in pairs} == expected
    counts = {r["doc_id"]: r["overlap_count"] for r in intervals.overlap_counts(seg).collect()}
    for d in docs:
        assert counts.get(d, 0) == sum(1 for p in expected if p[0] == d)


def test_order_issues_across_blocks(segments):
    rng = random.Random(5)
    spans = [(s := rng.randint(0, 10**6), s + rng.randint(1, 9000)) for _ in range(9000)]
    seg = segments([("hot", i + 1, s, e, "x") for i, (s, e) in enumerate(spans)])
    expected = []
    for i in range(1, len(spans)):
        if spans[i][0] < spans[i - 1][0]:
            expected.append(("hot", i + 1, "out_of_order", "error"))
        if spans[i][0] - spans[i - 1][1] > 10000:
            expected.append(("hot", i + 1, "large_gap", "warning"))
    assert found(rules.order_issues(seg)) == sorted(expected)


def test_neighbour_and_running_helpers(spark):
    rows = spark.createDataFrame([("k", i, i * 3 % 7) for i in range(50)], "k string, pos long, v long")
    linked = with_next(with_previous(rows, ["k"], "pos", ["v"], block=8), ["k"], "pos", ["v"], block=8)
    for r in linked.collect():
        i = r["pos"]
        assert r["prev_v"] == ((i - 1) * 3 % 7 if i else None)
        assert r["next_v"] == ((i + 1) * 3 % 7 if i < 49 else None)
    sums = running_sum(rows, ["k"], ["pos"], F.col("v"), "s", F.floor(F.col("pos") / 8))
    got = {r["pos"]: r["s"] for r in sums.collect()}
    assert got == {i: sum(j * 3 % 7 for j in range(i + 1)) for i in range(50)}


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1009).alias("x"))
    got = number_in_order(rows, ["x"], "n", F.lit(5)).orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))


def test_merge_and_clip(segments):
    seg = segments([
        ("a", 1, 0, 1000, "A"), ("a", 2, 1050, 2000, "B"), ("a", 3, 2200, 3000, "C"),
        ("a", 4, 2900, 4000, "D"), ("b", 1, 0, 10, "E"),
    ])
    merged = [tuple(r) for r in intervals.merge_adjacent(seg).orderBy("doc_id", "pos").select(
        "doc_id", "pos", "start_ms", "end_ms", "merged_cues", "text").collect()]
    assert merged == [("a", 0, 0, 2000, 2, "A B"), ("a", 1, 2200, 4000, 2, "C D"), ("b", 0, 0, 10, 1, "E")]
    parts = intervals.merge_adjacent(seg, gap_ms=10**6, part_cues=2).where("doc_id = 'a'")
    assert [(r["part_no"], r["text"], r["end_ms"]) for r in parts.orderBy("part_no").collect()] == [
        (0, "A B", 4000), (1, "C D", 4000)]
    clipped = {(r["doc_id"], r["pos"]): r["end_ms"] for r in intervals.clip_overlaps(seg).collect()}
    assert clipped[("a", 2)] == 2900 and clipped[("a", 3)] == 4000


def test_report_covers_empty_documents(spark, segments):
    docs = spark.createDataFrame([("a",), ("none",)], "doc_id string")
    seg = segments([("a", 1, 0, 2000, "fine"), ("a", 2, 1000, 3000, "fine")])
    report = {r["doc_id"]: r for r in validation.validation_report(seg, docs).collect()}
    assert report["a"]["overlap_count"] == 1 and report["a"]["errors"] == 1
    assert report["none"]["segment_count"] == 0 and not report["none"]["valid"]
    issues = validation.all_issues(seg, docs)
    assert found(issues.where("doc_id = 'none'")) == [("none", None, "empty_document", "error")]
    totals = {r["doc_id"]: r["errors"] for r in stats.issue_counts(issues).collect()}
    assert totals == {"a": 1, "none": 1}


def test_total_duration_is_the_last_end(segments):
    seg = segments([("a", 1, 0, 9000, "x"), ("a", 2, 100, 2000, "xyz")])
    [row] = stats.document_stats(seg).collect()
    assert row["total_duration_ms"] == 2000 and row["max_duration_ms"] == 9000
    assert row["total_characters"] == 4 and row["avg_duration_ms"] == 5450.0


def test_presets_and_ranges(spark):
    presets = validation.preset_table(spark)
    assert presets.count() == len(K.PRESETS)
    assert validation.settings_faults(presets).count() == 0
    faults = validation.settings_faults(presets.limit(1).withColumn("line_wrap", F.lit(81)))
    assert [(r["setting"], r["value"]) for r in faults.collect()] == [("line_wrap", 81.0)]


def test_preview(segments):
    seg = segments([("a", i + 1, 0, 1, "um yes") for i in range(12)])
    shown = stats.preview(seg, F.replace("text", F.lit("um "), F.lit("")))
    [row] = stats.preview_reduction(shown).collect()
    assert row["segments"] == 10 and row["reduction_percent"] == 50.0
    assert stats.preview(seg, F.col("text"), indices=[2, 12, 40]).count() == 2


def test_spread_join_equals_the_plain_join(spark):
    large = spark.range(3000).selectExpr("if(id % 3 > 0, 'hot', cast(id as string)) k", "id")
    small = spark.createDataFrame([("hot", 1), ("0", 2), ("999", 3)], "k string, v long")
    for how in ("inner", "left", "left_anti"):
        plain = large.join(small, "k", how)
        spread = join_spread(large, small, ["k"], how, by=["id"])
        assert sorted(map(str, spread.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_dropping_empty_segments_recounts_positions(segments):
    seg = segments([("a", i + 1, i, i + 1, " \n" if i % 3 == 0 else "x") for i in range(9000)])
    kept = drop_empty(seg).orderBy("pos").collect()
    assert [r["pos"] for r in kept] == list(range(6000))
    assert [r["idx"] for r in kept] == [i + 1 for i in range(9000) if i % 3]


def test_a_broken_end_multiplies_its_own_document_only(spark, segments):
    """One cue of a hundred days: only its document's starts stand in cells of that width."""
    rows = [("long", 0, 0, 100 * 86_400_000, "x")]
    rows += [("long", i, i * 1000, i * 1000 + 900, "x") for i in range(1, 40)]
    rows += [(f"d{d}", i, i * 1000, i * 1000 + 1001, "x") for d in range(50) for i in range(20)]
    seg = segments(rows)
    pairs = intervals.overlap_pairs(seg)
    got = {(r.doc_id, r.pos_i, r.pos_j) for r in pairs.collect()}
    assert got == {("long", 0, i) for i in range(1, 40)} | {
        (f"d{d}", i, i + 1) for d in range(50) for i in range(19)}
    plan = plan_of(pairs)
    assert "Subquery" not in plan and "BroadcastNestedLoopJoin" not in plan
