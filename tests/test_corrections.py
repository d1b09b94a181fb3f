import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from cueflow.operators import cleaning, consistency, diffs
from cueflow.operators import proposals as P
from cueflow.plans.correction import correct_segments, document_contents, learn_corrections
from cueflow.sources import payloads
from tests.test_knowledge import kb_of, manifest_of

PROPOSALS = (
    "doc_id string, chunk_no long, prop_no int, segment_id long, original_text string, "
    "corrected_text string, type string, reason string"
)


def proposals_of(spark, rows):
    return spark.createDataFrame(
        [("d", (seg - 1) // 30, n, seg, a, b, "entity", "r") for n, (seg, a, b) in enumerate(rows)],
        PROPOSALS)


def run(spark, segments, texts, rows):
    seg = segments([("d", i + 1, i * 1000, i * 1000 + 900, t) for i, t in enumerate(texts)])
    chunks = P.correct_chunks(seg, proposals_of(spark, rows))
    fixed = [r["text"] for r in P.corrected_segments(chunks).orderBy("pos").collect()]
    log = P.applied_proposals(chunks).orderBy("chunk_no", "apply_no").collect()
    return fixed, [(r["original_text"], r["reason"]) for r in log]


CASES = {
    "all occurrences": (["a b a"], [(1, "a", "X")], ["X b X"], [("a", "r")]),
    "no-op": (["a"], [(1, "a", "a")], ["a"], []),
    "not found": (["a"], [(1, "zz", "X")], ["a"], []),
    "empty original": (["a"], [(1, "", "X")], ["a"], []),
    "longest first": (["Man City"], [(1, "Man", "X"), (1, "Man City", "Y")], ["Y"], [("Man City", "r")]),
    "later sees earlier output": (["ab"], [(1, "ab", "cdd"), (1, "d", "e")], ["cee"], [("ab", "r"), ("d", "r")]),
    "other chunk's number": (["a"], [(40, "a", "X")], ["a"], []),
    "forward split": (
        ["see Man", "City win"], [(1, "Man City", "Manchester City")],
        ["see Manchester City", "win"], [("Man City", "r (Split Segment Fix)")]),
    "forward split empties the next": (
        ["see Man", "City"], [(1, "Man City", "MC")], ["see MC", ""], [("Man City", "r (Split Segment Fix)")]),
    "next sees the shortened text": (
        ["see Man", "City win"], [(1, "Man City", "MC"), (2, "City win", "lost")],
        ["see MC", "win"], [("Man City", "r (Split Segment Fix)")]),
    "no forward split point": (["Man x", "City"], [(1, "Man City", "MC")], ["Man x", "City"], []),
    "backward split at the end": (
        ["see Man", "City win"], [(2, "Man City", "MC")],
        ["see MC", "win"], [("Man City", "r (Backward Split Fix)")]),
    "backward only without a next": (
        ["see Man", "City win", "z"], [(2, "Man City", "MC")], ["see Man", "City win", "z"], []),
    "line breaks between the parts": (
        ["see Man\n", "  City win"], [(1, "Man City", "MC")],
        ["see MC", "win"], [("Man City", "r (Split Segment Fix)")]),
}


@pytest.mark.parametrize("name", CASES)
def test_proposals(spark, segments, name):
    texts, rows, fixed, log = CASES[name]
    assert run(spark, segments, texts, rows) == (fixed, log)


def test_chunk_border_blocks_the_repair(spark, segments):
    texts = [f"t{i}" for i in range(29)] + ["see Man", "City win"]
    fixed, log = run(spark, segments, texts, [(30, "Man City", "MC")])
    assert fixed == texts and log == []


def test_duplicate_numbers_all_get_the_correction(spark, segments):
    seg = segments([("d", 1, 0, 1, "a x"), ("d", 1, 1, 2, "a y")])
    chunks = P.correct_chunks(seg, proposals_of(spark, [(1, "a", "b")]))
    assert sorted(r["text"] for r in P.corrected_segments(chunks).collect()) == ["b x", "b y"]
    assert P.applied_proposals(chunks).count() == 2


def test_native_and_repair_ways_agree(spark, segments):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(6)) for _ in range(60)]
    rows = [(rng.randint(1, 60), rng.choice(["a", "b", "ab", "c", "a b"]), rng.choice("xyab"))
            for _ in range(80)]
    seg = segments([("d", i + 1, i, i + 1, t) for i, t in enumerate(texts)])
    listed = proposals_of(spark, rows)
    native = P.corrected_segments(P.correct_chunks(seg, listed, repair_splits=False))
    expected = list(texts)
    for i in range(60):
        mine = sorted((r for r in rows if r[0] == i + 1), key=lambda r: -len(r[1]))
        for _, a, b in mine:
            if a in expected[i] and a != b:
                expected[i] = expected[i].replace(a, b)
    assert [r["text"] for r in native.orderBy("pos").collect()] == expected


def test_stray_and_rejected(spark, segments):
    seg = segments([("d", 1, 0, 1, "a")])
    listed = proposals_of(spark, [(1, "a", "b"), (1, "q", "b"), (2, "a", "b")])
    assert [r["prop_no"] for r in P.stray_proposals(seg, listed).collect()] == [2]
    left = P.rejected_proposals(P.correct_chunks(seg, listed), listed)
    assert sorted(r["prop_no"] for r in left.collect()) == [1, 2]


def python_rules(text, rules):
    for wrong, right in rules:
        text = re.sub(r"\b" + re.escape(wrong) + r"\b", lambda m: right, text, flags=re.I)
    return text


RULES = [
    ("Frankie de Jong", "Frenkie de Jong"), ("Frankie", "Frenkie"), ("Chavi", "Xavi"),
    ("xavi plays", "XAVI $1 \\ plays"), ("F.C.", "FC"), ("café", "Kaffee"), ("a", "b"), ("b", "c"),
    ("c c", "d"), ("...", "…"), ("c++", "cpp"), ("#tag", "tag"), ("d", ""), ("(x)", "y"), ("e\\E", "z"),
]
TEXTS = [
    "frankie DE jong and Frankie", "Chavi plays well", "F.C. Bar and F.C.x", "Café CAFÉ cafés décafé",
    "a b c a", "a a", "wait...what ...", "c++ c++x xc++", "x#tag #tag", "q(x)q (x)", "e\\E e\\Ee",
    "nothing to do", "", "Xavi plays", "\n a\nb ",
]


def test_rules_match_python(spark, segments):
    seg = segments([("d", i + 1, i, i + 1, t) for i, t in enumerate(TEXTS)])
    rules = spark.createDataFrame(
        [(w, r, 2, n) for n, (w, r) in enumerate(RULES)], "wrong string, right string, stage int, n long")
    expected = [python_rules(t, RULES) for t in TEXTS]
    got = consistency.enforce_rules(seg, rules).orderBy("pos").collect()
    assert [r["text"] for r in got] == expected


def test_rules_per_document(spark, segments):
    kb = kb_of(spark, [("kb", "KB", "general", "general", "general", 1)])
    manifests = manifest_of(spark, [("Xavier", ["Chavi", "own", "kb"])])
    seg = segments([("d", 1, 0, 1, "Chavi own kb Frankie"), ("e", 1, 0, 1, "Chavi own kb Frankie")])
    none = spark.createDataFrame([], PROPOSALS)
    result = correct_segments(seg, none, kb, manifests)
    got = {r["doc_id"]: r["text"] for r in result.corrected.collect()}
    assert got == {"d": "Xavier Xavier KB Frenkie", "e": "Xavi own KB Frenkie"}
    assert {r["doc_id"] for r in result.changes.collect()} == {"d", "e"}
    assert result.content().count() == 2


def test_chains_and_glued_words_match_python(spark, segments, monkeypatch):
    """Rules that write each other's words, also across the edges of what they replace."""
    rng = random.Random(17)
    parts = ["a", "b", "ab", "ba", "é", "(", "-", ".", " ", "  ", "A"]
    draw = lambda most: "".join(rng.choices(parts, k=rng.randint(1, most)))
    for round_ in range(3):
        rules = list(dict((draw(3).lower(), draw(3) if rng.random() < 0.9 else "") for _ in range(25)).items())
        texts = [draw(14) for _ in range(60)]
        monkeypatch.setattr(consistency, "FEW_RULES", 5000 if round_ else 0)
        seg = segments([("d", i + 1, i, i + 1, t) for i, t in enumerate(texts)])
        table = spark.createDataFrame(
            [(w, r, 2, n) for n, (w, r) in enumerate(rules)], "wrong string, right string, stage int, n long")
        got = [r["text"] for r in consistency.enforce_rules(seg, table).orderBy("pos").collect()]
        assert got == [python_rules(t, rules) for t in texts]


@pytest.mark.parametrize("count", [3, 199, 201])
def test_any_number_of_rules_gives_the_same_text(spark, segments, count):
    rules = [("miss", "MR"), ("kelvin", "KEL"), ("όσος", "OSOS")]
    rules += [(f"w{i}", f"v{i}") for i in range(count - len(rules))]
    table = spark.createDataFrame(
        [(w, r, 2, n) for n, (w, r) in enumerate(rules)], "wrong string, right string, stage int, n long")
    texts = ["miſs Miss", "\u212aelvin kelvin", "ΌΣΟΣ όσος όσοσ", "mİss mıss", "µ stays", "w2000 x"]
    seg = segments([("d", i + 1, i, i + 1, t) for i, t in enumerate(texts)])
    got = [r["text"] for r in consistency.enforce_rules(seg, table).orderBy("pos").collect()]
    assert got == ["MR MR", "KEL KEL", "OSOS OSOS OSOS", "MR MR", "µ stays", "w2000 x"]


def test_thousands_of_rules_move_no_words(spark, segments, monkeypatch):
    """Six thousand plain rules are broadcast, and hits are listed where their text is."""
    from tests.test_plans import plan_of

    settled = []
    monkeypatch.setattr(consistency, "join_spread", None)
    monkeypatch.setattr(
        consistency, "settle", lambda df, label, f=consistency.settle: (settled.append(label), f(df, label))[1])
    table = spark.createDataFrame(
        [(f"w{n}", f"v{n}", 2, n) for n in range(6000)], "wrong string, right string, stage int, n long")
    seg = segments([("d", i + 1, i, i + 1, f"w{i} x w{i} W{i + 1} y") for i in range(50)])
    out = consistency.enforce_rules(seg, table)
    assert [r["text"] for r in out.orderBy("pos").collect()] == [
        f"v{i} x v{i} v{i + 1} y" for i in range(50)]
    assert "hits" not in settled and "rule-fold" not in settled
    plan = plan_of(out)
    assert "hashpartitioning(word" not in plan
    assert plan.count("Exchange hashpartitioning(doc_id") == 2


@pytest.mark.parametrize("few", [0, 5000])
def test_rules_and_hits_of_documents_are_not_broadcast(spark, segments, monkeypatch, few):
    """Equal terms of many documents make small files, but as many rows as there are documents."""
    from tests.test_plans import plan_of

    plans = []
    monkeypatch.setattr(consistency, "FEW_RULES", few)
    monkeypatch.setattr(consistency, "settle", lambda df, label, f=consistency.settle: (
        plans.append(plan_of(df)), f(df, label))[1])
    rules = [("alpha", "beta"), ("beta", "gamma"), ("(", ""), ("yz", "glued")]
    table = spark.createDataFrame(
        [(w, r, 2, n) for n, (w, r) in enumerate(rules)], "wrong string, right string, stage int, n long")
    own = spark.createDataFrame(
        [(f"d{i}", w, r, 1, n) for i in range(0, 40, 2) for n, (w, r) in enumerate(
            [("alpha", "own"), ("zeta", "beta"), (f"w{i}", "alpha")])],
        "doc_id string, wrong string, right string, stage int, n long")
    seg = segments([(f"d{i}", 1, 0, 1, f"Alpha zeta y(z w{i} alpha") for i in range(40)])
    out = consistency.enforce_rules(seg, table, own)
    plans.append(plan_of(out))
    # a word that a rule of the same stage writes too late for "alpha" stays
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        f"d{i}": f"gamma zeta glued w{i} gamma" if i % 2 else "own gamma glued alpha own"
        for i in range(40)}
    assert "SortMergeJoin [doc_id" in plans[-1]
    assert not [p for p in plans if "BroadcastHashJoin [doc_id" in p]


def test_words_end_where_letters_numbers_and_marks_end(spark, segments):
    rules = spark.createDataFrame([("the", "T", 2, 0), ("(", "<", 2, 1)], "wrong string, right string, stage int, n long")
    pairs = [
        ("the\u00b2 the\u00bd \u2460the", "the\u00b2 the\u00bd \u2460the"),
        ("the\u200dthe the\u203fx \u24d0the", "T\u200dT T\u203fx \u24d0T"),
        ("\U0001d7d9the \U0001f130the the\u20e3", "\U0001d7d9the \U0001f130T the\u20e3"),
        ("é(the \u00b2(x ‿(x é(‿", "é<T \u00b2<x ‿(x é(‿"),
    ]
    seg = segments([("d", i + 1, i, i + 1, t) for i, (t, _) in enumerate(pairs)])
    got = [r["text"] for r in consistency.enforce_rules(seg, rules).orderBy("pos").collect()]
    assert got == [t for _, t in pairs]


def test_letters_apart_equal_no_others(spark, segments):
    rules = spark.createDataFrame([("miss", "M", 2, 0)], "wrong string, right string, stage int, n long")
    seg = segments([("d", 1, 0, 1, "miſs Miss"), ("d", 2, 1, 2, "mıss mİSS ſ")])
    got = [r["text"] for r in consistency.enforce_rules(seg, rules, apart="\u0131\u017f").orderBy("pos").collect()]
    assert got == ["miſs M", "mıss M ſ"]


def test_learned_vocabulary_of_odd_texts_equals_its_sql(spark, tmp_path):
    """Empty lines, words next to odd characters, letters that are ASCII ones in another case only."""
    import duckdb

    from cueflow.plans.catalog import ORACLES, QUERIES
    from tests.compare import compare

    texts = [
        "", "\n", None, "dinner winter\n\nsummer Kitchen", "dinner dinner winter winter summer\n",
        "dinner\u00b2 \u00bddinner dinner\u200dwinter winter\u203fx \u24d0summer \U0001d7d9dinner",
        "ſummer dınner dİnner \u212aitchen KITCHEN kitchen SUMMER summer winter\u2026 winter\u0301",
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "c04_learned_vocabulary"
    assert compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], con) == []


def test_folding_is_that_of_patterns(spark):
    letters = [chr(c) for c in range(0x80, 0x2200) if chr(c).isalpha()] + ["\ua64a", "\u1c80", "A"]
    table = spark.createDataFrame([(c, c.upper(), c.lower()) for c in letters],
                                  "c string, up string, low string")
    for other in ("up", "low"):
        pattern = F.concat(F.lit(r"(?iuU)\Q"), F.col(other), F.lit(r"\E"))
        odd = table.where((F.length(other) == 1) & F.regexp("c", pattern) & (
            consistency.fold_case(F.col("c")) != consistency.fold_case(F.col(other))))
        assert [r.c for r in odd.collect()] == []


def test_documents_without_segments_keep_their_content(spark):
    docs = spark.createDataFrame([("a", "junk"), ("b", "x")], "doc_id string, content string")
    rendered = spark.createDataFrame([("b", 0, "out")], "doc_id string, part_no long, content string")
    got = {r["doc_id"]: r["content"] for r in document_contents(docs, rendered).collect()}
    assert got == {"a": "junk", "b": "out"}


def test_learned_pairs_match_difflib(spark, segments):
    rng = random.Random(21)
    left, right = [], []
    for _ in range(40):
        a = [rng.choice("abcdefg") for _ in range(rng.choice([3, 12, 260]))]
        b = [w if rng.random() > 0.2 else rng.choice(["X", "Y Z", ""]) for w in a]
        left.append(" ".join(a))
        right.append(" ".join(" ".join(b).split()))
    one = segments([("d", i + 1, i, i + 1, t) for i, t in enumerate(left)])
    two = segments([("d", i + 1, i, i + 1, t) for i, t in enumerate(right)])
    got = sorted((r["pos"], r["wrong"], r["right"])
                 for r in diffs.learned_pairs(diffs.aligned_segments(one, two)).collect())
    expected = []
    for i, (x, y) in enumerate(zip(left, right)):
        a, b = x.split(), y.split()
        for tag, p, q, s, t in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if tag == "replace" and q - p < 5:
                expected.append((i, " ".join(a[p:q]), " ".join(b[s:t])))
    assert got == sorted(expected)


def test_learning_updates_the_kb(spark, segments):
    kb = kb_of(spark, [("teh", "the", "news", "general", "general", 4)])
    one = segments([("d", 1, 0, 1, "teh man"), ("d", 2, 1, 2, "on teh way"), ("e", 1, 0, 1, "x")])
    two = segments([("d", 1, 0, 1, "the man"), ("d", 2, 1, 2, "on the road"), ("e", 1, 0, 1, "y"),
                    ("e", 2, 0, 1, "z")])
    rows = {(r["wrong_term"], r["correct_term"]): r for r in
            learn_corrections(one, two, kb, topic="news").collect()}
    assert rows[("teh", "the")]["count"] == 5
    assert rows[("teh way", "the road")]["count"] == 1 and rows[("teh way", "the road")]["id"] == 2
    assert len(rows) == 2
    assert [r["doc_id"] for r in diffs.misaligned_documents(one, two).collect()] == ["e"]


def test_diff_spans_and_attribution(spark, segments):
    one = segments([("d", 1, 0, 1, "the contrast was signed at")])
    two = segments([("d", 1, 0, 1, "the contract was signed")])
    spans = diffs.diff_spans(diffs.aligned_segments(one, two))
    got = [(r["kind"], r["value"]) for r in spans.orderBy("span_no", F.desc("kind")).collect()]
    assert got == [("equal", "the"), ("removed", "contrast"), ("added", "contract"),
                   ("equal", "was signed"), ("removed", "at")]
    applied = spark.createDataFrame(
        [("d", 2, "a contract", "grammar", "late"), ("d", 1, "the contracts", "context", "first"),
         ("x", 0, "contract", "other", "elsewhere")],
        "doc_id string, apply_order long, corrected_text string, type string, reason string")
    [hit] = diffs.attributed_spans(spans, applied).collect()
    assert (hit["value"], hit["reason"]) == ("contract", "first")


def test_changes_use_the_last_original(segments):
    one = segments([("d", 1, 0, 1, "a"), ("d", 1, 1, 2, "b")])
    two = segments([("d", 1, 0, 1, "b"), ("d", 1, 1, 2, "c"), ("d", 9, 2, 3, "new")])
    got = sorted((r["idx"], r["original"], r["corrected"]) for r in diffs.changed_segments(one, two).collect())
    assert got == [(1, "b", "c"), (9, "", "new")]


def test_payloads(spark):
    rows = [
        ("ok", '{"topic":"t","genre":"g","summary":"s","style_guide":"","entities":'
               '[{"name":"n","category":"Person"}]}'),
        ("no style", '{"topic":"t","genre":"g","summary":"s","entities":[]}'),
        ("bad entity", '{"topic":"t","genre":"g","summary":"s","style_guide":"x","entities":[{"name":"n"}]}'),
        ("no json", "nope"),
    ]
    read = payloads.read_manifests(spark.createDataFrame(rows, "doc_id string, payload string"))
    got = {r["doc_id"]: r for r in read.collect()}
    assert [d for d, r in got.items() if not r["is_fallback"]] == ["ok"]
    assert got["ok"]["manifest"]["entities"][0]["type"] == "Person"
    assert got["ok"]["manifest"]["country"] == "General"
    assert got["no json"]["manifest"]["genre"] == "Unknown"
    good = '{"segment_id":"7","original_text":"a","corrected_text":"b","type":"t","reason":"r"}'
    calls = [("a", 0, f'{{"corrections":[{good},{{"segment_id":1}},"x",{good.replace(chr(34)+"7"+chr(34), "7.5")}]}}'),
             ("b", 0, "{}"), ("c", 0, "oops")]
    table = spark.createDataFrame(calls, "doc_id string, chunk_no long, payload string")
    assert [(r["doc_id"], r["prop_no"], r["segment_id"]) for r in payloads.read_proposals(table).collect()] == [("a", 0, 7)]
    assert payloads.malformed_proposals(table).count() == 3


def test_cleaning(spark):
    rows = spark.createDataFrame(
        [("Um, you know, I like it", "en"), ("ähm also gut", "de"), ("umbrella", "en"), ("x um", "xx")],
        "t string, lang string")
    got = rows.select(
        cleaning.remove_fillers(F.col("t"), F.col("lang")).alias("r"),
        cleaning.filler_counts(F.col("t"), F.col("lang")).alias("n"),
        cleaning.remove_fillers(F.col("t"), F.col("lang"), custom=["gut"]).alias("c"),
    ).collect()
    assert [r["n"] for r in got] == [3, 1, 0, 0]
    assert got[0]["r"] == ", , I it" and got[1]["r"] == "ähm gut" and got[1]["c"] == "ähm"
    [row] = spark.createDataFrame([("<b>a</b>  b...!!??",)], "t string").select(
        cleaning.normalize_punctuation(cleaning.strip_markup(F.col("t")))).collect()
    assert row[0] == "a b…!?"


def test_spans_are_found_in_odd_texts_by_asked_grams_only(spark):
    texts = ["ab\n\U0001f600cd", "\U0001f600\U0001f600\U0001f600 x" * 3, "x" * 300 + "a needle", "néé ퟿"]
    wanted = ["b\n\U0001f600", "\U0001f600\U0001f600\U0001f600 x\U0001f600\U0001f600\U0001f600 x", "a needle", "needles",
              "xxx", "\U0001f600cd", "éé"]
    spans = spark.createDataFrame(
        [("d", i, 0, "added", w) for i, w in enumerate(wanted)],
        "doc_id string, pos long, span_no int, kind string, value string")
    applied = spark.createDataFrame(
        [("d", i, t, "e", "r") for i, t in enumerate(texts)],
        "doc_id string, apply_order long, corrected_text string, type string, reason string")
    found = diffs.attributed_spans(spans, applied)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    first = {r.pos: r.apply_order for r in found.collect()}
    assert first == {i: next((n for n, t in enumerate(texts) if w in t), None) for i, w in enumerate(wanted)}


def test_spans_leave_no_word_lists_to_a_whole_batch(spark, segments):
    count = 3 * diffs.SPAN_ROWS + 1
    one = segments([("d", i + 1, i, i + 1, f"a x{i} b") for i in range(count)])
    two = segments([("d", i + 1, i, i + 1, f"a y{i}  b") for i in range(count)])
    learned = diffs.learned_pairs(diffs.aligned_segments(one, two))
    assert {(r.pos, r.span_no, r.wrong, r.right) for r in learned.collect()} == {
        (i, 0, f"x{i}", f"y{i}") for i in range(count)}
    plan = learned._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
