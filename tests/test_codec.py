import random

import pytest
from pyspark.sql import functions as F

from cueflow.functions.timecode import cut_cue_settings, srt_clock, srt_times, vtt_times
from cueflow.sources import codec, files

T = "00:00:01,000 --> 00:00:02,500"
V = "00:00:01.000 --> 00:00:02.500"

SRT_CASES = {
    "plain": (f"1\n{T}\nHello\n", [(1, 1000, 2500, "Hello")]),
    "two lines": (f"1\n{T}\nHello\nthere\n", [(1, 1000, 2500, "Hello\nthere")]),
    "bom": (f"﻿1\n{T}\nHello\n", [(1, 1000, 2500, "Hello")]),
    "crlf": (f"1\r\n{T}\r\nA\r\n\r\n2\r\n{T}\r\nB\r\n", [(1, 1000, 2500, "A"), (2, 1000, 2500, "B")]),
    "cr": (f"1\r{T}\rA\r\r2\r{T}\rB\r", [(1, 1000, 2500, "A"), (2, 1000, 2500, "B")]),
    "blank line in text": (f"1\n{T}\nA\n\nB\n\n2\n{T}\nC", [(1, 1000, 2500, "A"), (2, 1000, 2500, "C")]),
    "three newlines": (f"1\n{T}\nA\n\n\n2\n{T}\nB", [(1, 1000, 2500, "A"), (2, 1000, 2500, "B")]),
    "no text": (f"1\n{T}\n\n2\n{T}\nB", [(2, 1000, 2500, "B")]),
    "bad number": (f"x\n{T}\nA\n\n2\n{T}\nB", [(2, 1000, 2500, "B")]),
    "decimal number": (f"1.5\n{T}\nA", []),
    "signed and underscored": (f" +1_0 \n{T}\nA\n\n-3\n{T}\nB", [(10, 1000, 2500, "A"), (-3, 1000, 2500, "B")]),
    "dot in times": (f"1\n{V}\nA", []),
    "three-digit hour": ("1\n100:00:01,000 --> 100:00:02,000\nA", []),
    "junk after times": (f"1\n{T} X1:3\nA", [(1, 1000, 2500, "A")]),
    "indented times": (f"1\n  {T}\nA", [(1, 1000, 2500, "A")]),
    "arrow without blanks": ("1\n00:00:01,000-->00:00:02,500\nA", [(1, 1000, 2500, "A")]),
    "times over two lines": ("1\n00:00:01,000\n--> 00:00:02,500\nA", []),
    "out of range minutes": ("1\n00:99:00,000 --> 00:99:01,000\nA", [(1, 5940000, 5941000, "A")]),
    "duplicate number": (f"1\n{T}\nA\n\n1\n{T}\nB", [(1, 1000, 2500, "A"), (1, 1000, 2500, "B")]),
    "wide blanks": (f"1\n{T}\n　A \x1f", [(1, 1000, 2500, "A")]),
    "empty": ("", []),
    "blank": (" \n\n ", []),
}

VTT_CASES = {
    "header": (f"WEBVTT\nKind: captions\n\n{V}\nA", [(1, 1000, 2500, "A")]),
    "no header": (f"{V}\nA", [(1, 1000, 2500, "A")]),
    "note": (f"WEBVTT\n\nNOTE x\n\n{V}\nA", [(1, 1000, 2500, "A")]),
    "cue id": (f"WEBVTT\n\nintro\n{V}\nA", [(1, 1000, 2500, "A")]),
    "no hours": ("WEBVTT\n\n01:02.003 --> 01:03.000\nA", [(1, 62003, 63000, "A")]),
    "mixed forms": ("WEBVTT\n\n00:00:01.000 --> 00:02.000\nA", []),
    "settings": (f"WEBVTT\n\n{V} position:10% align:start\nA", [(1, 1000, 2500, "A")]),
    "voice": (f"WEBVTT\n\n{V}\n<v Ann>Hi</v> <b>you</b>", [(1, 1000, 2500, "Hi <b>you</b>")]),
    "class": (f"WEBVTT\n\n{V}\n<c.x>Hi</c>", [(1, 1000, 2500, "Hi")]),
    "blank after tags": (f"WEBVTT\n\n{V}\n<v A> </v>", [(1, 1000, 2500, " ")]),
    "empty after tags": (f"WEBVTT\n\n{V}\n<v A></v>\n\n{V}\nB", [(1, 1000, 2500, "B")]),
    "no text": (f"WEBVTT\n\n{V}\n\n{V}\nB", [(1, 1000, 2500, "B")]),
    "arrow in text first": (f"WEBVTT\n\na --> b\n{V}\nA", []),
    "comma times": (f"WEBVTT\n\n{T}\nA", []),
}


def _parsed(spark, cases, fmt):
    docs = spark.createDataFrame(
        [(name, content, fmt) for name, (content, _) in cases.items()],
        "doc_id string, content string, format string",
    )
    got = {name: [] for name in cases}
    for row in codec.parse(docs).orderBy("doc_id", "pos").collect():
        assert row["pos"] == len(got[row["doc_id"]])
        got[row["doc_id"]].append((row["idx"], row["start_ms"], row["end_ms"], row["text"]))
    return got


@pytest.mark.parametrize("cases, fmt", [(SRT_CASES, "srt"), (VTT_CASES, "webvtt")])
def test_parse_edges(spark, cases, fmt):
    assert _parsed(spark, cases, fmt) == {name: rows for name, (_, rows) in cases.items()}


def test_parity_without_newline_folding(spark):
    content = f"1\r\n{T}\r\nA\r\n\r\n2\r\n{T}\r\nB\r\n"
    docs = spark.createDataFrame([("d", content)], "doc_id string, content string")
    kept = codec.parse_srt(docs, normalize_newlines=False)
    assert kept.count() == 1


@pytest.mark.parametrize("render, parse", [
    (codec.render_srt, codec.parse_srt), (codec.render_webvtt, codec.parse_webvtt),
])
def test_round_trip(spark, segments, render, parse):
    rng = random.Random(7)
    rows = []
    for doc in range(20):
        for i in range(rng.randint(1, 60)):
            start = rng.randint(0, 350_000_000)
            text = "\n".join(
                " ".join(rng.choice(["a", "bé", "c.", "😀", "<i>"]) for _ in range(3))
                for _ in range(rng.randint(1, 3))
            )
            rows.append((f"d{doc}", i + 1, start, start + rng.randint(-10, 9000), text))
    seg = segments(rows).where("end_ms >= 0")
    back = parse(render(seg))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seg.collect()))


def test_render_layout(segments):
    seg = segments([("d", 7, 0, 1500, "A"), ("d", 9, 3_600_000, 400_000_000, "B\nC")])
    [srt] = codec.render_srt(seg).collect()
    assert srt["content"] == (
        "1\n00:00:00,000 --> 00:00:01,500\nA\n\n2\n01:00:00,000 --> 111:06:40,000\nB\nC\n"
    )
    [vtt] = codec.render_webvtt(seg).collect()
    assert vtt["content"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nA\n\n01:")
    [raw] = codec.render_corrected(seg, timecode="raw_ms").collect()
    assert raw["content"] == "7\n0 --> 1500\nA\n\n9\n3600000 --> 400000000\nB\nC\n"


def test_parts_concatenate_to_the_whole(segments):
    seg = segments([("d", i + 1, i * 1000, i * 1000 + 900, f"t{i}") for i in range(25)])
    [whole] = codec.render_srt(seg).collect()
    parts = codec.render_srt(seg, part_cues=7).orderBy("part_no").collect()
    assert len(parts) == 4
    assert "".join(p["content"] for p in parts) == whole["content"]


def test_format_policies(spark):
    names = spark.createDataFrame([("a.srt",), ("a.SRT",), ("a.VTT",), ("a.txt",)], "n string")
    got = names.select(
        *[files.format_of(F.col("n"), p) for p in ("router", "cli", "strict")]
    ).collect()
    assert [tuple(r) for r in got] == [
        ("srt", "srt", "srt"), ("webvtt", "srt", None), ("webvtt", "webvtt", None),
        ("webvtt", "srt", None),
    ]


def test_corpus_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a.srt", 0, f"1\n{T}\nA\n"), ("a.srt", 1, f"\n2\n{T}\nB\n"), ("b.vtt", 0, f"WEBVTT\n\n{V}\nC\n")],
        "name string, part_no int, content string",
    )
    files.write_corpus(docs, str(tmp_path / "corpus"))
    scanned = files.scan_corpus(spark, str(tmp_path / "corpus")).withColumn(
        "name", files.document_name(F.col("doc_id")))
    seg = codec.parse(scanned.withColumn("format", files.format_of(F.col("name"))), ["name"])
    assert sorted((r["name"], r["idx"], r["text"]) for r in seg.collect()) == [
        ("a.srt", 1, "A"), ("a.srt", 2, "B"), ("b.vtt", 1, "C"),
    ]


def test_admission_and_base64(spark):
    docs = spark.createDataFrame(
        [("a", "  hi ", "srt", "en", False), ("b", " ", "srt", "en", False),
         ("c", "aGVsbG8=", "srt", "en", True), ("d", "%%%", "srt", "en", True),
         ("e", "x" * 11, "srt", "en", False), ("f", "x", "ass", "en", False),
         ("g", "x", "srt", "xx", False)],
        "doc_id string, content string, format string, language string, is_base64 boolean",
    )
    admitted = files.admit(files.decode_base64(docs), max_chars=10)
    reasons = {r["doc_id"]: r["reason"] for r in admitted.collect()}
    assert reasons == {
        "a": None, "b": "content_empty", "c": None, "d": "content_unreadable",
        "e": "content_too_long", "f": "format", "g": "language",
    }
    assert {r["content"] for r in files.accepted(admitted).collect()} == {"hi", "hello"}
    assert files.rejected(admitted).count() == 5


def test_packed_corpora(spark, tmp_path):
    path = str(tmp_path / "packed")
    rows = [(f"n{i:03d} a/b:%.srt", 0, f"text {i}\r\n") for i in range(40)]
    rows += [("long.vtt", 1, "second"), ("long.vtt", 0, "first "), ("empty.srt", 0, "")]
    docs = spark.createDataFrame(rows, "name string, part_no int, content string").repartition(7)
    files.pack_corpus(docs, path)
    got = {r.doc_id: r.content for r in files.scan_packed(spark, path).collect()}
    assert len(got) == 42 and got["long.vtt"] == "first second" and got["empty.srt"] == ""
    assert got["n007 a/b:%.srt"] == "text 7\n"
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) == 42 and len({(r.part, r.row) for r in index}) == 42
    names = spark.createDataFrame([("n003 a/b:%.srt",), ("long.vtt",), ("none",)], "name string")
    assert {r.doc_id for r in files.read_packed(spark, path, names).collect()} == {
        "n003 a/b:%.srt", "long.vtt"}
    assert files.read_packed(spark, path, names.where("name = 'none'")).count() == 0


def test_timecodes(spark):
    lines = spark.createDataFrame([(T,), (V,), ("00:01,000 --> 00:02,000",)], "l string")
    got = lines.select(
        srt_times(F.col("l")).alias("s"), vtt_times(cut_cue_settings(F.col("l"))).alias("v")
    ).collect()
    assert got[0]["s"] == (1000, 2500) and got[0]["v"] is None
    assert got[1]["s"] is None and got[1]["v"] == (1000, 2500)
    assert got[2]["s"] is None and got[2]["v"] is None
    [clock] = spark.range(1).select(srt_clock(F.lit(360_000_001).cast("long"))).collect()
    assert clock[0] == "100:00:00,001"


def test_cue_numbers_of_any_length(spark):
    from cueflow.sources import codec

    numbers = ["1234567890123456789", "1_0000000000000000000000", "-99999999999999999999", "7",
               "010000000000000000000000", "10000000000000000000001", "-10000000000000000000000", "٣_٤",
               "\U0001d7d92", "00000000000000000000000012"]
    body = "\n\n".join(f"{n}\n00:00:01,000 --> 00:00:02,000\nx" for n in numbers)
    docs = spark.createDataFrame([("d", "srt", body)], "doc_id string, format string, content string")
    got = [r.idx for r in codec.parse(docs).orderBy("pos").collect()]
    assert [got[0], got[3], *got[7:]] == [1234567890123456789, 7, 34, 12, 12]
    # equal numbers stay equal, others apart
    assert got[1] == got[4] > 2**62 and got[6] == -got[1] and got[2] < -(2**62)
    assert len({*got[:7]}) == 6


def test_digits_of_any_script(spark):
    docs = spark.createDataFrame(
        [("s", "srt", "١\n٠٠:٠٠:٠١,٥٠٠ --> 00:00:0２,000\nx ٣"),
         ("v", "webvtt", "WEBVTT\n\n٠٠:٠١.٥٠٠ --> 00:02.000\ny"),
         ("n", "srt", "²\n00:00:01,000 --> 00:00:02,000\nsuperscripts are no decimal digits")],
        "doc_id string, format string, content string")
    got = {tuple(r) for r in codec.parse(docs).collect()}
    assert got == {("s", 0, 1, 1500, 2000, "x ٣"), ("v", 0, 1, 1500, 2000, "y")}


def test_payload_fields_must_be_strings(spark):
    import json

    from cueflow.sources import payloads

    fields = {"segment_id": 1, "original_text": "a", "corrected_text": "b", "type": "t", "reason": "r"}
    bad = [{"original_text": 5}, {"corrected_text": {"a": 1}}, {"type": True}, {"reason": None}]
    items = [fields, *({**fields, **b} for b in bad)]
    rows = spark.createDataFrame([("d", 0, json.dumps({"corrections": items}))],
                                 "doc_id string, chunk_no long, payload string")
    assert [r.prop_no for r in payloads.read_proposals(rows).collect()] == [0]
    assert payloads.malformed_proposals(rows).count() == 4
    good = {"topic": "t", "genre": "g", "summary": "s", "style_guide": "x",
            "entities": [{"name": "n", "category": "c"}]}
    manifests = [good, {**good, "topic": 5}, {**good, "entities": [{"name": 1, "type": "c"}]},
                 {**good, "industry": 3}, {**good, "industry": None}]
    rows = spark.createDataFrame([(str(i), json.dumps(m)) for i, m in enumerate(manifests)],
                                 "doc_id string, payload string")
    got = {r.doc_id: r.is_fallback for r in payloads.read_manifests(rows).collect()}
    assert got == {"0": False, "1": True, "2": True, "3": True, "4": False}
