"""Winnowing against a plain version in Python."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from cueflow.llm import winnowing as W
from cueflow.llm.queries import op2


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def hash_long(value, seed):
    """Spark's hash of one long, folded into the hash so far."""
    return xxhash.xxh64_intdigest(struct.pack("<q", signed(value)), seed & ((1 << 64) - 1))


def hash_longs(*values):
    h = 42
    for v in values:
        h = hash_long(v, h)
    return h


def plain(text):
    """(hash, position) of the kept grams."""
    runs = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    units = [u for run in runs for u in ([run] if len(run) <= 16 else run)]
    u = [xxhash.xxh64_intdigest(x.encode(), 42) for x in units]
    if not u:
        return []
    if len(u) < W.GRAM:
        grams = [hash_longs(*u)]
    else:
        pairs = [hash_longs(a, b) for a, b in zip(u, u[1:])]
        fours = [hash_longs(a, b) for a, b in zip(pairs, pairs[2:])]
        grams = [hash_longs(a, b) for a, b in zip(fours, u[4:])]
    low = [g & 0xFFFFFFFF for g in grams]
    kept = []
    for i in range(max(1, len(low) - W.WINDOW + 1)):
        window = low[i:i + W.WINDOW]
        least = min(window)
        at = i + max(k for k, h in enumerate(window) if h == least)
        if (least, at) not in kept:
            kept.append((least, at))
    return kept


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [None, "", "one", "one two three four", "a b c d e f", "the cat sat on the mat " * 40,
         "x" * 100, "漢字かな交じり文" * 9, " \n\t ", "same text here " * 5, "same text here " * 5]


def check(rows, docs):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        text, follows = docs[r.doc_id] or "", docs[after[r.doc_id]] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + follows[:cut]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        show = lambda kept: " ".join(f"{h:x}@{p}" for h, p in kept)
        assert r.fingerprint == show(plain(text))
        assert r.edited_fingerprint == show(plain(edited))
        assert r.near_edited == pytest.approx(like(plain(text), plain(edited)))
        assert r.near_next == pytest.approx(like(plain(text), plain(follows)))


def test_kept_grams(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in W.fingerprints(docs).collect():
        assert [(g.hash, g.position) for g in r.grams] == plain(TEXTS[r.doc_id])


def test_shared_units_share_a_gram():
    shared = [f"s{i}" for i in range(W.GRAM + W.WINDOW - 1)]
    for n in range(8):
        a = " ".join([f"a{i}" for i in range(n)] + shared + ["tail"])
        b = " ".join([f"b{i}" for i in range(3 * n + 1)] + shared)
        assert {h for h, _ in plain(a)} & {h for h, _ in plain(b)}


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(op2(spark, folder).collect(), docs)


def test_order_over_ranges_and_odd_rows(spark, tmp_path):
    rows = [(i * 7 - 20, t, 1) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    check(op2(spark, str(tmp_path)).collect(), {i: t for i, t, _ in rows})
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c d e f g"), (3, "c d e f g")],
                                "doc_id long, text string")
    got = W.edited_likeness(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None", "None"]
    assert W.edited_likeness(odd.limit(0)).count() == 0
    one = W.edited_likeness(odd.filter("doc_id = 3").limit(1)).collect()
    assert [r.edited for r in one] == ["c d e fc d"] or len(one) == 1


def test_passages_without_blanks_are_found_at_any_offset(spark):
    rng = random.Random(9)
    passage = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600))
    texts = [passage, "x" + passage, "前" * 5 + passage + "後" * 7, passage[:300] + "!" + passage[300:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: {g.hash for g in r.grams} for r in W.fingerprints(docs).collect()}
    for i in (1, 2, 3):
        assert len(sets[0] & sets[i]) > 0.9 * len(sets[0])
