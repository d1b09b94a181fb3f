"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from cueflow.llm import simhash as S
from cueflow.llm.queries import op10


def plain_fingerprint(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    words = [w for w in out.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_roots(fps):
    """Smallest index reachable over links of three bits or fewer."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(rows, texts):
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_roots(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got == {i: (f"{f:016x}", r) for i, (f, r) in enumerate(zip(fps, roots, strict=True))}


def test_linked_words_share_a_key():
    rng = random.Random(3)
    for errors in (0, 1, 2, 3):
        fps = [rng.getrandbits(64) for _ in range(400)]
        near = [f ^ sum(1 << b for b in rng.sample(range(64), errors)) for f in fps]
        mine, theirs = (S.keys_of(np.array(x, np.uint64)) for x in (fps, near))
        for i in range(400):
            assert set(mine[0][mine[1] == i]) & set(theirs[0][theirs[1] == i])


def test_golay_code_is_perfect():
    _, error, beside = S.golay_tables()
    assert sorted(e.bit_count() for e in error.tolist()) == [0] + [1] * 23 + [2] * 253 + [3] * 1771
    assert (beside >= 0).all(1).sum() == 1771


def test_small_corpus_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one", "one two", "ÉTÉ a b c", "été a b c", "x\x1cy z a b"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)],
                                 "doc_id long, text string, fp string")
    check(S.near_groups(docs).collect(), texts)


@pytest.mark.parametrize("block", [4, 2048])
def test_hot_keys_are_compared_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(7)
    fps = {0, 1, 3, 7}
    for _ in range(60):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), 3)))
    fps |= {rng.getrandbits(63) for _ in range(20)}
    fps = sorted(fps)
    table = spark.createDataFrame([(int(f) - (1 << 64) if f >> 63 else int(f),) for f in fps],
                                  "fp long")
    pairs = [(r.a, r.b) for r in S.near_links(table).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in pairs)
    place = {f - (1 << 64) if f >> 63 else f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    for _ in fps:
        for a, b in pairs:
            root[place[a]] = root[place[b]] = min(root[place[a]], root[place[b]])
    assert root == plain_roots(fps)


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (9, "a b c"), (None, None)],
                                 "doc_id long, text string")
    rows = S.near_groups(docs).collect()
    assert [r.component_id for r in rows if r.fingerprint != "0" * 16] == [9, 9, 9]
    assert [r.component_id for r in rows if r.fingerprint == "0" * 16] == [None]
    assert S.near_groups(docs.limit(0)).count() == 0


def test_registered_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10(spark, folder).collect()
    check(rows, [docs[i] for i in sorted(docs)])
