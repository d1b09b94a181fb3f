"""Near-duplicates by SimHash, with candidates from Golay codes.

Fingerprints of 64 bits that differ in at most three are linked. The bits are cut into three
segments of 22, 21 and 21, padded to 23. With three errors over three segments, two segments have
at most one error each. The (23, 12) Golay code is perfect: every word lies within distance three of
exactly one codeword. A word within two of its codeword stays near it when one bit flips; a word at
distance three may fall to another codeword, but then to one at distance four, of which there are
five. So one to six codeword indices per word are enough for words that differ in one bit to share
one, and the pairs of indices of two segments are keys that linked fingerprints must share.

Equal fingerprints are one node. Rows meet by key; within a key fingerprints are compared and only
links of a spanning forest leave the task. A key with more rows than a block is cut into blocks,
and pairs of blocks are compared by separate tasks, so no task holds more than two blocks however
large a group of near copies grows. Links of distinct fingerprints go to connected components.

Null texts count as empty; a text without words has fingerprint zero and is linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.components import components
from cueflow.llm.exact_dedup import keep_marked, row_key
from cueflow.llm.minhash import CORPUS_COPIES, Likeness, alike_roots, sketches
from cueflow.session import settle

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Fingerprints compared within one task at once.
BLOCK = 2048
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text over shingles of its lower-cased words."""
    words = (text or "").encode().lower().split()  # on bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    each = min(words_each, len(words))
    starts, ends = starts[:len(words) - each + 1].tolist(), ends[each - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    tally = np.zeros(64, np.int64)
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(
                starts[i:i + SHINGLES_AT_ONCE], ends[i:i + SHINGLES_AT_ONCE], strict=True)],
            np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally += bits.sum(0, dtype=np.int64)
    return int(np.packbits(tally * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words_each: int = SHINGLE_WORDS,
) -> DataFrame:
    """(id, fp long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words_each) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))],
                [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(text_col).alias("__text"), id_col).mapInArrow(
        run, f"`{id_col}` {kind}, fp long")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity bits by message, error pattern by syndrome, and by syndrome the message bits of the
    five codewords that lead from a word at distance three to those at distance four (else -1)."""
    messages = np.arange(1 << 12, dtype=np.int64)
    parity = messages << 11
    for bit in range(22, 10, -1):
        parity = np.where(parity >> bit & 1, parity ^ (GENERATOR << (bit - 11)), parity)
    code = messages << 11 | parity
    patterns = [sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(23), k)]
    error = np.zeros(1 << 11, np.int64)
    for p in patterns:
        error[parity[p >> 11] ^ (p & 2047)] = p
    light = code[np.bitwise_count(code) == 7]
    beside = np.full((1 << 11, 5), -1, np.int64)
    for syndrome, p in enumerate(error.tolist()):
        if p.bit_count() == 3:
            beside[syndrome] = light[(light & p) == p] >> 11
    return parity, error, beside


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Up to six codeword indices per 23-bit word, -1 where there are fewer."""
    parity, error, beside = golay_tables()
    syndrome = parity[words >> 11] ^ (words & 2047)
    nearest = (words ^ error[syndrome]) >> 11
    others = beside[syndrome]
    return np.column_stack([nearest, np.where(others < 0, -1, others ^ nearest[:, None])])


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): all keys of each fingerprint (uint64)."""
    indices = [
        codeword_indices((fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
        for low, width in SEGMENTS]
    keys, rows = [], []
    for number, (i, j) in enumerate(combinations(range(3), 2)):
        both = np.where(
            (indices[i][:, :, None] >= 0) & (indices[j][:, None, :] >= 0),
            number << 24 | indices[i][:, :, None] << 12 | indices[j][:, None, :], -1,
        ).reshape(len(fps), -1)
        row, _ = np.nonzero(both >= 0)
        keys.append(both[both >= 0])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def spanning_links(fps: np.ndarray, blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a forest that joins what is linked among distinct `fps` (int64).

    With `blocks` only links between different blocks count.
    """
    unsigned = fps.view(np.uint64)  # the count of bits takes absolute values
    waiting = np.arange(len(fps))
    links = []
    while len(waiting):
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(unsigned[waiting] ^ unsigned[at]) <= MOST_BITS
            if blocks is not None:
                near &= blocks[waiting] != blocks[at]
            met, waiting = waiting[near], waiting[~near]
            front += met.tolist()
            links += [(int(fps[at]), int(fps[m])) for m in met]
    return links


LINK_FIELDS = "key long, block long, a long, b long"


def _batch(links: list[tuple[int, int]], left: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Links have a null key; rows of a key with several blocks have (key, block, fingerprint)."""
    rows = [(None, None, a, b) for a, b in links] + [(k, n, fp, None) for k, n, fp in left]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 4)],
        ["key", "block", "a", "b"])


def _within_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both; compares block by block within each key."""
    key, number = None, 0
    held = np.empty(0, np.int64)

    def close(links: list, left: list) -> None:
        links += spanning_links(held)
        if number or len(held) == BLOCK:
            left += [(key, number, int(fp)) for fp in held]

    for batch in batches:
        links: list[tuple[int, int]] = []
        left: list[tuple[int, int, int]] = []
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(keys)]])
        if not len(keys):
            continue
        # a key of one row within the batch has no partner; the first and last may go on
        some = (ends - starts > 1) | (starts == 0) | (ends == len(keys))
        for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            if key != keys[a]:
                close(links, left)
                key, number, held = int(keys[a]), 0, held[:0]
            while a < b:
                if len(held) == BLOCK:
                    close(links, left)
                    number, held = number + 1, held[:0]
                take = min(b - a, BLOCK - len(held))
                held = np.concatenate([held, fps[a:a + take]])
                a += take
        yield _batch(links, left)
    links, left = [], []
    close(links, left)
    yield _batch(links, left)


def _between_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, second, block, fp), sorted; each pair of blocks is one run."""
    pair, fps, blocks = None, [], []
    for batch in batches:
        links: list[tuple[int, int]] = []
        for *own, block, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != pair:
                links += spanning_links(np.array(fps, np.int64), np.array(blocks))
                pair, fps, blocks = own, [], []
            fps.append(fp)
            blocks.append(block)
        yield _batch(links, [])
    yield _batch(spanning_links(np.array(fps, np.int64), np.array(blocks)), [])


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column `fp`) of at most three bits.

    Not every linked pair is listed, but any two linked fingerprints are connected.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(own), 4096):
                part = own[i:i + 4096]
                keys, rows = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    met = settle(
        fps.select("fp").mapInArrow(keyed, "key long, fp long")
        .repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(_within_keys, LINK_FIELDS), "simhash-links")
    links = met.filter("key is null").select("a", "b")
    left = met.filter("key is not null").select("key", "block", F.col("a").alias("fp"))
    # blocks of one key: each pair of them, first < second; each row goes to all pairs of its block
    count = left.groupBy("key").agg((F.max("block") + 1).alias("n")).filter("n > 1")
    pairs = (
        left.join(count, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .filter("other <> block")
        .select("key", F.least("block", "other").alias("first"),
                F.greatest("block", "other").alias("second"), "block", "fp")
        .repartition("key", "first", "second")
        .sortWithinPartitions("key", "first", "second", "fp")
        .mapInArrow(_between_blocks, LINK_FIELDS).select("a", "b")
    )
    return links.unionByName(pairs).distinct()


def rooted_rows(docs: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """(id, fp, root, component_id): `root` is one fingerprint for each group."""
    rows = settle(fingerprints(docs, id_col, text_col, words_each), "simhash")
    nodes = settle(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    roots = components(near_links(nodes))
    rooted = settle(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # written out, so that Spark can split the rows of a hot fingerprint in the join
    named = settle(
        rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-groups")
    return rows.join(named, "fp")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words_each: int = SHINGLE_WORDS,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable."""
    return rooted_rows(docs, id_col, text_col, words_each).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _candidates(fps: DataFrame) -> DataFrame:
    """(node, fp) -> (a, b): nodes with linked fingerprints, each by one node of its fingerprint."""
    # written out, so that Spark can split the rows of a hot fingerprint in the join
    first = settle(fps.groupBy("fp").agg(F.min("node").alias("first")), "simhash-first")
    links = settle(near_links(first), "simhash-near")
    far = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return fps.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(
        far.select(F.col("x").alias("a"), F.col("y").alias("b")))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    like: Likeness = CORPUS_COPIES,
) -> DataFrame:
    """`docs` with one row of each group of near copies, the one with the smallest id.

    Near copies are `like` on their whole shingle sets. Linked fingerprints of shingles of the same
    length propose pairs; as three bits of 64 find few pairs at a similarity of 0.8, MinHash keys
    propose the rest.

    Null texts count as empty; rows without words are near copies of none. A row without an id stays
    only in a group without any; there the smallest text hash decides. Of rows repeated with id and
    text one stays. An empty table gives an empty table.
    """
    names = row_key(id_col, text_col)
    keyed = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        names[0].alias("row_id"), names[1].alias("digest"))
    sketched = settle(
        sketches(keyed, "text", like, ["id", "row_id", "digest"]), "near-sketches")
    fps = settle(
        fingerprints(keyed.select("digest", "text"), "digest", "text", like.words)
        .groupBy("digest").agg(F.min("fp").alias("fp")), "near-fingerprints")
    named = sketched.filter("node is not null").select("digest", "node").distinct()
    candidates = _candidates(
        settle(fps.join(named, "digest").groupBy("node").agg(F.min("fp").alias("fp")),
               "near-named"))
    roots = alike_roots(sketched, docs, text_col, like, candidates)
    # rows without words meet by their text only
    rows = sketched.select("id", "row_id", "digest", F.coalesce("node", "digest").alias("node"))
    groups = settle(
        rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")),
        "near-groups")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), "digest")
    first = settle(groups.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("size"))
                   .filter("size > 1"), "near-first")
    marks = groups.join(first, "root").select(
        F.col("row_id").alias("__id"), F.col("digest").alias("__digest"),
        (order == F.col("first")).alias("stays"))
    return keep_marked(docs, marks, id_col, text_col)
