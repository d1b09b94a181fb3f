"""Near copies by MinHash keys and sequential Bayesian verification.

The shingles of a text are all runs of `words` of its lower-cased words (the whole sequence where it
has fewer). Two texts are alike when the Jaccard similarity of their sets is `alike` or more. Equal
sets are one node; a text without words has an empty set and is like nothing.

1. Every text is read once: size of its set, digest of its set, one byte of each of its minimum
   hashes (the signature), and one key for each band of minimum hashes. Two texts share no key with
   a probability of (1 - alike^rows)^bands at most.
2. Each key's nodes are paired with the `LEADERS` nodes of the key that come first in one order of
   all nodes. That is every pair of a key of up to LEADERS + 1 nodes, and a bounded number of pairs
   for each row of a larger one.
3. Pairs are verified in sequence: after each batch of the signature the posterior of the similarity,
   given the matches so far, must leave it a probability of at least `MISS` (over all batches) to
   reach the limit; what stays is compared on the whole sets of 64-bit shingle hashes.
4. What links is joined up. Larger keys whose nodes are still in different groups are compared in
   blocks of at most about `BLOCK` nodes, by the same sequence, all pairs of different groups; only
   the links of a spanning forest leave a task. So no group is capped, and no pairs are written out.

Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.components import components
from cueflow.llm.exact_dedup import mark_groups
from cueflow.session import settle

LEADERS = 3
BLOCK = 512
#: Probability that the verification drops a pair at the limit.
MISS = 1e-6
#: Minimum hashes compared at once.
BATCH = 32
SHINGLES_AT_ONCE = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Likeness:
    """Shingle length, least similarity in hundredths, and the keys that propose pairs."""

    words: int
    hundredths: int
    bands: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def enough(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.hundredths * (a + b - shared)

    @lru_cache(maxsize=4)  # noqa: B019
    def factors(self) -> np.ndarray:
        drawn = np.random.default_rng(7).integers(0, 1 << 31, self.hashes, np.uint32)
        return drawn * np.uint32(2) + np.uint32(1)

    @lru_cache(maxsize=4)  # noqa: B019
    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, least number of matches to go on) after each batch.

        With a flat prior, the posterior of the share of matching bytes after m of n is
        Beta(m + 1, n - m + 1); its mass from p upward is that of Binomial(n + 1, p) up to m.
        """
        limit = self.hundredths / 100
        p = limit + (1 - limit) / 256  # bytes also match by chance
        ends = [*range(BATCH, self.hashes, BATCH), self.hashes]
        out = []
        for n in ends:
            mass, m = 0.0, -1
            while mass < MISS / len(ends):
                m += 1
                mass += comb(n + 1, m) * p ** m * (1 - p) ** (n + 1 - m)
            out.append((n, m))
        return out


#: Of 3 words; a pair at 0.85 shares none of the keys with a probability of 3e-7.
NEAR_COPIES = Likeness(3, 85, 32, 6)
#: Of 5 words; a pair at 0.8 shares none of the keys with a probability of 3e-6.
CORPUS_COPIES = Likeness(5, 80, 32, 5)


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in (text or "").encode().lower().split()], np.uint64)
    if not len(words):
        return words
    each = min(words_each, len(words))
    n = len(words) - each + 1
    out = np.full(n, each, np.uint64)
    for i in range(each):
        out = (out ^ (out >> np.uint64(32))) * _MIX + words[i:i + n]
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def minima(shingles: np.ndarray, like: Likeness) -> np.ndarray:
    """Minimum hashes of a set that is not empty (uint32)."""
    least = np.full(like.hashes, np.iinfo(np.uint32).max, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(folded), SHINGLES_AT_ONCE):
        part = folded[i:i + SHINGLES_AT_ONCE]
        least = np.minimum(least, (like.factors()[:, None] * part).min(1))
    return least


def keys_of(least: np.ndarray, like: Likeness) -> np.ndarray:
    """One key per band (uint64)."""
    rows = least.reshape(like.bands, like.rows).astype(np.uint64)
    key = np.arange(like.bands, dtype=np.uint64)
    for r in range(like.rows):
        key = (key ^ (key >> np.uint64(32))) * _MIX + rows[:, r]
    return (key ^ (key >> np.uint64(29))) * _MIX


def signature_of(least: np.ndarray) -> np.ndarray:
    """The highest byte of each minimum after mixing; a minimum's own high bits are nearly 0."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


SKETCH_FIELDS = "size int, node long, signature binary, keys array<long>"


def sketches(docs: DataFrame, text_col: str, like: Likeness, carry: list[str]) -> DataFrame:
    """`carry` and size, node (digest of the set), signature and keys; nulls where no words are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows: list[tuple] = []
                for text in part.column(0):
                    own = shingle_set(text.as_py(), like.words)
                    if len(own):
                        least = minima(own, like)
                        node = xxhash.xxh3_64_intdigest(own.tobytes())
                        rows.append((len(own), node - (node >> 63 << 64),
                                     signature_of(least).tobytes(),
                                     keys_of(least, like).view(np.int64)))
                    else:
                        rows.append((0, None, None, None))
                size, node, signature, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(size, pa.int32()), pa.array(node, pa.int64()),
                     pa.array(signature, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    [*carry, "size", "node", "signature", "keys"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.select(F.col(text_col).alias("__text"), *carry).mapInArrow(
        run, ", ".join([*fields, SKETCH_FIELDS]))


def _sets(texts: DataFrame, like: Likeness) -> DataFrame:
    """(node, text) -> (node, set): its shingle hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t.as_py(), like.words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _by_signature(pairs: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b, s, t: signatures) that the sequence of posterior bounds leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.arange(batch.num_rows)
            if len(left):
                s, t = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, like.hashes)
                        for c in batch.columns[2:])
                matches, start = np.zeros(len(left), np.int64), 0
                for n, least in like.least_matches():
                    matches = matches + (s[left, start:n] == t[left, start:n]).sum(1)
                    stays = matches >= least
                    left, matches, start = left[stays], matches[stays], n
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(left)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _exactly(pairs: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b, s, t: sets) that are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, s, t in zip(*batch.columns, strict=True):
                s, t = (np.frombuffer(x.as_buffer(), np.uint64) for x in (s, t))
                if like.enough(_shared(s, t), len(s), len(t)):
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Those of the candidate `pairs` (a, b, distinct, written out) that are alike."""
    def met(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
        return pairs.join(
            facts.select(F.col("node").alias("a"), F.col(column).alias("s")), "a").join(
            facts.select(F.col("node").alias("b"), F.col(column).alias("t")), "b"
        ).select("a", "b", "s", "t")

    likely = settle(_by_signature(met(pairs, nodes, "signature"), like), "minhash-likely")
    return settle(_exactly(met(likely, sets, "shingles"), like), "minhash-links")


@dataclass
class Unit:
    """Nodes of one key that one task compares: a block, or two (`block` tells which)."""

    node: np.ndarray
    root: np.ndarray
    block: np.ndarray
    band: int
    signature: np.ndarray
    keys: np.ndarray
    sets: list[np.ndarray]

    def links(self, like: Likeness, between: bool) -> list[tuple[int, int]]:
        """Links of a forest over the groups `root`; with `between` only of different blocks."""
        size = np.array([len(s) for s in self.sets])
        group = self.root.copy()
        out = []
        for i in range(len(self.node) - 1):
            rest = np.arange(i + 1, len(self.node))
            rest = rest[group[rest] != group[i]]
            if between:
                rest = rest[self.block[rest] != self.block[i]]
            small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
            rest = rest[100 * small >= like.hundredths * large]
            # pairs that share a key of an earlier band have met there
            if self.band:
                rest = rest[~(self.keys[rest, :self.band] == self.keys[i, :self.band]).any(1)]
            matches, start = np.zeros(len(rest), np.int64), 0
            for n, least in like.least_matches():
                matches = matches + (
                    self.signature[rest, start:n] == self.signature[i, start:n]).sum(1)
                stays = matches >= least
                rest, matches, start = rest[stays], matches[stays], n
            for j in rest[np.argsort(-matches, kind="stable")].tolist():
                if group[j] != group[i] and like.enough(
                        _shared(self.sets[i], self.sets[j]), size[i], size[j]):
                    out.append((int(self.node[i]), int(self.node[j])))
                    group[group == group[j]] = group[i]
        return out


def _block_links(rows: DataFrame, like: Likeness) -> DataFrame:
    """Rows (key, first, second, block, node, root, band, signature, keys, shingles), sorted by the
    first three: links within each unit (key, first, second)."""
    def close(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        block, node, root, band, signature, keys, sets = zip(*(h[1:] for h in held), strict=True)
        unit = Unit(
            np.array(node), np.array(root), np.array(block), band[0],
            np.frombuffer(b"".join(signature), np.uint8).reshape(-1, like.hashes),
            np.array(keys), [np.frombuffer(s, np.uint64) for s in sets])
        return unit.links(like, held[0][0][1] != held[0][0][2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    if held and held[0][0] != row[:3]:
                        found += close(held)
                        held = []
                    held.append((row[:3], *row[3:]))
            yield _pairs(found)
        yield _pairs(close(held))

    return rows.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _open_keys(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, band, node, root, members) of keys that the leaders did not settle."""
    # a narrow table of nodes; written out, so that Spark can split a hot side
    rows = settle(
        met.filter(F.col("members") > LEADERS + 1).join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")), "minhash-large")
    apart = settle(
        rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low < high").select("key"), "minhash-apart")
    return rows.join(apart, "key")


def _left_links(
    rows: DataFrame, nodes: DataFrame, sets: DataFrame, like: Likeness
) -> DataFrame:
    """Links between nodes of one key in different groups, by blocks."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = rows.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    facts = nodes.select("node", "signature", "keys").join(sets, "node")
    met = settle(
        dealt.join(facts, "node").select(
            "key", "blocks", "block", "node", "root", "band", "signature", "keys", "shingles"),
        "minhash-open")
    units = met.withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return settle(_block_links(
        units.select(
            "key", F.least("block", "other").alias("first"),
            F.greatest("block", "other").alias("second"), "block", "node", "root", "band",
            "signature", "keys", "shingles")
        .repartition("key", "first", "second")
        .sortWithinPartitions("key", "first", "second", "node"), like), "minhash-rest")


def alike_roots(
    sketched: DataFrame, docs: DataFrame, text_col: str, like: Likeness,
    known: DataFrame | None = None,
) -> DataFrame:
    """(node, root) of all nodes that are alike to another one; root names the group.

    `sketched` has the sketch of every row and `digest`, xxhash64 of its text; `docs` has the texts.
    `known` (a, b) are further candidate pairs of nodes.
    """
    known = None if known is None else known.filter("a <> b")
    nodes = settle(
        sketched.filter("node is not null").groupBy("node").agg(
            F.first("size").alias("size"), F.first("signature").alias("signature"),
            F.first("keys").alias("keys"), F.min("digest").alias("digest")), "minhash-nodes")
    keys = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    often = settle(
        keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"),
        "minhash-often")
    met = settle(keys.join(often, "key"), "minhash-met")

    # shingles of the nodes that have met another: the bitmap spares the other texts a shuffle
    involved = met.select("node")
    if known is not None:
        involved = involved.unionByName(known.select(F.col("a").alias("node"))).unionByName(
            known.select(F.col("b").alias("node")))
    wanted = settle(involved.distinct().join(nodes.select("node", "digest"), "node"),
                    "minhash-wanted")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = mark_groups(
        docs.select(text.alias("text"), F.xxhash64(text).alias("digest")),
        wanted.select("digest"), "digest").filter("survives").select("digest", "text")
    texts = texts.dropDuplicates(["digest"]).join(wanted, "digest")
    sets = settle(_sets(texts, like), "minhash-sets")

    order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    leaders = settle(
        met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS)
        .select("key", F.col("node").alias("node2"), F.col("size").alias("size2")),
        "minhash-leaders")
    fits = 100 * F.least("size", "size2") >= F.lit(like.hundredths) * F.greatest("size", "size2")
    pairs = met.join(leaders, "key").filter("node <> node2").filter(fits).select(
        F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    if known is not None:
        pairs = pairs.unionByName(
            known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = settle(pairs.distinct(), "minhash-pairs")
    links = _verified(pairs, nodes, sets, like)
    roots = settle(components(links), "minhash-roots")

    left = _left_links(_open_keys(met.drop("size"), roots), nodes, sets, like)
    if left.isEmpty():
        return roots
    # groups that the first links made are one node each from here on
    return settle(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                             .unionByName(left)), "minhash-groups")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    like: Likeness = NEAR_COPIES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_shingles, component_id, kept, `carry`) of every row.

    component_id is the smallest id of all rows that links reach. Rows without an id take part; a
    group of none but such has a null component, and their `kept` is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("__row_id"), text.alias("__row_text"),
        F.xxhash64(text).alias("digest"), *(F.col(c).alias(f"__carry_{c}") for c in carry))
    columns = ["__row_id", "digest", *(f"__carry_{c}" for c in carry)]
    sketched = settle(sketches(own, "__row_text", like, columns), "minhash-sketches")
    roots = alike_roots(sketched, docs, text_col, like)
    least = settle(
        sketched.filter("node is not null").groupBy("node").agg(F.min("__row_id").alias("least"))
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")),
        "minhash-least")
    groups = settle(
        least.join(least.groupBy("root").agg(F.min("least").alias("component")), "root")
        .select("node", "component"), "minhash-named")
    # a row without words must not meet others under one null key
    rows = sketched.filter("node is not null").join(groups, "node").unionByName(
        sketched.filter("node is null").withColumn("component", F.col("__row_id")))
    return rows.select(
        F.col("__row_id").alias(id_col), F.col("size").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("__row_id") == F.col("component")).alias("kept"),
        *(F.col(f"__carry_{c}").alias(c) for c in carry))
