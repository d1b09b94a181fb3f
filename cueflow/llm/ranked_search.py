"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

The index has one row for each segment: up to `SEGMENT_ROWS` documents (or `SEGMENT_BYTES` of text)
of one task. Within a segment documents are numbered by rising length, so the postings of a
block have similar lengths and its bound (most occurrences, least length) is close. A posting list is
cut into blocks of `BLOCK` postings, each kept as the differences of the numbers and the occurrences
in as few bytes as they need. Documents without a term are in no segment.

A search takes three steps, each over all segments:

1. document frequencies of the items' terms, and the numbers of documents and terms, are added up;
2. in every segment each item is answered by itself: terms are sorted by their global bound. As long
   as the bounds of the first ones together cannot beat the item's k-th best score, these lists are
   not essential: they give no candidates. Documents are taken in ranges; a range whose block
   maxima cannot beat the k-th best is passed over. Candidates come from the essential lists; on the
   other lists, best bound first, a candidate whose score so far and the block maxima of what is
   left cannot beat the k-th best is dropped before its block is unpacked;
3. the heaps of the segments, at most k rows for each item, are merged by rank.

Items are taken in blocks of `ITEMS_AT_ONCE`, so what every task gets is bounded; documents are never
cut or sampled. Scores are whole numbers, so the result is that of scoring every document.

Null and empty texts have no terms: such documents are never found and such items find nothing. Rows
repeated with an id are documents (items) of their own. Equal scores rank by ascending
id, null ids last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.session import settle

TOP = 50
SEGMENT_ROWS = 1 << 14
SEGMENT_BYTES = 24 << 20
BLOCK = 128
#: Documents of a segment that are scored at once.
RANGE = 2048
ITEMS_AT_ONCE = 1024

#: Fixed values of the term class: A-Z in lower case; digits, a-z and all bytes beyond ASCII stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def pack_numbers(values: np.ndarray) -> bytes:
    """One byte for the width, then the values in it."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack_numbers(data: memoryview, count: int) -> tuple[np.ndarray, int]:
    """(values, bytes used)."""
    width = data[0]
    return np.frombuffer(data, f"<u{width}", count, 1).astype(np.int64), 1 + width * count


INDEX_FIELDS = (
    "lengths binary, ids {ids}, terms binary, counts binary, "
    "firsts binary, most binary, least binary, places binary, postings binary")


@dataclass
class Postings:
    """All postings of a segment, sorted by term, then document number."""

    terms: list[bytes]
    counts: np.ndarray  # postings by term
    numbers: np.ndarray
    times: np.ndarray


def gather(texts: list[list[bytes]]) -> Postings:
    """Postings of documents (lists of terms) by their position."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    coded = pa.array([t for own in texts for t in own], pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    pairs, times = np.unique(
        rank[coded.indices.to_numpy()] * len(texts) + owner, return_counts=True)
    term, numbers = np.divmod(pairs, len(texts))
    return Postings([names[i] for i in order], np.bincount(term, minlength=len(names)), numbers, times)


def segment_row(texts: list[list[bytes]], ids: pa.Array) -> list:
    """The values of one index row; `texts` have a term each."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(lengths, kind="stable")
    own = gather([texts[i] for i in order])
    lengths = lengths[order]
    # blocks: every BLOCK-th posting of a list begins one
    ends = np.cumsum(own.counts)
    inside = np.arange(len(own.numbers)) - np.repeat(ends - own.counts, own.counts)
    starts = np.flatnonzero(inside % BLOCK == 0)
    stops = np.append(starts[1:], len(own.numbers))
    most = np.maximum.reduceat(own.times, starts) if len(starts) else starts
    least = lengths[own.numbers[starts]]  # numbers rise with the length
    gaps = np.diff(own.numbers, prepend=0)
    gaps[starts] = 0
    # a block of one posting is told by its bound: nothing is packed
    some = np.flatnonzero(stops - starts > 1)
    packed = [pack_numbers(gaps[a + 1:b]) + pack_numbers(own.times[a:b])
              for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)]
    sizes = np.zeros(len(starts) + 1, np.int64)
    sizes[some + 1] = [len(p) for p in packed]
    places = np.cumsum(sizes)
    numbers = lambda v, kind: np.asarray(v).astype(kind).tobytes()
    return [
        numbers(lengths, "<u4"), ids.take(pa.array(order)), b" ".join(own.terms),
        numbers(own.counts, "<u4"), numbers(own.numbers[starts], "<u4"), numbers(most, "<u4"),
        numbers(least, "<u4"), numbers(places, "<u8"), b"".join(packed)]


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """One row for each segment; every document with a term is in one."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list[bytes]] = []
        ids: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            values = segment_row(texts, pa.concat_arrays(ids))
            row = [pa.array([v], pa.binary()) if isinstance(v, bytes) else
                   pa.ListArray.from_arrays([0, len(v)], v) for v in values]
            names = [f.split()[0] for f in INDEX_FIELDS.split(", ")]
            texts.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [terms_of(t.as_py()) for t in part.column(0)]
                some = [i for i, t in enumerate(own) if t]
                if some:
                    texts += [own[i] for i in some]
                    ids.append(part.column(1).take(pa.array(some)))
                    size += sum(map(len, own)) * 8
                if len(texts) + 256 > segment_rows or size >= segment_bytes:
                    if texts:
                        yield close()
                    size = 0
        if texts:
            yield close()

    return docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id")).mapInArrow(
        run, INDEX_FIELDS.format(ids=f"array<{kind.simpleString()}>"))


def weight(documents: int, frequency: int) -> int:
    return int(1000 * log((2 * documents + 2) / (2 * frequency + 1)))


@dataclass
class Corpus:
    """Numbers of documents and of their terms, and the weights of the items' terms."""

    documents: int
    terms: int
    weights: dict[bytes, int]

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 50 + 50 * lengths.astype(np.int64) * self.documents // self.terms


def impact(weights, times: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * times // (1000 * times + 20 * norms))


class Segment:
    """One row of the index, opened for reading."""

    def __init__(self, row: dict, corpus: Corpus):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.norms = corpus.norms(read("lengths", "<u4"))
        self.terms = pa.array(bytes(row["terms"]).split(b" "), pa.binary())
        self.counts = read("counts", "<u4").astype(np.int64)
        self.first_block = np.concatenate([[0], np.cumsum(-(-self.counts // BLOCK))])
        self.firsts, self.most = read("firsts", "<u4").astype(np.int64), read("most", "<u4").astype(np.int64)
        self.places, self.postings = read("places", "<u8"), memoryview(row["postings"])
        self.block_norms = corpus.norms(read("least", "<u4"))
        self.lists: dict[bytes, TermList | None] = {}
        wanted = list(corpus.weights)
        at = pc.index_in(pa.array(wanted, pa.binary()), value_set=self.terms).to_pylist()
        for term, i in zip(wanted, at, strict=True):
            self.lists[term] = None if i is None else TermList(self, i, corpus.weights[term])


class TermList:
    """The posting list of a term: block bounds at once, blocks when they are asked for."""

    def __init__(self, segment: Segment, at: int, weight_: int):
        self.segment, self.weight, self.count = segment, weight_, int(segment.counts[at])
        self.block0, end = int(segment.first_block[at]), int(segment.first_block[at + 1])
        own = slice(self.block0, end)
        self.firsts = segment.firsts[own]
        self.bounds = impact(weight_, segment.most[own], segment.block_norms[own])
        self.bound = int(self.bounds.max())
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of a block."""
        if b not in self.kept:
            s, k = self.segment, self.block0 + b
            n = min(BLOCK, self.count - b * BLOCK)
            if n == 1:
                numbers, times = self.firsts[b:b + 1], s.most[k:k + 1]
            else:
                data = s.postings[int(s.places[k]):int(s.places[k + 1])]
                gaps, used = unpack_numbers(data, n - 1)
                numbers = self.firsts[b] + np.concatenate([[0], np.cumsum(gaps)])
                times, _ = unpack_numbers(data[used:], n)
            self.kept[b] = numbers, impact(self.weight, times, s.norms[numbers])
        return self.kept[b]

    def span(self, low: int, high: int) -> tuple[int, int]:
        """Blocks that may hold numbers from `low` up to `high`, exclusive."""
        a = int(np.searchsorted(self.firsts, low, "right")) - 1
        return max(a, 0), int(np.searchsorted(self.firsts, high, "left"))

    def within(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span(low, high)
        if a >= b:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        numbers, scores = (np.concatenate(x) for x in zip(*map(self.block, range(a, b)), strict=True))
        inside = slice(*np.searchsorted(numbers, [low, high]))
        return numbers[inside], scores[inside]


def search_segment(
    lists: list[TermList], documents: int, top: int, least: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores) of the `top` best documents that reach `least`, with all ties of the last."""
    lists = sorted(lists, key=lambda t: t.bound)
    reach = np.cumsum([0, *(t.bound for t in lists)])  # of the first i lists together
    best_numbers, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    # a document must reach `least`; equal scores compete by id
    for low in range(0, documents, RANGE):
        high = min(low + RANGE, documents)
        # lists whose bounds together stay below the k-th best give no candidates
        essential = int(np.searchsorted(reach[1:], max(least, 1), "left"))
        spans = [t.span(low, high) for t in lists]
        here = [int(t.bounds[a:b].max(initial=0)) for t, (a, b) in zip(lists, spans, strict=True)]
        if sum(here) < max(least, 1):
            continue
        total = np.zeros(high - low, np.int64)
        for t in lists[essential:]:
            numbers, scores = t.within(low, high)
            total[numbers - low] += scores
        found = np.flatnonzero(total)
        below = np.cumsum([0, *here[:essential]])
        for i in range(essential - 1, -1, -1):
            found = found[total[found] + below[i + 1] >= least]
            if not len(found):
                break
            t = lists[i]
            blocks = np.maximum(np.searchsorted(t.firsts, found + low, "right") - 1, 0)
            # block maxima reject candidates before a block is unpacked
            stays = total[found] + t.bounds[blocks] + below[i] >= least
            found, blocks = found[stays], blocks[stays]
            for b in np.unique(blocks).tolist():
                numbers, scores = t.block(b)
                mine = found[blocks == b]
                at = np.searchsorted(numbers, mine + low)
                at[at == len(numbers)] = 0
                hit = numbers[at] == mine + low
                total[mine[hit]] += scores[at[hit]]
        found = found[total[found] >= max(least, 1)]
        best_numbers = np.concatenate([best_numbers, found + low])
        best_scores = np.concatenate([best_scores, total[found]])
        if len(best_scores) > top:
            least = int(np.partition(best_scores, -top)[-top])
            stays = best_scores >= least
            best_numbers, best_scores = best_numbers[stays], best_scores[stays]
    return best_numbers, best_scores


def _frequencies(index: DataFrame, wanted: list[bytes]) -> DataFrame:
    """(term, df) over all segments; the null term has the numbers of documents and terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(wanted, pa.binary())
        for batch in batches:
            for terms, counts, lengths in zip(*batch.columns, strict=True):
                own = pa.array(terms.as_py().split(b" "), pa.binary())
                at = pc.index_in(asked, value_set=own)
                there = pc.is_valid(at)
                counts = np.frombuffer(counts.as_py(), "<u4")
                n = np.frombuffer(lengths.as_py(), "<u4")
                df = counts[at.drop_null().to_numpy()].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([asked.filter(there), pa.array([None], pa.binary())]),
                     pa.array(np.append(df, len(n))),
                     pa.array(np.append(np.zeros(len(df), np.int64), n.sum(dtype=np.int64)))],
                    ["term", "df", "terms"])

    return index.select("terms", "counts", "lengths").mapInArrow(
        run, "term binary, df long, terms long").groupBy("term").agg(
            F.sum("df").alias("df"), F.sum("terms").alias("terms"))


def _search(
    index: DataFrame, id_col: str, items: list[tuple[int, list[bytes]]], corpus: Corpus, top: int
) -> DataFrame:
    """(item, id, score): of every segment and item the documents that may be among the best."""
    kind = index.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an item's best scores in the segments of this task: what falls short of them all is out
        heaps = {item: np.empty(0, np.int64) for item, _ in items}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                ids = row.pop("ids").values
                segment = Segment({k: v.as_buffer() for k, v in row.items()}, corpus)
                for item, terms in items:
                    lists = [segment.lists[t] for t in terms if segment.lists[t] is not None]
                    if not lists:
                        continue
                    heap = heaps[item]
                    least = int(heap[0]) if len(heap) == top else 0
                    numbers, scores = search_segment(lists, len(segment.norms), top, least)
                    own = pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(numbers), item)), ids.take(pa.array(numbers)),
                         pa.array(scores)], ["item", id_col, "score"])
                    if len(numbers) > top:
                        order = pc.sort_indices(own, [("score", "descending"), (id_col, "ascending")])
                        own = own.take(order[:top])
                    heaps[item] = np.sort(np.concatenate([heap, scores]))[-top:]
                    yield own

    return index.mapInArrow(run, f"item long, `{id_col}` {kind.simpleString()}, score long")


def best_documents(
    index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
    id_col: str = "doc_id", top: int = TOP, at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """(item, rank, id, score): the `top` best documents of each row of `items`, from rank 1."""
    spark = index.sparkSession
    # a number for each item; blocks by its hash, so about `at_once` of them are in the driver and
    # in every task at a time
    numbered = settle(
        items.select(F.col(item_col).alias("__item"), F.col(text_col).alias("__text"))
        .withColumn("item", F.monotonically_increasing_id()), "search-items")
    blocks = -(-numbered.count() // at_once)
    item_kind = items.schema[item_col].dataType.simpleString()
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    out = None
    for number in range(blocks):
        block = numbered.filter(
            F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        asked = [(r.item, sorted(set(terms_of(r["__text"])))) for r in block]
        wanted = sorted({t for _, terms in asked for t in terms})
        counted = _frequencies(index, wanted).collect()
        whole = next((r for r in counted if r.term is None), None)
        if whole is None:
            break
        corpus = Corpus(whole.df, whole.terms, {
            bytes(r.term): weight(whole.df, r.df) for r in counted if r.term is not None})
        # terms of no weight change no score
        asked = [(i, [t for t in terms if corpus.weights.get(t)]) for i, terms in asked]
        corpus.weights = {t: w for t, w in corpus.weights.items() if w}
        found = _search(index, id_col, [a for a in asked if a[1]], corpus, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame(
            [], f"`{item_col}` {item_kind}, rank int, `{id_col}` {id_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(id_col))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("item", F.col("__item").alias(item_col)), "item").select(
        item_col, "rank", id_col, "score")
