"""Passages that repeat across documents, by sparse suffix arrays and window hashes.

Only suffixes at minimisers are kept: of every `WINDOW` consecutive grams of `GRAM` words, the one
with the smallest hash, the rightmost of several (inside a run of equal grams every GRAM-th from its
end). The choice depends on the words alone, so two documents that share `LEAST` = GRAM + WINDOW - 1
words in a row share an anchor in them.

1. Anchors are rows (gram, document, position). Grams that occur once are done.
2. Grams of at most `NEIGHBOURS` + 1 rows meet their texts again and get their suffixes and what
   precedes them, as word hashes, `LEAST` words each way; a longer passage has further anchors, whose
   spans join up. Rows are dealt by gram and sorted, so that each suffix meets all others of its gram
   among the `NEIGHBOURS` after it. Matches are extended to the left; those of at least LEAST words
   between different documents count.
3. For grams of more rows, each window of LEAST words around an anchor is a row (hash, document,
   position). The two smallest documents of each hash come from aggregates that combine on the map
   side, and go back to the windows in a join. The cost grows with the rows, not with their pairs.

Every two documents that share LEAST words in a row share an anchor in them, and either all rows of
its gram are compared or all windows around it, so no passage is missed.

Of a passage the smallest document keeps its copy: a match is `gone` from the larger of its two
documents, never from the smaller, so the words of a passage always stay somewhere.

Nulls count as empty texts; texts of fewer than LEAST words have no anchor. Rows that repeat id and
text are one document. Documents without an id come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.exact_dedup import mark_groups
from cueflow.session import settle

GRAM = 16
WINDOW = 35
LEAST = GRAM + WINDOW - 1
NEIGHBOURS = 16
NO_ID = (1 << 63) - 1
BLANKS = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in (text or "").encode().split()], np.uint64)


def _grams(words: np.ndarray) -> np.ndarray:
    """Hash of each run of GRAM words, from halves that neighbouring runs share."""
    out, width = words, 1
    while width < GRAM:
        out = out[:-width] * _MIX + (out[width:] ^ (out[width:] >> np.uint64(29)))
        width *= 2
    return out * _MIX


def anchors_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, position) of the minimisers."""
    if len(words) < LEAST:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = _grams(words)
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], WINDOW)
    last = len(grams) - 1
    at = [last - (np.arange(i, min(i + 65536, len(views))) + views[i:i + 65536].argmin(1))
          for i in range(0, len(views), 65536)]
    at = np.unique(np.concatenate(at))
    same = np.concatenate([grams[1:] == grams[:-1], [False]])
    stops = np.flatnonzero(~same)
    to_end = stops[np.searchsorted(stops, at)] - at
    at = at[to_end % GRAM == 0]
    return grams[at], at


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(number.alias("number"), F.xxhash64(number, text).alias("doc"),
                       text.alias("text"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors_of(word_hashes(t.as_py())) for t in batch.column(1)]
        counts = [len(g) for g, _ in found]
        docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        grams = np.concatenate([g for g, _ in found] or [np.empty(0, np.uint64)])
        at = np.concatenate([p for _, p in found] or [np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams.view(np.int64)), pa.array(docs), pa.array(at.astype(np.int32))],
            ["gram", "doc", "pos"])


ROW_FIELDS = "number long, doc long, pos int, suffix binary, before binary"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words from each anchor on and words before it, nearest first, four bytes each."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            number, doc, pos, suffix, before = [], [], [], [], []
            for n, d, text, positions in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = word_hashes(text).astype(">u4").tobytes()
                back = np.frombuffer(raw, ">u4")[::-1].tobytes()
                for p in positions:
                    number.append(n)
                    doc.append(d)
                    pos.append(p)
                    suffix.append(raw[4 * p:4 * (p + LEAST)])
                    start = len(raw) - 4 * p
                    before.append(back[start:start + 4 * LEAST])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()),
                 pa.array(suffix, pa.binary()), pa.array(before, pa.binary())],
                ["number", "doc", "pos", "suffix", "before"])


class Suffixes:
    """Consecutive rows of the suffix array."""

    def __init__(self, number, doc, pos, suffix, before):
        self.number, self.doc, self.pos = number, doc, pos
        self.suffix, self.before = suffix, before

    @staticmethod
    def read(batch: pa.RecordBatch) -> Suffixes:
        flat = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        return Suffixes(*flat, *(Suffixes.matrix(batch.column(i)) for i in (3, 4)))

    @staticmethod
    def matrix(column: pa.Array) -> np.ndarray:
        """One row of LEAST hashes each; missing words have a hash above 32 bits, by side."""
        values = column.to_pylist()
        lengths = np.array([len(v) // 4 for v in values], np.int64)
        out = np.full((len(values), LEAST), 1 << 32, np.int64)
        out[np.arange(LEAST) < lengths[:, None]] = np.frombuffer(b"".join(values), ">u4")
        return out

    def take(self, at) -> Suffixes:
        return Suffixes(self.number[at], self.doc[at], self.pos[at], self.suffix[at],
                        self.before[at])

    def joined(self, other: Suffixes) -> Suffixes:
        return Suffixes(*(np.concatenate([a, b]) for a, b in zip(
            vars(self).values(), vars(other).values(), strict=True)))

    def __len__(self) -> int:
        return len(self.number)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows; the end of a text equals nothing."""
    differs = (a != b) | (a == 1 << 32)
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


class Spans:
    """For each suffix the widest match found, and the widest that is gone from its document."""

    def __init__(self, rows: Suffixes):
        self.rows = rows
        n = len(rows)
        self.right, self.left, self.gone_right, self.gone_left = np.zeros((4, n), np.int64)
        self.partner = np.full(n, NO_ID)

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        rows = self.rows
        near = (rows.suffix[x, :GRAM] == rows.suffix[y, :GRAM]).all(1) & (rows.doc[x] != rows.doc[y])
        x, y = x[near], y[near]
        right = _common(rows.suffix[x], rows.suffix[y])
        left = _common(rows.before[x], rows.before[y])
        match = right + left >= LEAST
        x, y, right, left = x[match], y[match], right[match], left[match]
        smaller = (rows.number[x] < rows.number[y]) | (
            (rows.number[x] == rows.number[y]) & (rows.doc[x] < rows.doc[y]))
        small, large = np.where(smaller, x, y), np.where(smaller, y, x)
        for at, other in ((small, large), (large, small)):
            np.maximum.at(self.right, at, right)
            np.maximum.at(self.left, at, left)
            np.minimum.at(self.partner, at, rows.number[other])
        np.maximum.at(self.gone_right, large, right)
        np.maximum.at(self.gone_left, large, left)

    def batch(self) -> pa.RecordBatch:
        found = self.right > 0
        rows = self.rows
        pos = rows.pos.astype(np.int64)
        columns = (rows.number, rows.doc, pos - self.left, pos + self.right,
                   pos - self.gone_left, pos + self.gone_right, self.partner)
        return pa.RecordBatch.from_arrays([pa.array(c[found]) for c in columns], SPAN_NAMES)


SPAN_NAMES = ["number", "doc", "start", "stop", "gone_start", "gone_stop", "partner"]
SPAN_FIELDS = ", ".join(f"{name} long" for name in SPAN_NAMES)


def _neighbour_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by suffix; rows held from the batch before give further spans, which join up."""
    held: Suffixes | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Suffixes.read(batch)
        rows = held.joined(rows) if held is not None else rows
        spans, all_ = Spans(rows), np.arange(len(rows))
        for step in range(1, min(NEIGHBOURS, len(rows) - 1) + 1):
            spans.compare(all_[:-step], all_[step:])
        yield spans.batch()
        held = rows.take(np.arange(max(0, len(rows) - NEIGHBOURS), len(rows)))


def windows_at(words: np.ndarray, positions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each window of LEAST words that holds the gram at one of `positions`."""
    starts = np.unique((np.array(positions, np.int64)[:, None] - np.arange(WINDOW)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(words) - LEAST)]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    grams = _grams(words)
    out = grams[starts]
    for step in [*range(GRAM, LEAST - GRAM, GRAM), LEAST - GRAM]:
        out = (out ^ (out >> np.uint64(32))) * _MIX + grams[starts + step]
    return (out ^ (out >> np.uint64(29))) * _MIX, starts


WINDOW_FIELDS = "hash long, number long, doc long, start int, leads boolean"


def _leads(hashes: np.ndarray) -> np.ndarray:
    """Whether each is the first of its value."""
    out = np.zeros(len(hashes), bool)
    out[np.unique(hashes, return_index=True)[1]] = True
    return out


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`leads` marks the first window of each hash in a document."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            number, doc, text, positions = (c.to_pylist() for c in batch.slice(i, 64).columns)
            found = [windows_at(word_hashes(t), p) for t, p in zip(text, positions, strict=True)]
            counts = [len(h) for h, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h for h, _ in found]).view(np.int64)),
                 pa.array(np.repeat(np.array(number, np.int64), counts)),
                 pa.array(np.repeat(np.array(doc, np.int64), counts)),
                 pa.array(np.concatenate([s for _, s in found]).astype(np.int32)),
                 pa.array(np.concatenate([_leads(h) for h, _ in found]))],
                ["hash", "number", "doc", "start", "leads"])


def _window_spans(windows: DataFrame) -> DataFrame:
    """Spans of the windows (WINDOW_FIELDS) that stand in more than one document."""
    own = F.struct("number", "doc")
    # each task passes on the two smallest documents of a hash, however many have it
    order = Window.partitionBy("hash").orderBy(F.asc_nulls_first("number"), "doc")
    smallest = windows.filter("leads").select("hash", "number", "doc").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
    # written out, so that Spark can split the rows of a hot window in the join
    both = settle(
        smallest.groupBy("hash").agg(
            F.min(own).alias("first"), F.max(own).alias("last"))
        .filter("first <> last").select("hash", "first", F.col("last.number").alias("second")),
        "window-first")
    start = F.col("start").cast("long")
    mine = own == F.col("first")
    return windows.join(both, "hash").select(
        "number", "doc", start.alias("start"), (start + LEAST).alias("stop"),
        start.alias("gone_start"), F.when(mine, start).otherwise(start + LEAST).alias("gone_stop"),
        F.when(mine, F.col("second")).otherwise(F.col("first.number")).alias("partner"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(number, doc, start, stop, gone_start, gone_stop, partner): word spans of anchors and windows.

    `doc` is `document_key` of the row. Words from gone_start to gone_stop also stand in a document
    with a smaller id; the two are equal where there is none. `partner` is the smallest id matched.
    """
    named = _documents(docs, id_col, text_col)
    anchors = settle(
        named.select("doc", "text").mapInArrow(_anchor_rows, "gram long, doc long, pos int"),
        "anchors")
    # written out, so that Spark can split the rows of a hot gram in the join
    often = settle(
        anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
        .select("gram", (F.col("n") > NEIGHBOURS + 1).alias("hot")), "often")
    at = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("pos"))))
    positions = settle(
        anchors.join(often, "gram").groupBy("doc")
        .agg(at(~F.col("hot")).alias("some"), at(F.col("hot")).alias("many")), "positions")

    def meet(which: str) -> DataFrame:
        part = positions.filter(F.size(which) > 0).select("doc", F.col(which).alias("positions"))
        # a bitmap spares the texts without such a position the way to the join
        some = mark_groups(named, part, "doc").filter("survives").select("number", "doc", "text")
        return some.join(part, "doc").select("number", "doc", "text", "positions")

    order = ["suffix", "number", "doc", "pos"]
    near = (
        meet("some").mapInArrow(_context_rows, ROW_FIELDS)
        .repartition(F.substring("suffix", 1, 4 * GRAM)).sortWithinPartitions(*order)
        .mapInArrow(_neighbour_spans, SPAN_FIELDS)
    )
    windows = settle(meet("many").mapInArrow(_window_rows, WINDOW_FIELDS), "windows")
    return near.unionByName(_window_spans(windows))


def _merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        merged = [
            pa.array([[{"start": a, "stop": b} for a, b in _merged(
                [r[start] for r in rows], [r[stop] for r in rows])]
                for rows in batch.column(1).to_pylist()], kind)
            for start, stop in (("start", "stop"), ("gone_start", "gone_stop"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *merged, batch.column(2)], ["doc", "spans", "gone", "partners"])


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, spans, gone, partners): one row per document with a passage that repeats.

    Spans are word positions [start, stop); `gone` are those that also stand in documents with
    smaller ids. `partners` are ids of documents that share a passage, for each anchor or window the
    smallest.
    """
    spans = repeated_spans(docs, id_col, text_col)
    some = "array<struct<start:bigint,stop:bigint>>"
    return (
        spans.groupBy("doc").agg(
            F.collect_set(F.struct("start", "stop", "gone_start", "gone_stop")).alias("rows"),
            F.sort_array(F.collect_set("partner")).alias("partners"))
        .mapInArrow(_merge_rows, f"doc long, spans {some}, gone {some}, partners array<long>")
    )


def document_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """The key by which `repeated_passages` names a row."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return F.xxhash64(number, F.coalesce(F.col(text_col), F.lit("")))


def words_of(spans: F.Column) -> F.Column:
    """How many words some spans hold; null counts as none."""
    return F.coalesce(F.aggregate(
        spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0)).cast("long")


def without_words(text: str, gone: list[tuple[int, int]]) -> str:
    """`text` without the words of `gone` and the blanks that follow them."""
    raw, out, done = text.encode(), [], 0
    blank = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(BLANKS, np.uint8))
    starts = np.append(np.flatnonzero(~blank & np.append(True, blank[:-1])), len(raw)).tolist()
    for a, b in gone:
        out.append(raw[done:starts[a]])
        done = starts[b]
    out.append(raw[done:])
    return b"".join(out).decode()


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with each passage left only in the smallest document that has it."""
    gone = repeated_passages(docs, id_col, text_col).filter("size(gone) > 0").select(
        F.col("doc").alias("__doc"), F.col("gone").alias("__gone"))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [
                    without_words(t, [(s["start"], s["stop"]) for s in spans]) if spans else t
                    for t, spans in zip(part.column(at).to_pylist(),
                                        part.column(len(names)).to_pylist(), strict=True)]
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    marked = docs.withColumn("__doc", document_key(id_col, text_col)).join(gone, "__doc", "left")
    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return marked.select(*names, "__gone").mapInArrow(run, fields)
