"""Harmonic packing of token sequences.

A class k holds pieces of one k-th of the capacity and its bins take exactly k of them. Lengths are
made to fit: a document is cut into full bins and the powers of two that its remainder is a sum of,
so for a capacity that is a power of two every piece belongs to a class exactly and a full bin has
no gap. Bins are filled by each task for itself, from its own documents, so nothing is shuffled and
no task waits for another.

What is left in a class when a task ends is fewer than k pieces. They are closed as bins of the
powers of two that their number is a sum of, so these bins are a power of two long as well and need
no padding. A task therefore leaves at most log2(capacity) bins per class below the capacity.

Null text counts as empty; every document has at least the end id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueflow.llm.pieces import portions

END_ID = 1
#: Bins of one task in a sequence id; the task's number stands above.
BINS_PER_TASK = 1 << 40


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: full bins, then falling powers of two."""
    start = 0
    while length - start >= capacity:
        yield start, capacity
        start += capacity
    rest = length - start
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        yield start, piece
        start += piece
        rest -= piece


class HarmonicBins:
    """Bins of one task. A piece is any tuple; it waits until its bin is closed."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next_bin = capacity, task * BINS_PER_TASK
        self.waiting: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple], length: int) -> Iterator[tuple]:
        for i, piece in enumerate(pieces):
            yield (*piece, self.next_bin, i * length)
        self.next_bin += 1

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        open_bin = self.waiting.setdefault(length, [])
        open_bin.append(piece)
        if len(open_bin) == self.capacity // length:
            self.waiting[length] = []
            yield from self._close(open_bin, length)

    def finish(self) -> Iterator[tuple]:
        for length, pieces in self.waiting.items():
            for start, count in cut(len(pieces), self.capacity):
                yield from self._close(pieces[start:start + count], length)
        self.waiting = {}


class Encoder:
    """Ids of whole texts, as the tokenizer file at `path` gives them without added ids.

    Byte-level merges whose results are numbered in the order of the merges mean the same as ranked
    bytes; such files are encoded by ranks, five times as fast, and others by the file's own model.
    Strings of added tokens in a text are these tokens.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.model, self.ranks = Tokenizer.from_file(path), None
        vocabulary, cutter = read["model"].get("vocab"), read.get("pre_tokenizer") or {}
        plain = not any(t[k] for t in read["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if (plain and read["model"]["type"] == "BPE" and cutter.get("type") == "ByteLevel"
                and not cutter["add_prefix_space"] and not read["normalizer"]):
            parts = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
            merged = [vocabulary["".join(p)] for p in parts]
            if merged == sorted(merged) and len(merged) + 256 == len(set(vocabulary) - set(self.added)):
                letters = {letter: byte for byte, letter in byte_letters().items()}
                ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()
                         if token not in self.added}
                self.ranks = tiktoken.Encoding(
                    path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, np.int32)
        if any(token in text for token in self.added):
            return np.array(self.ranks.encode(text, allowed_special="all"), np.int32)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: itself where it is printable, else
    one of those from U+0100, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + n) for n, b in enumerate(hidden)}}


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


FIELDS = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
]


def pack(
    docs: DataFrame, path: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    `capacity` is a power of two. Sequence ids are unique; the bins of a task are numbered from
    its partition number times BINS_PER_TASK. Without `with_ids` the column `ids` is left out.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    fields = [f for f in FIELDS if with_ids or f[0] != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        bins = HarmonicBins(TaskContext.get().partitionId(), capacity)
        key_type = pa.int64()

        def rows(closed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*closed, strict=True)) or [[] for _ in range(1 + len(fields))]
            arrays = [pa.array(columns[0], key_type)]
            arrays += [pa.array(c, kind) for c, (_, kind) in zip(columns[1:], fields, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [id_col, *(n for n, _ in fields)])

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, done = batch.column(0).to_pylist(), 0
            for part in portions(batch.column(1).to_pylist()):
                closed: list[tuple] = []
                for key, text in zip(keys[done:done + len(part)], part, strict=True):
                    ids = np.append(encoder.ids(text), np.int32(END_ID))
                    raw = ids.astype("<u4").tobytes()
                    for start, length in cut(len(ids), capacity):
                        crc = zlib.crc32(raw[4 * start:4 * (start + length)])
                        own = (ids[start:start + length],) if with_ids else ()
                        closed += bins.add((key, start, length, crc, len(ids), *own), length)
                yield rows(closed)
                done += len(part)
        rest = list(bins.finish())
        if rest:
            yield rows(rest)

    kind = docs.schema[id_col].dataType.simpleString()
    names = {"ids": "array<int>"}
    schema = ", ".join(f"{n} {names.get(n, 'long')}" for n, _ in fields)
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, {schema}")
