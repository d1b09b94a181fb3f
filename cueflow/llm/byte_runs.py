"""Runs of four bytes: counted over a corpus, and summed up over texts by a table of their values.

A model of bytes in contexts of up to three has a value for every run of context and byte. Texts are
walked in windows that overlap by a context, so memory is bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of context; a run is one byte more and fits an integer of 32 bits.
ORDER = 3
BYTES_AT_ONCE = 1 << 20
#: Stands for what is before the beginning of a text.
BEFORE = b"\n" * ORDER


def windows(data: bytes) -> Iterator[np.ndarray]:
    """Windows of the bytes that overlap by ORDER, so that each run is in one of them."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, max(len(whole) - ORDER, 0), BYTES_AT_ONCE):
        yield whole[start:start + BYTES_AT_ONCE + ORDER]


def runs_of(window: np.ndarray) -> np.ndarray:
    out = np.zeros(len(window) - ORDER, np.uint32)
    for i in range(ORDER + 1):
        out = (out << np.uint32(8)) | window[i:len(window) - ORDER + i]
    return out


def count_runs(
    docs: DataFrame, text: str, group: str, data_of: Callable[[str | None], bytes]
) -> DataFrame:
    """(group, run, n): how often each run occurs in a group's texts, combined per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def fold(key: str) -> None:
            """What is held of a group goes into its counts: one entry per distinct run."""
            runs, n = np.unique(np.concatenate(held.pop(key)), return_counts=True)
            if key in counted:
                runs, place = np.unique(np.append(counted[key][0], runs), return_inverse=True)
                n = np.bincount(place, np.append(counted[key][1], n)).astype(np.int64)
            counted[key] = runs, n
            sizes[key] = 0

        for batch in batches:
            for value, own in zip(batch.column(0), batch.column(1), strict=True):
                key = own.as_py()
                for window in windows(data_of(value.as_py())):
                    held.setdefault(key, []).append(runs_of(window))
                    sizes[key] = sizes.get(key, 0) + len(window)
                    if sizes[key] > BYTES_AT_ONCE:
                        fold(key)
        for key in list(held):
            fold(key)
        for key, (runs, n) in counted.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(runs), pa.string()), pa.array(runs.astype(np.int64)),
                 pa.array(n.astype(np.int64))], ["group", "run", "n"])

    counts = docs.select(text, group).mapInArrow(run, "group string, run long, n long")
    return counts.groupBy("group", "run").agg(F.sum("n").alias("n"))


def sums_over_runs(
    texts: list[bytes], values_of: Callable[[np.ndarray], np.ndarray], width: int
) -> np.ndarray:
    """For each text the sum of `values_of` (one row of `width` per run) over its runs."""
    out = np.zeros((len(texts), width))
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if not held:
            return
        values = values_of(np.concatenate(held))
        starts = np.cumsum([0] + [len(h) for h in held])
        for i, owner in enumerate(owners):
            # the runs that lie within this window
            out[owner] += values[starts[i]:starts[i + 1] - ORDER].sum(0, dtype=np.float64)
        held.clear()
        owners.clear()

    total = 0
    for i, data in enumerate(texts):
        for window in windows(data):
            held.append(window)
            owners.append(i)
            total += len(window)
            if total >= BYTES_AT_ONCE:
                flush()
                total = 0
    flush()
    return out


class RunTable:
    """Where the values of a run stand: by its context, as far as that occurred, and its last byte.

    `symbol` maps a byte to its place in the alphabet (the last place: bytes that never occurred).
    Contexts have places: first those of one byte, then of two, then of three; `second` and `third`
    map two and three symbols to the place of the longest end that occurred.
    """

    def __init__(self, runs: np.ndarray):
        parts = [((runs >> np.uint32(8 * (ORDER - i))) & np.uint32(255)).astype(np.int64)
                 for i in range(ORDER + 1)]
        alphabet = np.unique(np.concatenate(parts))
        size = len(alphabet) + 1
        self.size = size
        self.symbol = np.full(256, size - 1, np.int32)
        self.symbol[alphabet] = np.arange(size - 1)
        self.parts = [self.symbol[p].astype(np.int64) for p in parts]
        a, b, c, _ = self.parts
        self.keys2, self.place2 = np.unique(b * size + c, return_inverse=True)
        self.keys3, self.place3 = np.unique((a * size + b) * size + c, return_inverse=True)
        self.ends = np.cumsum([0, size, len(self.keys2), len(self.keys3)])
        at2 = np.full(size * size, -1, np.int64)
        at2[self.keys2] = np.arange(len(self.keys2))
        #: For each two- and three-byte context the row of the context that is one byte shorter.
        self.shorter2 = self.keys2 % size
        self.shorter3 = at2[self.keys3 % (size * size)]
        self.second = np.where(at2 < 0, np.arange(size * size) % size, at2 + size).astype(np.int32)
        self.third = np.repeat(np.arange(self.ends[2], dtype=np.int32)[:, None], size, 1)
        self.third[self.shorter3 + size, self.keys3 // (size * size)] = np.arange(
            self.ends[2], self.ends[3])

    def look_up(self, values: np.ndarray, data: np.ndarray) -> np.ndarray:
        """`values` (by place and last symbol) of every run of `data`."""
        sym = self.symbol[data]
        place = self.third[self.second[sym[1:-2] * self.size + sym[2:-1]], sym[:-3]]
        return values[place, sym[3:]]

    def freed(self) -> RunTable:
        """Without what only building needs."""
        del self.parts, self.place2, self.place3, self.keys2, self.keys3, self.shorter2
        del self.shorter3
        return self
