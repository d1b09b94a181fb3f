"""Byte-level BPE by recursive queries: rows of (piece, position, token) contracted to a fixpoint.

Each worker cuts its texts into pieces and hands the distinct ones that it has not met yet to an
in-memory DuckDB. There every byte is a row; one step of the recursion joins each row and its
successor to the merge table, takes every piece's pair of lowest rank, the leftmost of several, and
contracts it. A piece that is a token as a whole is taken as it is, as the ranks' own library does.
Decoding is an ordered aggregation over the ids of each piece.

Rows of one piece times its steps grow with the square of its length, so pieces of more than
`LONG_BYTES` bytes (runs of letters without any blank) go through a heap instead, with the same
result in n log n. Texts are independent: no shuffle, and no state but the store of pieces.

Null text counts as empty and has no ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.pieces import Encoded, PieceStore, portions

LONG_BYTES = 256
#: Bytes of pieces contracted by one query, which bounds the rows that it keeps.
BYTES_AT_ONCE = 250_000

#: A row knows its successor. `best` packs rank, position and the successor's position of a piece's
#: next pair, so its minimum is the lowest rank and of several the leftmost; the successor's row
#: goes, and what it knew of its own successor passes on.
CONTRACT = """
WITH RECURSIVE state AS (
  SELECT piece, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos, 0 AS step
  FROM bytes_now WINDOW w AS (PARTITION BY piece ORDER BY pos)
  UNION ALL
  (WITH pairs AS (
     SELECT piece, min((merged::BIGINT << 40) | (pos::BIGINT << 20) | next_pos) AS best
     FROM state JOIN merges ON id = left_id AND next_id = right_id GROUP BY piece
   ), contracted AS (
     SELECT pairs.piece, (best >> 40)::INTEGER AS merged, (best >> 20) & 1048575 AS spot,
       best & 1048575 AS eaten, next_id AS after_id, next_pos AS after_pos
     FROM pairs JOIN state ON pairs.piece = state.piece AND pos = (best & 1048575)
   )
   SELECT state.piece, pos, CASE WHEN pos = spot THEN merged ELSE id END,
     CASE WHEN pos = spot THEN after_id WHEN next_pos = spot THEN merged ELSE next_id END,
     CASE WHEN pos = spot THEN after_pos ELSE next_pos END, step + 1
   FROM state JOIN contracted ON state.piece = contracted.piece WHERE pos <> eaten)
), fixpoint AS (
  SELECT piece, max(step) AS step FROM state GROUP BY piece
)
SELECT piece, list(id ORDER BY pos) AS ids
FROM state JOIN fixpoint USING (piece, step) GROUP BY piece ORDER BY piece
"""

DECODE = """
SELECT piece, unhex(string_agg(hex_bytes, '' ORDER BY pos)) AS decoded
FROM ids_now JOIN tokens USING (id) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RecursiveBpe:
    """Merge table and tokens of one rank file in a DuckDB of this process."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.merges = {
            (self.ranks[token[:i]], self.ranks[token[i:]]): rank
            for token, rank in self.ranks.items() for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        }
        self.con = duckdb.connect(config={
            "threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = np.array(list(self.merges), np.int32).reshape(-1, 2)
        merged = np.fromiter(self.merges.values(), np.int32, len(self.merges))
        self._load("pairs_in", left_id=pairs[:, 0], right_id=pairs[:, 1], merged=merged)
        self.con.execute("CREATE TABLE merges AS FROM pairs_in")
        self._load("tokens_in", id=pa.array(self.ranks.values(), pa.int32()),
                   hex_bytes=[t.hex() for t in self.ranks])
        self.con.execute("CREATE TABLE tokens AS FROM tokens_in")

    def _load(self, name: str, **columns) -> None:
        self.con.register(name, pa.table(columns))

    def encode(self, pieces: list[str]) -> Encoded:
        raw = [piece.encode() for piece in pieces]
        found: list[np.ndarray | None] = [None] * len(raw)
        group: list[int] = []
        held = 0
        for i, piece in enumerate(raw):
            if piece in self.ranks:
                found[i] = np.array([self.ranks[piece]], np.int32)
            elif len(piece) > LONG_BYTES:
                found[i] = self.contract_long(piece)
            else:
                group.append(i)
                held += len(piece)
                if held >= BYTES_AT_ONCE:
                    self._contract(raw, group, found)
                    group, held = [], 0
        self._contract(raw, group, found)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate(found) if found else np.empty(0, np.int32)), lengths

    def _contract(self, raw: list[bytes], group: list[int], found: list) -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(raw[i] for i in group), np.uint8)
        lengths = np.fromiter((len(raw[i]) for i in group), np.int64, len(group))
        piece = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._load("bytes_now", piece=piece, pos=(np.arange(len(data)) - first).astype(np.int32),
                   id=self.byte_ids[data])
        ids = self.con.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
        ends = ids.offsets.to_numpy()
        values = ids.values.to_numpy()
        for i, (a, b) in zip(group, pairwise(ends), strict=True):
            found[i] = values[a:b]

    def contract_long(self, piece: bytes) -> np.ndarray:
        """The same contraction over a linked list, next pair by a heap of (rank, position)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.merges.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue  # one of the two was merged away since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    r = rank_of((ids[k], ids[after[k]]))
                    if r is not None:
                        heapq.heappush(heap, (r, k))
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; a run without ids decodes to nothing."""
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._load("ids_now", piece=np.repeat(np.arange(len(lengths)), lengths),
                   pos=np.arange(len(ids)) - first, id=ids)
        out = [b""] * len(lengths)
        table = self.con.sql(DECODE).to_arrow_table()
        for i, data in zip(table["piece"].to_pylist(), table["decoded"].to_pylist(), strict=True):
            out[i] = data
        return out


@lru_cache(maxsize=2)
def store_of(path: str, pattern: str) -> tuple[RecursiveBpe, PieceStore]:
    bpe = RecursiveBpe(path)
    return bpe, PieceStore(pattern, bpe.encode, bpe.decode)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids, decoded): token ids of each text and the bytes that they decode to.

    With `digest`, ids (as little-endian unsigned 32-bit integers) and decoded bytes are replaced
    by their SHA-256 in hex, so that wide rows need not leave the worker.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, store = store_of(path, pattern)
        for batch in batches:
            keys, done = batch.column(0), 0
            for part in portions(batch.column(1).to_pylist()):
                count, ids_out, decoded_out = [], [], []
                for ids, at in store.ids_of(part):
                    decoded = b"".join(map(store.bytes.__getitem__, at.tolist()))
                    count.append(len(ids))
                    if digest:
                        ids_out.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                        decoded_out.append(hashlib.sha256(decoded).hexdigest())
                    else:
                        ids_out.append(ids)
                        decoded_out.append(decoded)
                kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(done, len(part)), pa.array(count, pa.int64()),
                     pa.array(ids_out, kinds[0]), pa.array(decoded_out, kinds[1])],
                    [id_col, "n_tokens", "ids", "decoded"])
                done += len(part)
        store.trim()

    kinds = "ids string, decoded string" if digest else "ids array<int>, decoded binary"
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, {kinds}")


def decode(
    rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """(id, decoded): the bytes of each array of ids, by ordered aggregation; null gives nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = store_of(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                runs = [np.array(ids or [], np.int32) for ids in part.column(1).to_pylist()]
                lengths = np.fromiter(map(len, runs), np.int64, len(runs))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0),
                     pa.array(bpe.decode(np.concatenate(runs), lengths), pa.binary())],
                    [id_col, "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
