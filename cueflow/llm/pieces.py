"""Token ids of whole texts through the distinct pieces that a pattern cuts them into.

A piece's ids do not depend on its neighbours, so each worker looks every distinct piece up once and
keeps it. When the store holds too many pieces, and when a task ends, only those learnt first stay,
which are mostly the frequent ones; that costs time, never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import regex

#: Ids and lengths of some pieces: all ids in one array, and how many each piece has.
Encoded = tuple[np.ndarray, np.ndarray]
PIECES_KEPT = 1_000_000
KEPT_BETWEEN_TASKS = 100_000
CHARS_AT_ONCE = 2_000_000


def portions(texts: Iterable[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Whole texts in lists of about `chars` characters; null counts as empty."""
    part: list[str] = []
    held = 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


class PieceStore:
    """Ids (and decoded bytes, where `decode` is given) of pieces seen by this worker."""

    def __init__(
        self, pattern: str, encode: Callable[[list[str]], Encoded],
        decode: Callable[[np.ndarray, np.ndarray], list[bytes]] | None = None,
        kept: int = PIECES_KEPT,
    ):
        self.pattern = regex.compile(pattern)
        self.encode, self.decode, self.kept = encode, decode, kept
        self.place: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def trim(self, kept: int = KEPT_BETWEEN_TASKS) -> None:
        """Forgets all but the pieces learnt first."""
        if len(self.place) <= kept:
            return
        self.place = dict(islice(self.place.items(), kept))
        self.flat = self.flat[:self.starts[kept]].copy()
        self.starts, self.lengths = self.starts[:kept].copy(), self.lengths[:kept].copy()
        del self.bytes[kept:]

    def learn(self, pieces: list[str]) -> None:
        ids, lengths = self.encode(pieces)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.place.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)),
                              strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        if self.decode:
            self.bytes += self.decode(ids, lengths)

    def ids_of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the places of its pieces in this store."""
        if len(self.place) > self.kept:
            self.trim()
        cut = [self.pattern.findall(text) for text in texts]
        pieces = list(chain.from_iterable(cut))
        place = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            # in order of appearance, so that the same input gives the same store
            self.learn(list(dict.fromkeys(pieces[i] for i in missing.tolist())))
            place[missing] = [self.place[pieces[i]] for i in missing.tolist()]
        end = 0
        for own in cut:
            start, end = end, end + len(own)
            at = place[start:end]
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            gather = np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)
            yield self.flat[gather], at
