"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of length 0 to `ORDER` holds how often each byte followed.
A byte is coded in the longest context that its language has seen, with probability n / (t + u)
(t bytes seen there, u distinct ones); if it never followed there, an escape of u / (t + u) is paid
and the next shorter context is tried, and below the empty context all 256 values are equal. The
statistics are frozen after training, so the code length of a byte depends on its last bytes only:
it is worked out once for every context and byte, and a text's exact code length is a sum of
looked-up values. The language with the shortest code wins.

Training counts byte runs over every labelled document: tasks count their own, Spark adds the
counts up by (language, run). The model has at most A^(ORDER+1) entries per language for an
alphabet of A byte values, whatever the corpus, and of each language only the runs that occurred.

Texts are lower-cased and take part from the first byte to the last, in pieces with the previous
bytes as context, so memory is bounded however long a text is. Null texts and texts without a
letter get `und` and score 0. `score` is the probability of the winner among all languages when
all are equally likely. A model without any labelled text predicts `und` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cueflow.llm.byte_runs import BEFORE, ORDER, RunTable, count_runs, sums_over_runs

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def _bytes_of(text: str | None) -> bytes:
    """The text as the trees see it."""
    return BEFORE + (text or "").lower().encode()


@dataclass
class FrozenTrees:
    """Code lengths in bits by context and byte, for all languages side by side."""

    languages: list[str]
    table: RunTable | None
    bits: np.ndarray


def freeze(langs: list[str], runs: np.ndarray, n: np.ndarray) -> FrozenTrees:
    """Trees of all languages from parallel columns of `count_runs`."""
    languages = sorted(set(langs))
    if not languages:
        return FrozenTrees([], None, np.empty(0, np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    lang_of = np.array([number[lang] for lang in langs], np.int64)
    n = n.astype(np.float64)
    table = RunTable(runs.astype(np.uint32))
    size, ends = table.size, table.ends
    bits = np.empty((ends[-1], size, len(languages)), np.float32)

    def coded(of: np.ndarray, contexts: int, place: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Bits of each byte in these contexts, given the bits in the next shorter ones."""
        counted = np.bincount(place[of] * size + table.parts[ORDER][of], n[of],
                              contexts * size).reshape(contexts, size)
        total, kinds = counted.sum(1, keepdims=True), (counted > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log2(total + kinds) - np.log2(counted)
            escaped = np.log2(total + kinds) - np.log2(kinds) + shorter
        return np.where(total == 0, shorter, np.where(counted > 0, seen, escaped))

    for i in range(len(languages)):
        of = np.flatnonzero(lang_of == i)
        empty = coded(of, 1, np.zeros(len(runs), np.int64), np.full((1, size), 8.0))
        first = coded(of, size, table.parts[2], np.repeat(empty, size, 0))
        two = coded(of, len(table.keys2), table.place2, first[table.shorter2])
        three = coded(of, len(table.keys3), table.place3, two[table.shorter3])
        for part, a, b in zip((first, two, three), ends[:-1], ends[1:], strict=True):
            bits[a:b, :, i] = part
    return FrozenTrees(languages, table.freed(), bits)


def code_lengths(model: FrozenTrees, texts: list[str | None]) -> np.ndarray:
    """Bits of each text in each language."""
    return sums_over_runs(
        [_bytes_of(t) for t in texts], lambda data: model.table.look_up(model.bits, data),
        len(model.languages))


def predict(model: FrozenTrees, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    return judge(model, texts)[:2]


def judge(
    model: FrozenTrees, texts: list[str | None]
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and its bits per byte in that language."""
    known = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits = code_lengths(model, [t if k else None for t, k in zip(texts, known, strict=True)])
    best = bits.argmin(1)
    odds = np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    sizes = np.array([max(len(_bytes_of(t)) - len(BEFORE), 1) for t in texts])
    return names, np.where(known, 1 / odds, 0.0), np.where(known, bits.min(1) / sizes, 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> FrozenTrees:
    """Trees over all rows of `docs` with a text and a language.

    Only the runs that occurred come to the driver: a few ten thousand per language of letters
    and marks, and no more for a larger corpus of the same alphabets.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    frame = count_runs(known, text_col, lang_col, _bytes_of).orderBy("group", "run").toArrow()
    return freeze(frame["group"].to_pylist(), frame["run"].to_numpy(), frame["n"].to_numpy())


def identify(
    docs: DataFrame, model: FrozenTrees, text_col: str = "text", keep: list[str] | None = None,
    bits_col: str | None = None,
) -> DataFrame:
    """`docs` (or its columns `keep`) with lang_pred and score; these names are replaced.

    `bits_col` names a further column: bits per byte in the predicted language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = ["lang_pred", "score", *([bits_col] if bits_col else [])]
    kept = [c for c in keep or docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, *numbers = judge(shared.value, part.column(0).to_pylist())
                out = [pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *out[:len(made)]], [*kept, *made])

    schema = StructType([
        *(docs.schema[c] for c in kept), StructField(made[0], StringType()),
        *(StructField(c, DoubleType()) for c in made[1:])])
    return docs.select(F.col(text_col).alias("__text"), *kept).mapInArrow(run, schema)
