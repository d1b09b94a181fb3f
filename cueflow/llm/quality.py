"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are runs of up to four bytes. Trusted texts are counted in full; the counts of each
order are hash-sharded tables, from which joins on the context give what each n-gram keeps after
its discount (three discounts per order, from how many n-grams occur once to four times), the mass
left to each context, and for the orders below the highest the number of distinct bytes that an
n-gram was seen after. The joined table has one row per n-gram of trusted text: an alphabet of A
bytes has at most A^4 of them, however large the corpus; prose has some ten thousand. It is
interpolated order by order and broadcast, and each task looks its texts up from end to end.

A text's perplexity is 2 to the bits per byte. There are two models, one of the trusted texts of each
half of the ids (by hash), and a text is scored by that of the other half: no text by a model that
has seen it, so thresholds hold for new texts. The threshold of a language is a quantile of the
perplexities of its trusted texts, and `MARGIN` times that, since a quantile of few texts is rough;
a language without trusted texts takes that of all of them. A text is kept if its perplexity is not
above the threshold.

Null texts count as empty. An empty text has no perplexity and is not kept. A null language is a
language of its own. Without trusted texts there is no threshold and every text is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.byte_runs import BEFORE, ORDER, RunTable, count_runs, sums_over_runs
from cueflow.llm.exact_dedup import mark_groups
from cueflow.session import settle

#: Share of a language's trusted texts that its threshold keeps.
QUANTILE = 0.99
#: Threshold over quantile.
MARGIN = 1.1
ACCURACY = 10_000
FOLDS = ("0", "1")
NO_LANGUAGE = "\x00none"


def _data(text: str | None) -> bytes:
    return BEFORE + (text or "").encode()


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that every label calls good and none calls toxic."""
    return (
        labels.filter(F.col(id_col).isNotNull()).groupBy(id_col)
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .filter("q = 1 and coalesce(t, 0) = 0").select(id_col)
    )


def fold_of(id_col: str) -> F.Column:
    """Which half of the ids a row belongs to; a null id counts as an empty text."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))),
                  F.lit(len(FOLDS))).cast("string")


def discounted(counts: DataFrame) -> DataFrame:
    """(fold, level, ngram, kept, left): by order, each n-gram's share after the discount.

    `counts` has (fold, run, n) of the highest order. `left` is the share of its context that goes
    on to the next shorter one.
    """
    levels = counts.select("fold", F.lit(ORDER).alias("level"), F.col("run").alias("ngram"),
                           F.col("n").alias("c"))
    every = levels
    for level in range(ORDER - 1, -1, -1):
        # in how many bytes' company an n-gram without its first byte was seen
        shorter = F.col("ngram").bitwiseAND((1 << (8 * (level + 1))) - 1)
        levels = levels.groupBy("fold", shorter.alias("ngram")).agg(
            F.count("*").alias("c")).select("fold", F.lit(level).alias("level"), "ngram", "c")
        every = every.unionByName(levels)
    every = settle(every.withColumn("context", F.shiftright("ngram", 8)), "ngrams")
    number = lambda k: F.sum(F.when(F.col("c") == k, 1).otherwise(0))
    seen = every.groupBy("fold", "level").agg(*(number(k).alias(f"t{k}") for k in (1, 2, 3, 4)))
    t = {k: F.greatest(F.col(f"t{k}"), F.lit(1)).cast("double") for k in (1, 2, 3, 4)}
    y = t[1] / (t[1] + 2 * t[2])
    # held between 0 and the count: tiny corpora have odd numbers of numbers
    bounded = lambda d, most: F.least(F.greatest(d, F.lit(0.1)), F.lit(most))
    discounts = seen.select(
        "fold", "level", bounded(1 - 2 * y * t[2] / t[1], 0.9).alias("d1"),
        bounded(2 - 3 * y * t[3] / t[2], 1.9).alias("d2"),
        bounded(3 - 4 * y * t[4] / t[3], 2.9).alias("d3"))
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    taken = every.join(discounts, ["fold", "level"]).withColumn("off", off)
    contexts = taken.groupBy("fold", "level", "context").agg(
        F.sum("c").alias("total"), F.sum("off").alias("off_total"))
    return taken.join(contexts, ["fold", "level", "context"]).select(
        "fold", "level", "ngram", ((F.col("c") - F.col("off")) / F.col("total")).alias("kept"),
        (F.col("off_total") / F.col("total")).alias("left"))


class NgramModel:
    """Bits of every byte in every context of trusted text."""

    def __init__(self, level: np.ndarray, ngram: np.ndarray, kept: np.ndarray, left: np.ndarray):
        top = level == ORDER
        table = RunTable(ngram[top].astype(np.uint32))
        size, sym = table.size, table.symbol

        def rows(k: int, n: int, place: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            """Probabilities of order k: what n-grams keep, and the mass left times the shorter."""
            of = level == k
            own, mass = np.zeros((n, size)), np.ones((n, 1))
            own[place, sym[ngram[of] & 255]] = kept[of]
            mass[place, 0] = left[of]
            return own + mass * shorter

        def part(k: int, i: int) -> np.ndarray:
            return sym[(ngram[level == k] >> (8 * i)) & 255].astype(np.int64)

        zero = rows(0, 1, np.zeros((level == 0).sum(), np.int64), np.full((1, size), 1 / 256))
        one = rows(1, size, part(1, 1), np.repeat(zero, size, 0))
        two = rows(2, len(table.keys2), np.searchsorted(table.keys2, part(2, 2) * size + part(2, 1)),
                   one[table.shorter2])
        three = rows(3, len(table.keys3), table.place3, two[table.shorter3])
        self.bits = -np.log2(np.concatenate([one, two, three])).astype(np.float32)
        self.table = table.freed()

    def perplexities(self, texts: list[str | None]) -> list[float | None]:
        data = [_data(t) for t in texts]
        bits = sums_over_runs(data, lambda d: self.table.look_up(self.bits, d)[:, None], 1)[:, 0]
        return [float(2 ** (b / n)) if (n := len(d) - len(BEFORE)) else None
                for b, d in zip(bits, data, strict=True)]


def train(
    trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> dict[str, NgramModel]:
    """A model of the trusted texts of each fold that has any.

    Only the joined table comes to the driver, bounded by the alphabet.
    """
    texts = trusted.filter(F.col(text_col) != "").withColumn("__fold", fold_of(id_col))
    counts = settle(count_runs(texts, text_col, "__fold", _data).withColumnRenamed("group", "fold"),
                    "trusted-runs")
    rows = discounted(counts).orderBy("fold", "level", "ngram").toArrow()
    fold = np.array(rows["fold"].to_pylist(), object)
    columns = [rows[c].to_numpy() for c in ("level", "ngram", "kept", "left")]
    return {f: NgramModel(*(c[fold == f] for c in columns)) for f in FOLDS if (fold == f).any()}


def with_perplexity(
    docs: DataFrame, models: dict[str, NgramModel], id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """`docs` (or its columns `keep`) with `perplexity`; a column of this name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = [c for c in keep or docs.columns if c != "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        # the model of the other fold, or the only one
        other = {f: models.get(g) or models[f] for f, g in zip(FOLDS, FOLDS[::-1], strict=True)}
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, folds = part.column(0).to_pylist(), np.array(part.column(1).to_pylist())
                values = np.empty(len(texts), object)
                for f in FOLDS:
                    at = np.flatnonzero(folds == f)
                    values[at] = other[f].perplexities([texts[k] for k in at.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array(values.tolist(), pa.float64())],
                    [*kept, "perplexity"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(F.col(text_col).alias("__text"), fold_of(id_col).alias("__fold"), *kept).mapInArrow(
        run, ", ".join([*fields, "perplexity double"]))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", quantile: float = QUANTILE,
) -> DataFrame:
    """(id, lang, perplexity, threshold, kept) of every row, trained on what `labels` trusts.

    Rows that may be trusted are found by a bitmap of fixed size before they meet the labels, so
    the texts of the others are not shuffled.
    """
    ids = settle(trusted_ids(labels, id_col), "trusted")
    rows = docs.select(id_col, text_col, lang_col)
    likely = mark_groups(rows, ids, id_col).filter("survives")
    models = train(likely.join(ids, id_col, "left_semi"), id_col, text_col)
    if not models:
        return docs.select(id_col, lang_col, F.lit(None).cast("double").alias("perplexity"),
                           F.lit(None).cast("double").alias("threshold"),
                           (F.coalesce(text_col, F.lit("")) != "").alias("kept"))
    scored = settle(with_perplexity(rows, models, id_col, text_col, [id_col, lang_col]), "perplexities")
    language = F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE))
    cut = F.percentile_approx("perplexity", quantile, ACCURACY)
    good = scored.join(ids, id_col, "left_semi").filter("perplexity is not null")
    overall = good.agg(cut.alias("cut")).first().cut
    by_lang = settle(good.groupBy(language.alias("__lang")).agg(cut.alias("cut")), "thresholds")
    threshold = F.coalesce("cut", F.lit(overall)) * MARGIN
    return (
        scored.withColumn("__lang", language).join(by_lang, "__lang", "left")
        .select(id_col, lang_col, "perplexity", threshold.alias("threshold"),
                F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
    )
