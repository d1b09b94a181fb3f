"""Comparing an original corpus with its corrected version."""

from __future__ import annotations

import difflib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cueflow import constants as K
from cueflow.constants import WHITESPACE_CLASS
from cueflow.functions.skew import join_spread
from cueflow.functions.text import strip, words
from cueflow.session import settle

# Ships the helper functions below with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPANS = "array<struct<tag:string,left:string,right:string>>"
_SPAN_TYPE = pa.list_(pa.struct([(name, pa.string()) for name in ("tag", "left", "right")]))
#: Segments whose words a task holds at a time.
SPAN_ROWS = 64


def changed_segments(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Segments whose text differs from the last original of the same number ("" if there is none)."""
    before = original.groupBy("doc_id", "idx").agg(F.max_by("text", "pos").alias("original"))
    joined = corrected.join(before, ["doc_id", "idx"], "left").withColumn(
        "original", F.coalesce("original", F.lit(""))
    )
    return joined.where(F.col("original") != F.col("text")).select(
        "doc_id", "pos", "idx", "original", F.col("text").alias("corrected")
    )


def first_changes(changes: DataFrame, limit: int = K.TOP_CHANGES) -> DataFrame:
    """The first `limit` changes of each document; the rank limit also prunes before the shuffle."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return changes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _pair_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    sizes = left.groupBy("doc_id").agg(F.count("*").alias("left_segments"))
    return sizes.join(
        right.groupBy("doc_id").agg(F.count("*").alias("right_segments")), "doc_id", "full_outer"
    ).fillna(0)


def misaligned_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents whose two versions differ in their number of segments."""
    return _pair_sizes(left, right).where("left_segments <> right_segments")


def aligned_segments(left: DataFrame, right: DataFrame) -> DataFrame:
    """Texts of both versions by position, without the misaligned documents."""
    pairs = left.select("doc_id", "pos", F.col("text").alias("left_text")).join(
        right.select("doc_id", "pos", F.col("text").alias("right_text")), ["doc_id", "pos"]
    )
    misaligned = misaligned_documents(left, right).select("doc_id")
    return join_spread(pairs, misaligned, ["doc_id"], "left_anti", by=["pos"])


def word_spans(left: list[str], right: list[str], tags: set[str]) -> list[tuple[str, str, str]]:
    """(tag, left words, right words) of the wanted edit operations between two word lists."""
    matcher = difflib.SequenceMatcher(None, left, right)
    return [
        (tag, " ".join(left[a:b]), " ".join(right[c:d]))
        for tag, a, b, c, d in matcher.get_opcodes()
        if tag in tags
    ]


def _with_spans(pairs: DataFrame, tags: set[str]) -> DataFrame:
    """(doc_id, pos, spans) of changed segments; a task holds the words of `SPAN_ROWS` at a time."""
    schema = f"doc_id string, pos long, spans {_SPANS}"
    changed = pairs.where(F.col("left_text") != F.col("right_text")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "left_text", "right_text")
    split = re.compile(WHITESPACE_CLASS + "+")

    def listed(text: str) -> list[str]:
        return [word for word in split.split(text) if word]

    def spans(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SPAN_ROWS):
                part = batch.slice(at, SPAN_ROWS)
                found = [
                    [{"tag": t, "left": x, "right": y} for t, x, y in word_spans(
                        listed(a.as_py()), listed(b.as_py()), tags)]
                    for a, b in zip(part["left_text"], part["right_text"])]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["pos"], pa.array(found, _SPAN_TYPE)], ["doc_id", "pos", "spans"])

    return changed.mapInArrow(spans, schema)


def learned_pairs(pairs: DataFrame, max_words: int = K.LEARN_MAX_WORDS) -> DataFrame:
    """(doc_id, pos, span_no, wrong, right): replaced runs of fewer than `max_words` words."""
    exploded = _with_spans(pairs, {"replace"}).select(
        "doc_id", "pos", F.posexplode("spans").alias("span_no", "span")
    )
    return exploded.select(
        "doc_id", "pos", "span_no", F.col("span.left").alias("wrong"),
        F.col("span.right").alias("right"),
    ).where(F.size(words(F.col("wrong"))) < max_words)


def learning_batch(learned: DataFrame, topic: str, industry: str, country: str) -> DataFrame:
    """Learned pairs as KB occurrences of one run's context."""
    return learned.select(
        F.col("wrong").alias("wrong_term"), F.col("right").alias("correct_term"),
        F.lit(topic).alias("topic"), F.lit(industry).alias("industry"),
        F.lit(country).alias("country"), F.array().cast("array<string>").alias("tags"),
        F.xxhash64("doc_id").alias("doc_hash"), "pos", "span_no",
    ).withColumn("seq", F.struct("doc_hash", "pos", "span_no")).drop("doc_hash", "pos", "span_no")


def diff_spans(pairs: DataFrame) -> DataFrame:
    """Word spans of changed segments: kind equal / removed / added, in reading order."""
    exploded = _with_spans(pairs, {"equal", "replace", "delete", "insert"}).select(
        "doc_id", "pos", F.posexplode("spans").alias("span_no", "span")
    )
    removed = F.struct(F.lit("removed").alias("kind"), F.col("span.left").alias("value"))
    added = F.struct(F.lit("added").alias("kind"), F.col("span.right").alias("value"))
    kinds = (
        F.when(
            F.col("span.tag") == "equal",
            F.array(F.struct(F.lit("equal").alias("kind"), F.col("span.left").alias("value"))),
        )
        .when(F.col("span.tag") == "replace", F.array(removed, added))
        .when(F.col("span.tag") == "delete", F.array(removed))
        .otherwise(F.array(added))
    )
    return exploded.select("doc_id", "pos", "span_no", F.inline(kinds))


def attributed_spans(spans: DataFrame, applied: DataFrame) -> DataFrame:
    """Added spans with the first applied correction whose text holds them (over two characters).

    `applied` has (doc_id, apply_order, corrected_text, type, reason). A text that holds a span
    holds the span's first eight (or three) characters, so both meet by document and that gram;
    equal spans and equal corrections of a document are looked up once.
    """
    trimmed = strip(F.col("value"))
    added = spans.where((F.col("kind") == "added") & (F.length(trimmed) > 2)).select(
        "doc_id", "pos", "span_no", trimmed.alias("value")
    )
    asked = added.select("doc_id", "value").distinct().withColumn(
        "gram", F.substring("value", 1, 8)
    ).withColumn("gram", F.when(F.length("gram") < 8, F.substring("gram", 1, 3))
                 .otherwise(F.col("gram")))
    texts = applied.groupBy("doc_id", "corrected_text").agg(
        F.min_by(F.struct("apply_order", "type", "reason"), "apply_order").alias("hit")
    ).withColumn("apply_order", F.col("hit.apply_order"))
    # A substring by position would read the text from its start each time.
    grams = F.concat(*[
        F.regexp_extract_all("corrected_text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
        for size in (8, 3)
    ])
    # Few of the grams are looked for anywhere: the others go before the shuffle.
    wanted = settle(asked.select("gram").distinct(), "asked-grams")
    offered = texts.select("doc_id", "apply_order", F.explode(grams).alias("gram")).join(
        wanted, "gram", "left_semi").distinct()
    # Grams multiply the rows, which size estimates do not see: never broadcast them.
    met = asked.join(offered.hint("merge"), ["doc_id", "gram"])
    found = (
        met.join(texts, ["doc_id", "apply_order"])
        .where(F.contains(F.col("corrected_text"), F.col("value")))
        .groupBy("doc_id", "value")
        .agg(F.min_by("hit", "hit.apply_order").alias("hit"))
    )
    return added.join(found, ["doc_id", "value"], "left").select(
        "doc_id", "pos", "span_no", "value", F.col("hit.apply_order").alias("apply_order"),
        F.col("hit.type").alias("type"), F.col("hit.reason").alias("reason"),
    )


def preserved_terms(original: DataFrame, corrected: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected terms kept per document, whether a known typo was fixed, whether dialects agree.

    `original` / `corrected`: (doc_id, content); `expected`: (doc_id, terms, dialect, found_dialect).
    The typo test is case-sensitive, the term and dialect tests are not.
    """
    texts = original.select("doc_id", F.col("content").alias("before")).join(
        corrected.select("doc_id", F.col("content").alias("after")), "doc_id"
    ).join(expected, "doc_id")
    low = F.lower("after")
    kept = F.filter("terms", lambda t: F.contains(low, F.lower(t)))
    wanted, found = F.lower("dialect"), F.lower("found_dialect")
    return texts.select(
        "doc_id", F.size(kept).alias("preserved"), F.size("terms").alias("expected"),
        (F.contains(F.col("before"), F.lit("definately"))
         & F.contains(F.col("after"), F.lit("definitely"))).alias("typo_fixed"),
        (F.contains(found, wanted) | F.contains(wanted, found)).alias("dialect_match"),
    )
