"""A corpus from documents to packed sequences, in five stages.

Each stage works on all that the one before it kept and is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import language_id
from cueflow.llm.exact_dedup import drop_exact_copies
from cueflow.llm.packing import pack
from cueflow.llm.simhash import drop_near_copies
from cueflow.llm.suffix_dedup import drop_repeated_passages
from cueflow.session import scratch_path, settle

#: Least probability of the predicted language.
LEAST_SCORE = 0.5
#: A text may cost so many times the median bits per byte of its language, and so many bits more.
ROOM, FREE_BITS = 1.5, 64


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, predicted with some confidence, and fits well.

    `lang` stays as it came. A model of all labelled rows predicts. What goes are null texts, texts
    without a letter, texts on which languages tie, and those that cost far more bits than texts of
    the predicted language do, measured over all documents. Nulls in other columns and repeated rows
    stay; an empty table gives an empty table.
    """
    model = language_id.train(docs)
    # rows as one column, so that no name of theirs can clash; judged twice, so that no text is
    # written for the sake of the medians
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    known = language_id.identify(rows, model, keep=["row"], bits_col="bits").filter(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    usual = known.groupBy("lang_pred").agg(F.percentile_approx("bits", 0.5, 10000).alias("usual"))
    size = F.greatest(F.octet_length("row.text"), F.lit(1))
    return known.join(settle(usual, "usual-bits"), "lang_pred").filter(
        F.col("bits") <= ROOM * F.col("usual") + FREE_BITS / size).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have sets of five-word shingles with a Jaccard similarity of 0.8 or more; texts
    without words are near copies of their equals only. Of rows without an id one stays, and only in
    a group without any id.
    """
    return drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the smallest document that has them.

    `n_chars` follows the text; a document of which nothing is left goes, and so do null and blank
    texts. Rows without an id come after all others; an empty table gives an empty table.
    """
    left = drop_repeated_passages(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).filter(
        F.trim("text") != "").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    Null texts count as empty and have one piece, the end id; rows repeated or without an id are
    packed like others; an empty table gives no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                with_ids=False)


STAGES = [
    ("language", by_language), ("exact", exact), ("near", near), ("passages", passages),
    ("packing", packed),
]

#: No SQL can express the language model, the fingerprints or the suffix array.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
