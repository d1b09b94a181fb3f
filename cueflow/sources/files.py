"""Corpus files, format dispatch, admission and the text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.text import strip
from cueflow.operators.rules import document_issue, issue_message
from cueflow.sources.codec import clean_content


def scan_corpus(
    spark: SparkSession, path: str, normalize_newlines: bool = True, strip_bom: bool = True
) -> DataFrame:
    """One row per file below `path`: (doc_id = file path, content)."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("doc_id"),
        clean_content(F.col("value"), normalize_newlines, strip_bom).alias("content"),
    )


def pack_corpus(docs: DataFrame, path: str) -> None:
    """Documents (name, part_no, content) as a table below `path`, with an index.

    `documents` has one row per document, (name, content), in files that hold a range of names each;
    `index` tells the file and the row of each name: (name, part, row).
    """
    parts = F.array_sort(F.collect_list(F.struct("part_no", "content")))
    whole = docs.groupBy("name").agg(
        F.array_join(F.transform(parts, lambda p: p["content"]), "").alias("content"))
    whole.repartitionByRange("name").sortWithinPartitions("name").write.parquet(f"{path}/documents")
    stored = docs.sparkSession.read.schema("name string, content string").parquet(f"{path}/documents")
    stored.select(
        "name", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row")
    ).write.parquet(f"{path}/index")


def scan_packed(
    spark: SparkSession, path: str, normalize_newlines: bool = True, strip_bom: bool = True
) -> DataFrame:
    """Documents of a packed corpus: (doc_id = name, content)."""
    stored = spark.read.schema("name string, content string").parquet(f"{path}/documents")
    return stored.select(
        F.col("name").alias("doc_id"),
        clean_content(F.col("content"), normalize_newlines, strip_bom).alias("content"))


def read_packed(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """The documents of a packed corpus with the given `names`; only their files are read."""
    wanted = spark.read.parquet(f"{path}/index").join(names.select("name").distinct(), "name")
    files = [r.part for r in wanted.select("part").distinct().collect()]
    if not files:
        return scan_packed(spark, path).limit(0)
    stored = spark.read.schema("name string, content string").parquet(
        *(f"{path}/documents/{part}" for part in files))
    return stored.join(wanted.select("name"), "name", "left_semi").select(
        F.col("name").alias("doc_id"), clean_content(F.col("content")).alias("content"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """One folder per document name below `path`, holding its text: (name, part_no, content).

    For whoever needs files; `pack_corpus` keeps large corpora in a table.

    Parts of a long document are written in order into one file; a task holds one row at a time.
    """
    (
        docs.repartition("name")
        .sortWithinPartitions("name", "part_no")
        .select("name", F.regexp_replace("content", r"\n\z", "").alias("content"))
        .write.partitionBy("name")
        .text(path)
    )


def _unescaped(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def document_name(doc_id: Column) -> Column:
    """Name of a document written by `write_corpus`, from its file path; empty for other paths.

    The folder name is escaped, and so is the path that holds it.
    """
    return _unescaped(_unescaped(F.regexp_extract(doc_id, "/name=([^/]+)/", 1)))


def source_name(doc_id: Column) -> Column:
    """The name that tells a file's format: what `write_corpus` was given, or else the path."""
    name = document_name(doc_id)
    return F.when(name != "", name).otherwise(doc_id)


def format_of(name: Column, policy: str = "router") -> Column:
    """Subtitle format by file name.

    `router`: exactly `.srt` is SRT, all else WebVTT. `cli`: `.vtt` in any case is WebVTT, all
    else SRT. `strict`: only `.srt` and `.vtt`, else null.
    """
    if policy == "router":
        return F.when(name.endswith(".srt"), F.lit("srt")).otherwise(F.lit("webvtt"))
    if policy == "cli":
        return F.when(F.lower(name).endswith(".vtt"), F.lit("webvtt")).otherwise(F.lit("srt"))
    if policy == "strict":
        return F.when(name.endswith(".srt"), F.lit("srt")).when(
            name.endswith(".vtt"), F.lit("webvtt")
        )
    raise ValueError(f"unknown format policy: {policy}")


def parse_failures(docs: DataFrame) -> DataFrame:
    """The issue row of documents (doc_id, name, format) whose format is not known."""
    failed = docs.where(~F.coalesce(F.col("format").isin(*K.FORMATS), F.lit(False)))
    return document_issue(failed, "parse_error", issue_message("parse_error", name=F.col("name")))


def decode_base64(docs: DataFrame) -> DataFrame:
    """Content of rows flagged `is_base64` decoded to text; undecodable content becomes null."""
    decoded = F.expr("try_to_binary(content, 'base64')").cast("string")
    return docs.withColumn(
        "content", F.when(F.col("is_base64"), decoded).otherwise(F.col("content"))
    )


def admit(docs: DataFrame, max_chars: int = K.MAX_CONTENT_CHARS) -> DataFrame:
    """Stripped content with `reason`: null for admitted rows, else why the row is rejected."""
    content = strip(F.col("content"))
    size = F.length(content)
    return docs.withColumn("content", content).withColumn(
        "reason",
        F.when(F.col("content").isNull(), F.lit("content_unreadable"))
        .when(size < 1, F.lit("content_empty"))
        .when(size > max_chars, F.lit("content_too_long"))
        .when(~F.coalesce(F.col("format").isin(*K.FORMATS), F.lit(False)), F.lit("format"))
        .when(~F.coalesce(F.col("language").isin(*K.LANGUAGES), F.lit(False)), F.lit("language")),
    )


def accepted(admitted: DataFrame) -> DataFrame:
    return admitted.where(F.col("reason").isNull()).drop("reason")


def rejected(admitted: DataFrame) -> DataFrame:
    return admitted.where(F.col("reason").isNotNull())


def oversized_documents(segments: DataFrame, max_segments: int = K.MAX_SEGMENTS) -> DataFrame:
    """Documents with more segments than allowed."""
    sizes = segments.groupBy("doc_id").agg(F.count("*").alias("segments"))
    return sizes.where(F.col("segments") > max_segments)
