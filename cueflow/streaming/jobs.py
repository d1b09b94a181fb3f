"""Streams: arriving files, approved corrections, and the log of applied corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueflow.operators import knowledge
from cueflow.operators.rules import segment_issues
from cueflow.session import settle
from cueflow.sources import codec, files

LOG_SCHEMA = (
    "tenant_id string, correction_id long, was_successful boolean, applied_at timestamp_ntz"
)


def arriving_documents(
    spark: SparkSession, path: str, policy: str = "router", packed: bool = False
) -> DataFrame:
    """Subtitle files as they arrive below `path`: (doc_id, content, format).

    With `packed` they arrive as files of a packed corpus, many documents each.
    """
    if packed:
        docs = spark.readStream.schema("name string, content string").parquet(
            f"{path}/documents").select(F.col("name").alias("doc_id"), "content")
        return docs.withColumn("format", files.format_of(F.col("doc_id"), policy))
    arrived = spark.readStream.option("recursiveFileLookup", "true").text(path, wholetext=True)
    docs = arrived.select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content")
    )
    return docs.withColumn("format", files.format_of(files.source_name(F.col("doc_id")), policy))


def arriving_segments(
    spark: SparkSession, path: str, policy: str = "router", packed: bool = False
) -> DataFrame:
    """Segments of subtitle files as they arrive below `path`. Stateless."""
    return codec.parse(arriving_documents(spark, path, policy, packed))


def arriving_issues(
    spark: SparkSession, path: str, policy: str = "router", packed: bool = False
) -> DataFrame:
    """Segment rule issues of arriving files. Stateless."""
    return segment_issues(arriving_segments(spark, path, policy, packed))


def run_available(
    stream: DataFrame, output: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Everything that has arrived, processed into parquet files; then the query stops."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def report_per_batch(
    spark: SparkSession, path: str, output: str, checkpoint: str, policy: str = "router",
    packed: bool = False,
) -> StreamingQuery:
    """Validation report of each arriving file, also of one without a single cue.

    A file always lies in one batch as a whole. Each batch writes its own folder and replaces it
    when it is run again.
    """
    from cueflow.plans.validation import validation_report

    def write(batch: DataFrame, batch_id: int) -> None:
        # the text is read twice, the files once
        docs = settle(batch, "arrived")
        report = validation_report(codec.parse(docs), docs)
        report.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    query = (
        arriving_documents(spark, path, policy, packed)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def knowledge_counts(pairs: DataFrame) -> DataFrame:
    """Running count of each approved pair in its context; the state holds one row per key."""
    return pairs.groupBy(*knowledge.KEY).agg(F.count("*").alias("count"))


def knowledge_versions(
    pairs: DataFrame, start: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Approved pairs folded into the KB, one version per batch.

    Version n+1 is always made from version n and batch n, so a repeated batch writes the same
    version again and counts nothing twice.
    """
    from cueflow.sources.knowledge_store import read_version, write_version

    spark = start.sparkSession
    write_version(start, path, 0)

    def fold(batch: DataFrame, batch_id: int) -> None:
        merged = knowledge.upsert(read_version(spark, path, batch_id), batch)
        write_version(merged, path, batch_id + 1)

    query = (
        pairs.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def outcome_windows(log: DataFrame, span: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Applied and successful corrections per tenant and window; later rows than `lateness` drop.

    The state holds a window until the watermark has passed it.
    """
    counted = (
        log.withColumn("applied_at", F.col("applied_at").cast("timestamp"))
        .withWatermark("applied_at", lateness)
        .groupBy("tenant_id", F.window("applied_at", span).alias("w"))
        .agg(
            F.count("*").alias("applied"),
            F.count_if(F.col("was_successful")).alias("successful"),
        )
    )
    return counted.select(
        "tenant_id", F.col("w.start").alias("window_start"), "applied", "successful"
    )


def run_outcome_windows(
    log: DataFrame, output: str, checkpoint: str, span: str = "1 day", lateness: str = "2 days"
) -> StreamingQuery:
    """All arrived rows of the log counted into `output`, also windows that are still open.

    Each batch writes the totals of the windows that it has changed into a folder of its own, and
    replaces it when it is run again, so a restart counts nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    query = (
        outcome_windows(log, span, lateness).writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_outcome_windows(spark: SparkSession, output: str) -> DataFrame:
    """The latest totals of every window: (tenant_id, window_start, applied, successful)."""
    schema = "tenant_id string, window_start timestamp, applied long, successful long, batch long"
    written = spark.read.schema(schema).option("basePath", output).parquet(output)
    latest = written.groupBy("tenant_id", "window_start").agg(
        F.max_by(F.struct("applied", "successful"), "batch").alias("last"))
    return latest.select("tenant_id", "window_start", "last.applied", "last.successful")
