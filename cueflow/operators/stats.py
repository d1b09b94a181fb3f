"""Document statistics, samples, size distributions and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.operators.intervals import overlap_counts
from cueflow.operators.rules import cps, duration_ms
from cueflow.session import settle


def segment_measures(chars: Column, speed: Column) -> list[Column]:
    """Aggregates over the segments of a document: counts, durations, reading speed, length."""
    timed_speed = F.when(duration_ms() > 0, speed)
    return [
        F.count("*").alias("segment_count"),
        F.max_by("end_ms", "pos").alias("total_duration_ms"),
        (F.sum(duration_ms()) / F.count("*")).alias("avg_duration_ms"),
        F.min(duration_ms()).alias("min_duration_ms"),
        F.max(duration_ms()).alias("max_duration_ms"),
        F.coalesce(F.avg(timed_speed), F.lit(0.0)).alias("avg_cps"),
        F.coalesce(F.max(timed_speed), F.lit(0.0)).alias("max_cps"),
        F.sum(chars).alias("total_characters"),
    ]


def segment_stats(segments: DataFrame) -> DataFrame:
    """The measures per document. Partially aggregated before the shuffle, no sort."""
    return segments.groupBy("doc_id").agg(*segment_measures(F.length("text"), cps()))


def document_stats(segments: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Statistics with overlap counts; documents of `docs` without segments give zeros.

    The segments are read once; their text is measured there and dropped.
    """
    measured = settle(segments.select(
        "doc_id", "pos", "start_ms", "end_ms", F.length("text").alias("chars"),
        cps().alias("cps")), "cue-measures")
    stats = measured.groupBy("doc_id").agg(
        *segment_measures(F.col("chars"), F.col("cps"))).join(
        overlap_counts(measured), "doc_id", "left")
    stats = stats.withColumn("overlap_count", F.coalesce("overlap_count", F.lit(0)))
    if docs is None:
        return stats
    zeros = ["segment_count", "total_duration_ms", "avg_duration_ms", "avg_cps", "max_cps"]
    return docs.select("doc_id").join(stats, "doc_id", "left").fillna(0, zeros)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Errors, warnings and verdict of each document that has issues."""
    is_error = F.col("severity") == "error"
    return issues.groupBy("doc_id").agg(
        F.count_if(is_error).alias("errors"),
        F.count_if(~is_error).alias("warnings"),
        (F.count_if(is_error) == 0).alias("valid"),
    )


def document_verdicts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """As `issue_counts`, for every document."""
    return (
        docs.select("doc_id")
        .join(issue_counts(issues), "doc_id", "left")
        .fillna(0, ["errors", "warnings"])
        .fillna(True, ["valid"])
    )


def issue_breakdown(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id", "issue_type").agg(F.count("*").alias("issues"))


def applied_type_counts(applied: DataFrame) -> DataFrame:
    kind = F.lower("type")
    return applied.groupBy("doc_id").agg(
        F.count_if(kind == "entity").alias("entity"),
        F.count_if(kind == "grammar").alias("grammar"),
        F.count_if(~kind.isin("entity", "grammar")).alias("other"),
    )


def context_sample(segments: DataFrame) -> DataFrame:
    """Sample text per document: everything up to 100 lines, else 50 + "..." + 50 from the middle.

    The wanted positions (at most 100 per document) are worked out from the counts and joined on
    (document, position), so a huge document neither sorts nor collects its lines.
    """
    sizes = segments.groupBy("doc_id").agg(F.count("*").alias("n"))
    large = F.col("n") > K.SAMPLE_WHOLE
    middle = F.expr("n div 2")
    wanted = sizes.select(
        "doc_id", "n",
        F.explode(
            F.when(
                large,
                F.concat(
                    F.sequence(F.lit(0).cast("long"), F.lit(K.SAMPLE_HEAD - 1).cast("long")),
                    F.sequence(middle, middle + K.SAMPLE_HEAD - 1),
                ),
            ).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
        ).alias("pos"),
        large.alias("large"),
        middle.alias("middle"),
    )
    lines = wanted.join(segments.select("doc_id", "pos", "text"), ["doc_id", "pos"])

    def part(condition: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "text"))))
        return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")

    head = ~F.col("large") | (F.col("pos") < K.SAMPLE_HEAD)
    body = F.col("large") & (F.col("pos") >= F.col("middle"))
    return (
        lines.groupBy("doc_id")
        .agg(
            F.max("n").alias("segment_count"), F.max("large").alias("large"),
            part(head).alias("head"), part(body).alias("body"),
        )
        .select(
            "doc_id", "segment_count",
            F.when(F.col("large"), F.concat_ws("\n", "head", F.lit("..."), "body"))
            .otherwise(F.col("head")).alias("sample_text"),
        )
    )


def size_distribution(docs: DataFrame, label: str, size: Column, bounds: list[int]) -> DataFrame:
    """Cumulative histogram: documents per label with size <= each bound, and in all."""
    counts = docs.groupBy(label).agg(
        *[F.count_if(size <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count("*").alias(f"b{len(bounds)}"),
        F.sum(size).alias("size_sum"),
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("le"), F.col(f"b{i}").alias("cumulative"))
        for i, name in enumerate([*map(str, bounds), "+Inf"])
    ])
    return counts.select(label, F.inline(rows), "size_sum").select(
        label, "le", "cumulative", "size_sum"
    )


def run_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Segments processed and modified per document, matched by position."""
    new = after.select("doc_id", "pos", F.col("text").alias("new_text"))
    return (
        before.join(new, ["doc_id", "pos"], "left")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("segments_processed"),
            F.count_if(~F.col("text").eqNullSafe(F.col("new_text"))).alias("segments_modified"),
        )
    )


def preview(
    segments: DataFrame,
    cleaned: Column,
    max_segments: int = 10,
    indices: list[int] | None = None,
) -> DataFrame:
    """First `max_segments` (or the given 1-based) segments with their cleaned text."""
    if not 1 <= max_segments <= 50:
        raise ValueError("max_segments must be between 1 and 50")
    if indices:
        chosen = segments.where((F.col("pos") + 1).isin(indices))
    else:
        chosen = segments.where(F.col("pos") < max_segments)
    return chosen.withColumn("cleaned", cleaned)


def preview_reduction(previewed: DataFrame) -> DataFrame:
    """Estimated text reduction in percent, not below 0."""
    before, after = F.sum(F.length("text")), F.sum(F.length("cleaned"))
    return previewed.groupBy("doc_id").agg(
        F.count("*").alias("segments"),
        before.alias("chars_before"), after.alias("chars_after"),
        F.when(before > 0, F.greatest(F.lit(0.0), F.lit(100.0) * (before - after) / before))
        .otherwise(F.lit(0.0)).alias("reduction_percent"),
    )
