"""Validation of a corpus: parse, rules, overlaps, order, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.ordered import with_previous
from cueflow.operators import intervals, rules, stats
from cueflow.session import settle
from cueflow.sources import codec, files


def all_issues(
    segments: DataFrame, docs: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Every issue of every document; `docs` adds those without a single segment.

    The segments are read twice: for their times, which are written once for overlaps and order, and
    for the rules on their text.
    """
    times = settle(segments.select("doc_id", "pos", "idx", "start_ms", "end_ms"), "cue-times")
    issues = (
        rules.segment_issues(segments, strict=strict)
        .unionByName(rules.overlap_issues(intervals.overlap_pairs(times)))
        .unionByName(rules.order_issues(times))
    )
    if docs is not None:
        issues = issues.unionByName(rules.empty_document_issues(docs, times))
    return issues


def validation_report(
    segments: DataFrame, docs: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Statistics and verdict per document.

    The verdict needs counts only, so no issue row is ever made: the segments are read once, each
    one's broken rules are counted there and its text is dropped. What is left is written once; one
    neighbour pass adds the order faults while everything is summed up, and overlaps come from the
    pair-free count.
    """
    checks = rules.SegmentRules(strict=strict)
    measured = settle(segments.select(
        "doc_id", "pos", "start_ms", "end_ms", F.length("text").alias("chars"),
        rules.cps().alias("cps"), checks.tally(errors=True).alias("rule_errors"),
        checks.tally(errors=False).alias("rule_warnings"),
    ), "cue-measures")
    linked = with_previous(measured, ["doc_id"], "pos", ["start_ms", "end_ms"])
    counts = linked.groupBy("doc_id").agg(
        *stats.segment_measures(F.col("chars"), F.col("cps")),
        (F.sum("rule_errors") + F.count_if(rules.out_of_order())).alias("errors"),
        (F.sum("rule_warnings") + F.count_if(rules.large_gap())).alias("warnings"),
    )
    report = counts.join(intervals.overlap_counts(measured), "doc_id", "left")
    if docs is not None:
        report = docs.select("doc_id").join(report, "doc_id", "left")
    report = report.fillna(
        0, ["segment_count", "total_duration_ms", "avg_duration_ms", "avg_cps", "max_cps",
            "errors", "warnings"],
    )
    report = report.withColumn(
        "overlap_count",
        F.when(F.col("segment_count") > 0, F.coalesce("overlap_count", F.lit(0))),
    )
    empty = F.col("segment_count") == 0
    errors = F.col("errors") + F.coalesce("overlap_count", F.lit(0)) + empty.cast("long")
    return report.withColumn("errors", errors).withColumn("valid", F.col("errors") == 0)


def text_report(docs: DataFrame, max_chars: int = K.MAX_CONTENT_CHARS) -> DataFrame:
    """Reports of documents (doc_id, content, format, language) from their text on.

    One row per document: `reason` says why one was rejected; an admitted one without a cue has the
    report of an empty document.
    """
    judged = settle(files.admit(docs, max_chars), "admitted")
    admitted = files.accepted(judged)
    report = validation_report(codec.parse(admitted), admitted)
    rejected = files.rejected(judged).select("doc_id", "reason")
    return report.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected, allowMissingColumns=True)


def preset_table(spark: SparkSession) -> DataFrame:
    """The presets as rows (six, fixed)."""
    rows = []
    for name, changes in K.PRESETS.items():
        values = {**K.DEFAULT_SETTINGS, **changes}
        rows.append((name, values["min_duration_ms"], values["max_duration_ms"],
                     float(values["max_cps"]), values["line_wrap"], values["max_lines"],
                     values["merge_mode"]))
    return spark.createDataFrame(
        rows,
        "preset string, min_duration_ms int, max_duration_ms int, max_cps double, "
        "line_wrap int, max_lines int, merge_mode string",
    )


def settings_faults(settings: DataFrame) -> DataFrame:
    """Settings outside their allowed range: one row per fault, all other columns kept."""
    faults = F.array(*[
        F.when(
            ~F.col(name).between(low, high),
            F.struct(F.lit(name).alias("setting"), F.col(name).cast("double").alias("value")),
        )
        for name, (low, high) in K.SETTING_RANGES.items()
    ])
    return settings.select("*", F.inline(F.filter(faults, lambda f: f.isNotNull())))


def preset_issues(segments: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Segment rules with the thresholds of each document's `preset`.

    A null or unknown preset has the default thresholds.
    """
    presets = preset_table(segments.sparkSession)
    names_of = ["min_duration_ms", "max_duration_ms", "max_cps", "line_wrap"]
    default = {**K.DEFAULT_SETTINGS, "max_cps": float(K.DEFAULT_SETTINGS["max_cps"])}
    joined = segments.join(F.broadcast(presets.select("preset", *names_of)), "preset", "left").withColumns(
        {n: F.coalesce(n, F.lit(default[n])) for n in names_of})
    # The preset travels inside the document key, which the rules hand through untouched.
    keyed = joined.withColumn("doc_id", F.struct("doc_id", "preset"))
    limits = {n: F.col(n) for n in names_of}
    issues = rules.segment_issues(keyed, names, limits)
    return issues.select(
        F.col("doc_id.preset").alias("preset"),
        F.col("doc_id.doc_id").alias("doc_id"),
        *[c for c in rules.ISSUE_COLUMNS if c != "doc_id"],
    )
