"""Overlaps, gap islands and clipping on (doc_id, pos, start_ms, end_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cueflow import constants as K
from cueflow.functions.ordered import running_sum, with_next, with_previous
from cueflow.functions.skew import join_spread

CELL_MS = 16_000
CELL_GROWTH = 16
LEVELS = 12
TIME_BUCKET_MS = 65_536


def _level() -> F.Column:
    """Coarseness whose cells are at least as wide as the interval (0 = CELL_MS wide)."""
    length = F.col("end_ms") - F.col("start_ms")
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(length <= CELL_MS * CELL_GROWTH**n, F.lit(n)).otherwise(level)
    return level


def _width(level) -> F.Column:
    widths = F.array(*[F.lit(CELL_MS * CELL_GROWTH**n) for n in range(LEVELS)])
    return F.get(widths, level)


def overlap_pairs(segments: DataFrame) -> DataFrame:
    """Every overlapping pair of a document once: (doc_id, pos_i < pos_j).

    Of two overlapping intervals, the one that starts later starts inside the other. So intervals
    are spread over the (at most two) cells of a width fitting their length, starts stand in one
    cell per width in use in their document, and the pair meets in exactly one cell: an equi-join on
    the cell with the exact test as residual. So an interval with a broken end multiplies the starts
    of its own document only. The join key holds a time cell, so a long or frequent document
    spreads over many keys; adaptive skew splitting halves cells that are still crowded.
    """
    spans = segments.select("doc_id", "pos", "start_ms", "end_ms")
    proper = spans.where("start_ms < end_ms").withColumn("level", _level())
    # at most LEVELS entries for each document
    used = proper.groupBy("doc_id").agg(F.collect_set("level").alias("levels"))
    outer = proper.withColumn("width", _width(F.col("level"))).select(
        "doc_id", "level",
        F.explode(
            F.sequence(
                F.floor(F.col("start_ms") / F.col("width")),
                F.floor((F.col("end_ms") - 1) / F.col("width")),
            )
        ).alias("cell"),
        F.col("pos").alias("pos_a"), F.col("start_ms").alias("start_a"),
        F.col("end_ms").alias("end_a"),
    )
    inner = join_spread(spans, used, ["doc_id"], "inner", by=["pos"]).select(
        "doc_id", F.explode("levels").alias("level"),
        F.col("pos").alias("pos_b"), F.col("start_ms").alias("start_b"),
        F.col("end_ms").alias("end_b"),
    ).withColumn("cell", F.floor(F.col("start_b") / _width(F.col("level"))))
    later = (F.col("start_a") < F.col("start_b")) | (
        (F.col("start_a") == F.col("start_b")) & (F.col("pos_a") < F.col("pos_b"))
    )
    overlap = (F.col("start_b") < F.col("end_a")) & (F.col("start_a") < F.col("end_b"))
    return (
        outer.hint("merge").join(inner, ["doc_id", "level", "cell"])
        .where(later & overlap)
        .select(
            "doc_id",
            F.least("pos_a", "pos_b").alias("pos_i"),
            F.greatest("pos_a", "pos_b").alias("pos_j"),
        )
    )


def overlap_counts(segments: DataFrame) -> DataFrame:
    """Number of overlapping pairs per document without making the pairs.

    Two proper intervals miss each other when one ends at or before the start of the other, so
    their overlaps are all pairs minus the (end <= start) pairs, which a running count of ends
    over time gives. An empty interval overlaps the proper ones that hold its instant strictly
    inside. Only inverted intervals, which are faults, go through the pair join.

    Rows are first added up per (document, instant), then per time bucket, so neither a crowded
    instant nor a long document lands in one task.
    """
    spans = segments.select("doc_id", "pos", "start_ms", "end_ms")
    instants = spans.where("start_ms <= end_ms").select(
        "doc_id",
        F.inline(
            F.when(
                F.col("start_ms") < F.col("end_ms"),
                F.array(
                    F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("starts"),
                             F.lit(0).alias("ends"), F.lit(0).alias("points")),
                    F.struct(F.col("end_ms").alias("at"), F.lit(0).alias("starts"),
                             F.lit(1).alias("ends"), F.lit(0).alias("points")),
                ),
            ).otherwise(
                F.array(
                    F.struct(F.col("start_ms").alias("at"), F.lit(0).alias("starts"),
                             F.lit(0).alias("ends"), F.lit(1).alias("points"))
                )
            )
        ),
    )
    totals = instants.groupBy("doc_id", "at").agg(
        F.sum("starts").alias("starts"), F.sum("ends").alias("ends"),
        F.sum("points").alias("points"),
    )
    inside = (
        Window.partitionBy("doc_id", "bucket")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Within a bucket: ends up to each instant, starts before it.
    placed = (
        totals.withColumn("bucket", F.floor(F.col("at") / TIME_BUCKET_MS))
        .withColumn("ended", F.sum("ends").over(inside))
        .withColumn("started", F.sum("starts").over(inside) - F.col("starts"))
    )
    buckets = placed.groupBy("doc_id", "bucket").agg(
        F.sum("starts").alias("starts"), F.sum("ends").alias("ends"),
        F.sum("points").alias("points"),
        F.sum(F.col("starts") * F.col("ended")).alias("apart"),
        F.sum(F.col("points") * (F.col("started") - F.col("ended"))).alias("on_points"),
    )
    before = (
        Window.partitionBy("doc_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Across buckets: whatever started or ended in earlier ones counts for every row of this one.
    counted = (
        buckets.withColumn("s", F.coalesce(F.sum("starts").over(before), F.lit(0)))
        .withColumn("e", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .groupBy("doc_id")
        .agg(
            F.sum("starts").alias("n"),
            F.sum(F.col("apart") + F.col("starts") * F.col("e")).alias("apart"),
            F.sum(F.col("on_points") + F.col("points") * (F.col("s") - F.col("e")))
            .alias("on_points"),
        )
        .select(
            "doc_id",
            (F.expr("n * (n - 1) div 2") - F.col("apart") + F.col("on_points")).alias("pairs"),
        )
    )
    inverted = _inverted_overlaps(spans).groupBy("doc_id").agg(F.count("*").alias("pairs"))
    return (
        counted.unionByName(inverted)
        .groupBy("doc_id")
        .agg(F.sum("pairs").alias("overlap_count"))
    )


def _inverted_overlaps(spans: DataFrame) -> DataFrame:
    """One row per (inverted interval, proper interval strictly around it).

    Without inverted intervals, the usual case, the proper ones are dropped before any shuffle.
    """
    width = F.col("width")
    faulty = spans.where("start_ms > end_ms").agg(F.count("*").alias("n")).scalar()
    proper = (
        spans.where("start_ms < end_ms")
        .where(faulty > 0)
        .withColumn("level", _level())
        .withColumn("width", _width(F.col("level")))
        .select(
            "doc_id", "level", "start_ms", "end_ms",
            F.explode(
                F.sequence(
                    F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width)
                )
            ).alias("cell"),
        )
    )
    faults = (
        spans.where("start_ms > end_ms")
        .select(
            "doc_id", F.col("start_ms").alias("upper"), F.col("end_ms").alias("lower"),
            F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"),
        )
        .withColumn("cell", F.floor(F.col("upper") / _width(F.col("level"))))
    )
    return faults.join(proper.hint("merge"), ["doc_id", "level", "cell"]).where(
        (F.col("start_ms") < F.col("lower")) & (F.col("upper") < F.col("end_ms"))
    )


def merge_adjacent(
    segments: DataFrame, gap_ms: int = K.MERGE_GAP_MS, part_cues: int = K.MAX_SEGMENTS
) -> DataFrame:
    """Runs of segments whose gap to the previous one is at most `gap_ms`, as one segment each.

    Text of a run longer than `part_cues` positions continues in further parts (`part_no`), so no
    run has to fit one row; start, end and size always describe the whole run.
    """
    linked = with_previous(segments, ["doc_id"], "pos", ["end_ms"])
    breaks = F.when(
        F.col("prev_end_ms").isNull() | (F.col("start_ms") - F.col("prev_end_ms") > gap_ms), 1
    ).otherwise(0)
    runs = running_sum(
        linked, ["doc_id"], ["pos"], breaks, "run", F.floor(F.col("pos") / 4096)
    ).withColumn("part_no", F.floor(F.col("pos") / part_cues))
    parts = runs.groupBy("doc_id", "run", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"),
        F.min("pos").alias("first_pos"),
        F.min_by("start_ms", "pos").alias("first_start"),
        F.max("pos").alias("last_pos"),
        F.max_by("end_ms", "pos").alias("last_end"),
        F.count("*").alias("cues"),
    )
    whole = parts.groupBy("doc_id", "run").agg(
        F.min_by("first_start", "first_pos").alias("start_ms"),
        F.max_by("last_end", "last_pos").alias("end_ms"),
        F.sum("cues").alias("merged_cues"),
    )
    return parts.join(whole, ["doc_id", "run"]).select(
        "doc_id", (F.col("run") - 1).alias("pos"), "part_no", "start_ms", "end_ms", "merged_cues",
        F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text"),
    )


def clip_overlaps(segments: DataFrame) -> DataFrame:
    """End moved back to the start of the next segment when that one starts inside."""
    linked = with_next(segments, ["doc_id"], "pos", ["start_ms"])
    inside = (F.col("next_start_ms") > F.col("start_ms")) & (
        F.col("next_start_ms") < F.col("end_ms")
    )
    return linked.withColumn(
        "end_ms", F.when(inside, F.col("next_start_ms")).otherwise(F.col("end_ms"))
    ).drop("next_start_ms")
