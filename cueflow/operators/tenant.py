"""Per-tenant memory: confidence bands, outcome statistics, best correction, context, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cueflow import constants as K
from cueflow.functions.skew import join_spread


def confidence_band(confidence: Column) -> Column:
    """Band of a confidence in 0..1; each band holds its lower bound, the top one also 1."""
    band = None
    for name, low in reversed(K.CONFIDENCE_BANDS):
        test = (confidence >= low) & (confidence <= 1.0)
        band = F.when(test, F.lit(name)) if band is None else band.when(test, F.lit(name))
    return band


def outcome_stats(history: DataFrame) -> DataFrame:
    """Uses, successes, success rate and last use of each correction of a tenant."""
    uses, wins = F.count("*"), F.count_if(F.col("was_successful"))
    return history.groupBy("tenant_id", "correction_id").agg(
        uses.alias("usage_count"), wins.alias("success_count"),
        (wins / uses).alias("success_rate"), F.max("applied_at").alias("last_used_at"),
    )


def with_outcomes(corrections: DataFrame, history: DataFrame) -> DataFrame:
    """Corrections (tenant_id, id, …) with their statistics; unused ones get zeros."""
    outcomes = outcome_stats(history).withColumnRenamed("correction_id", "id")
    return corrections.join(outcomes, ["tenant_id", "id"], "left").fillna(
        0, ["usage_count", "success_count", "success_rate"]
    )


def best_tenant_corrections(corrections: DataFrame, lookups: DataFrame) -> DataFrame:
    """Best correction for (tenant_id, original_text): confidence, success rate, then lowest id.

    One row per tenant and text is picked before the join, by an aggregate that combines on the
    map side, so no lookup meets more than one row.
    """
    place = F.struct(-F.col("confidence"), -F.col("success_rate"), F.col("id"))
    best = corrections.groupBy("tenant_id", "original_text").agg(
        F.min_by(F.struct("id", "corrected_text", "confidence"), place).alias("best")
    )
    joined = join_spread(
        lookups, best, ["tenant_id", "original_text"], "left", by=lookups.columns
    )
    return joined.select(
        *lookups.columns, F.col("best.id").alias("id"),
        F.col("best.corrected_text").alias("corrected_text"),
        F.col("best.confidence").alias("confidence"),
    )


def top_context(entities: DataFrame, limit: int) -> DataFrame:
    """First `limit` entities per tenant and type by authority, then id."""
    order = Window.partitionBy("tenant_id", "entity_type").orderBy(F.desc("authority_score"), "id")
    return entities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def daily_history(history: DataFrame, span: str = "1 day") -> DataFrame:
    """Applied and successful corrections per tenant and time window."""
    counted = history.groupBy("tenant_id", F.window("applied_at", span).alias("w")).agg(
        F.count("*").alias("applied"), F.count_if(F.col("was_successful")).alias("successful")
    )
    return counted.select(
        "tenant_id", F.col("w.start").alias("window_start"), "applied", "successful"
    )
