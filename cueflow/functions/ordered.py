"""Order-dependent helpers whose tasks stay bounded however many rows one key holds.

A window over a whole document would put that document into one task. These helpers cut each key
into blocks of consecutive rows instead and carry between blocks only what the next one needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cueflow.session import settle

BLOCK = 4096


def with_previous(
    df: DataFrame, key: list[str], pos: str, columns: list[str], block: int = BLOCK
) -> DataFrame:
    """Add `prev_<column>`: the value in the row one position earlier, null in the first row.

    `pos` counts 0, 1, 2, ... without holes (see `dense_position`). The last row of each block is
    also sent to the next block, so one shuffle is enough.
    """
    home = F.floor(F.col(pos) / block).cast("long")
    targets = F.when(
        F.pmod(F.col(pos) + 1, F.lit(block)) == 0, F.array(home, home + 1)
    ).otherwise(F.array(home))
    order = Window.partitionBy(*key, "__block").orderBy(pos)
    out = df.withColumn("__block", F.explode(targets))
    out = out.select("*", *[F.lag(c).over(order).alias(f"prev_{c}") for c in columns])
    return out.where(F.col("__block") == home).drop("__block")


def with_next(
    df: DataFrame, key: list[str], pos: str, columns: list[str], block: int = BLOCK
) -> DataFrame:
    """Add `next_<column>`: the value in the row one position later, null in the last row.

    `pos` must have no holes, as in `with_previous`.
    """
    home = F.floor(F.col(pos) / block).cast("long")
    targets = F.when(
        (F.pmod(F.col(pos), F.lit(block)) == 0) & (F.col(pos) > 0), F.array(home, home - 1)
    ).otherwise(F.array(home))
    order = Window.partitionBy(*key, "__block").orderBy(pos)
    out = df.withColumn("__block", F.explode(targets))
    out = out.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where(F.col("__block") == home).drop("__block")


def running_sum(
    df: DataFrame,
    key: list[str],
    order: list[str],
    value: Column,
    name: str,
    bucket: Column,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum of `value` along `order` within `key`.

    `bucket` must not decrease along `order` and must bound the rows that share one value of it.
    Sums per bucket are added up first (few rows); the rows themselves are only ordered within
    their bucket.
    """
    tagged = df.withColumn("__bucket", bucket).withColumn("__value", value)
    totals = tagged.groupBy(*key, "__bucket").agg(F.sum("__value").alias("__total"))
    before = (
        Window.partitionBy(*key)
        .orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *key, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    inside = (
        Window.partitionBy(*key, "__bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.col("__offset") + F.sum("__value").over(inside)
    if exclusive:
        total = total - F.col("__value")
    return (
        tagged.join(offsets, [*key, "__bucket"])
        .withColumn(name, total.cast("long"))
        .drop("__bucket", "__value", "__offset")
    )


def dense_position(
    df: DataFrame, key: list[str], order: list[str], bucket: Column, name: str = "pos"
) -> DataFrame:
    """0-based rank of each row within `key` along `order` (which must be unique)."""
    return running_sum(df, key, order, F.lit(1), name, bucket, exclusive=True)


def number_in_order(df: DataFrame, order: list[str], name: str, start: Column) -> DataFrame:
    """Consecutive numbers from `start` along `order`, over the whole of `df`.

    Rows are range-partitioned and written down with their partition; then each partition numbers
    its own rows after the sizes of those before it.
    """
    placed = settle(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered"
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__size")).select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, start + F.col("__offset") + F.row_number().over(inside) - 1)
        .drop("__part", "__offset")
    )
