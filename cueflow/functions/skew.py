"""Joins that stay balanced when one key holds a large share of the rows, and tasks that stay small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_spread(
    large: DataFrame, small: DataFrame, key: list[str], how: str, by: list[str], salts: int = SALTS
) -> DataFrame:
    """`large` joined to `small` on `key`, each key spread over `salts` tasks.

    Rows of `large` are salted by a hash of the columns `by`; `small`, which has one row per key,
    is repeated once per salt, so every row still meets its partner (inner, left, left_anti).
    """
    salted = large.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    copies = small.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(copies, [*key, "__salt"], how).drop("__salt")


def deal(df: DataFrame, *key: str) -> DataFrame:
    """`df` by `key` on all shuffle partitions of the session, eight per core at least, never merged.

    For rows that multiply behind the shuffle or take memory by the row: merged by their compressed
    size they would be too many for a task.
    """
    session = df.sparkSession
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, 8 * session.sparkContext.defaultParallelism), *key)
