"""Knowledge tables on shared storage, one folder per version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_entries(kb: DataFrame) -> DataFrame:
    """Rows with the JSON `tags` text as an array; all contexts are kept."""
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    return kb.withColumn("tags", tags)


def encode_entries(kb: DataFrame) -> DataFrame:
    return kb.withColumn("tags", F.to_json("tags"))


def write_version(kb: DataFrame, path: str, version: int) -> None:
    """A new version next to the old ones; readers of old versions are not disturbed."""
    kb.write.mode("overwrite").parquet(f"{path.rstrip('/')}/v{version:08d}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/v{version:08d}")
