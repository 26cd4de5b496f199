"""Writers: stage tables, partial/append output, model x prompt-mode layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_arrays


def write_records(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write a stage table (Parquet by default), optionally partitioned by level."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """The rows as the ordered parts of one JSON array, written by many tasks (:mod:`.json_arrays`)."""
    json_arrays.write_array(df, path)


def write_answers(df: DataFrame, root: str, mode: str = "append") -> None:
    """Answer layout by model and prompt mode (partition discovery reads both back)."""
    df.write.mode(mode).partitionBy("prompt_mode", "model").parquet(root)


def read_answers(spark: SparkSession, root: str, model: str | None = None,
                 prompt_mode: str | None = None) -> DataFrame:
    """Read answers; filters on the layout columns prune partitions."""
    df = spark.read.parquet(root)
    if model is not None:
        df = df.filter(F.col("model") == model)
    if prompt_mode is not None:
        df = df.filter(F.col("prompt_mode") == prompt_mode)
    return df


def row_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row DataFrame (no driver round trip)."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
