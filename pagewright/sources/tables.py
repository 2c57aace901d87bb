"""Readers for the corpus tables. Paths are `<dir>/<name>.parquet` (a file or a folder of part files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a small fixed table; refuse when it is larger than it may be on the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is read as a small fixed table")
    return rows
