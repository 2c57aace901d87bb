"""Structured Streaming over the same functions: pages as they arrive, each canonical URL once, and windowed search counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.urls import canonical
from pagewright.operators.extract import extract

PAGES = "page_id long, url string, html string, ingested_at timestamp"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of pages as they land in ``folder``."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def unique_pages(pages: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each canonical URL once within the watermark; state older than ``delay`` is dropped."""
    keyed = pages.withWatermark("ingested_at", delay).withColumn("canonical", canonical(F.col("url")))
    return keyed.dropDuplicatesWithinWatermark(["canonical"]).drop("canonical")


def extract_stream(pages: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Extract arriving pages and append the results to the parquet table ``target``; ends when all present files are read."""
    unique = unique_pages(pages)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure overwrites its own folder, so rows are written once.
        extract(batch, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(logs: DataFrame, width: str = "1 hour", delay: str = "3 days") -> DataFrame:
    """Lines and errors a window and tool, for logs that come out of order and up to ``delay`` late."""
    marked = logs.withWatermark("logged_at", delay)
    return marked.groupBy(F.window("logged_at", width).alias("w"), "tool_name").agg(F.count("*").alias("lines"), F.count_if(F.col("error_code").isNotNull()).alias("errors")).select("w.start", "w.end", "tool_name", "lines", "errors")
