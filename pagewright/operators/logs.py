"""Log lines: threshold, repeated lines, requests, error text, gaps between searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.constants import LOG_LEVELS


def level_number(level: Column) -> Column:
    """0 for debug to 3 for error, whatever the case; null for other levels."""
    out = None
    for k, name in enumerate(LOG_LEVELS):
        test = F.lower(F.trim(level)) == name
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out


def at_least(logs: DataFrame, level: str) -> DataFrame:
    """Lines of ``level`` and above."""
    return logs.where(level_number(F.col("log_level")) >= LOG_LEVELS.index(level))


def distinct_lines(logs: DataFrame) -> DataFrame:
    """Lines without repeats under another log_id; of each line the lowest log_id stays."""
    content = [c for c in logs.columns if c not in ("log_id", "received_at")]
    kept = logs.withColumn("log_level", F.lower(F.trim("log_level"))).groupBy(*content).agg(F.min("log_id").alias("log_id"), F.min("received_at").alias("received_at"))
    return kept.select(*logs.columns)


def client_message(code: Column, message: Column) -> Column:
    """'[CODE] message', INTERNAL_ERROR where no code is given."""
    return F.concat(F.lit("["), F.coalesce(code, F.lit("INTERNAL_ERROR")), F.lit("] "), F.coalesce(message, F.lit("")))


def requests(logs: DataFrame) -> DataFrame:
    """One row a request: tool, lines, first time, longest elapsed time, last score, error code (the lowest of several)."""
    lines = distinct_lines(logs.where(F.col("request_id").isNotNull()))
    return lines.groupBy("request_id").agg(
        F.min("tool_name").alias("tool_name"), F.count("*").alias("lines"), F.min("logged_at").alias("started_at"), F.max("elapsed_ms").alias("elapsed_ms"),
        F.max("extraction_score").alias("extraction_score"), F.max("result_count").alias("result_count"), F.min("error_code").alias("error_code"),
    )


def tool_report(logs: DataFrame, timeout_ms: int = 15_000) -> DataFrame:
    """By tool: requests, failures, requests over the time limit, mean elapsed time in whole milliseconds."""
    rows = requests(logs)
    return rows.groupBy("tool_name").agg(
        F.count("*").alias("requests"), F.count_if(F.col("error_code").isNotNull()).alias("failed"), F.count_if(F.col("elapsed_ms") > timeout_ms).alias("late"),
        F.floor(F.sum("elapsed_ms") / F.count("elapsed_ms")).cast("long").alias("mean_elapsed_ms"),
    )


#: Seconds of a bucket in which searches are ordered; a region's day is never gathered in one task.
BUCKET_S = 3600


def search_gaps(results: DataFrame, least_s: int = 2) -> DataFrame:
    """(search_id, region_code, gap_us) of searches that began less than ``least_s`` seconds after the one before of their day and region.

    Searches are compared within buckets of time; those near a bucket's end are shown to the
    next bucket as well, so that no pair is lost and no group grows with the day.
    """
    width = max(BUCKET_S, least_s)
    searches = results.groupBy("search_id").agg(F.min("searched_at").alias("searched_at"), F.min("region_code").alias("region_code"))
    at = F.unix_micros(F.col("searched_at").cast("timestamp"))
    rows = searches.where(F.col("searched_at").isNotNull()).select("search_id", "region_code", at.alias("at"), F.to_date("searched_at").alias("day"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / (width * 1_000_000)))
    near = F.pmod(F.col("at"), F.lit(width * 1_000_000)) >= (width - least_s) * 1_000_000
    shown = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = rows.withColumn("ahead", F.explode(shown)).withColumn("bucket", F.col("bucket") + F.col("ahead"))
    order = Window.partitionBy("day", "region_code", "bucket").orderBy("at", "search_id")
    gap = F.col("at") - F.lag("at").over(order)
    return both.withColumn("gap_us", gap).where((F.col("ahead") == 0) & (F.col("gap_us") < least_s * 1_000_000)).select("search_id", "region_code", "gap_us")
