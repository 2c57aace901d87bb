"""The tools as table functions: search, open a result, search and extract, health, and their JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import canonical
from pagewright.operators.search import SearchProvider, clamp_count


def search_web(queries: DataFrame, provider: SearchProvider) -> DataFrame:
    """Ranked results of each query (query of at most 500 characters, num_results from 1 to 10, 5 by default)."""
    wanted = queries.where(F.length("query").between(1, 500)).select("query", clamp_count(F.coalesce("num_results", F.lit(5))).alias("num_results"))
    return provider.search(wanted)


def open_result(results: DataFrame, extracted: DataFrame, rank: int = 1) -> DataFrame:
    """The extraction of each query's result of ``rank``; queries without it, or whose page failed, have no row."""
    picked = results.where(F.col("rank") == rank).withColumn("page", canonical(F.col("url")))
    pages = extracted.withColumn("page", canonical(F.col("url"))).drop("url", "title")
    return picked.join(pages, "page").drop("page")


def open_outcomes(queries: DataFrame, results: DataFrame, extracted: DataFrame, rank: int = 1) -> DataFrame:
    """One row a query: the extraction of its result of ``rank``, or the error that stands in its place.

    A query without that rank is SERP_NO_RESULTS with the number of results it has; a result
    whose page was not extracted gives the page's own error, NAVIGATION_FAILED where it is unknown.
    """
    counts = results.groupBy("query").agg(F.count("*").alias("found"))
    picked = results.where(F.col("rank") == rank).select("query", F.lit(True).alias("picked"))
    opened = open_result(results, extracted, rank).select("query", "result_id", "score", F.col("error_code").alias("page_error"))
    rows = queries.select("query").distinct().join(counts, "query", "left").join(picked, "query", "left").join(opened, "query", "left")
    code = F.when(F.col("picked").isNull(), F.lit("SERP_NO_RESULTS")).when(F.col("result_id").isNull(), F.coalesce("page_error", F.lit("NAVIGATION_FAILED"))).otherwise(F.col("page_error"))
    said = F.concat(F.lit(f"No result found at rank {rank}. Only "), F.coalesce("found", F.lit(0)).cast("string"), F.lit(" results returned."))
    return rows.select("query", "result_id", "score", code.alias("error_code"), F.when(F.col("picked").isNull(), said).alias("error_message"))


def search_and_extract(results: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row a result: what was extracted from its page, or a failed row that keeps the search title.

    ``extracted`` has at most one row a canonical URL: url, title, excerpt, content_body,
    text_content or its text_length, score, warnings, error_code.
    """
    size = F.col("text_length") if "text_length" in extracted.columns else F.length("text_content")
    pages = extracted.select(
        canonical(F.col("url")).alias("page"), F.col("title").alias("page_title"), "excerpt", F.col("content_body").alias("body"), size.alias("length"),
        F.col("score").alias("page_score"), F.col("warnings").alias("page_warnings"), F.col("error_code").alias("page_error"),
    )
    joined = results.withColumn("page", canonical(F.col("url"))).join(pages, "page", "left")
    ok = F.col("length").isNotNull() & F.col("page_error").isNull()
    failure = F.array(F.concat(F.lit("EXTRACTION_FAILED: "), F.coalesce("page_error", F.lit("NAVIGATION_FAILED"))))
    return joined.select(
        "query", "rank", "url", F.when(ok, F.col("page_title")).otherwise(F.col("title")).alias("title"), F.when(ok, F.col("excerpt")).alias("excerpt"), F.when(ok, F.col("body")).alias("text"),
        F.when(ok, F.col("length")).otherwise(0).cast("long").alias("content_length"), F.when(ok, F.col("page_score")).otherwise(0).cast("long").alias("extraction_score"),
        F.when(ok, F.coalesce("page_warnings", F.array().cast("array<string>"))).otherwise(failure).alias("warnings"),
    )


def nested(queries: DataFrame, results: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, document): one JSON document a query, results and extractions in rank order; a query without results has empty lists."""
    listed = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "snippet"))).alias("search_results"))
    fetched = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "excerpt", "text", "content_length", "extraction_score", "warnings"))).alias("extracted_results"))
    joined = queries.select("query").distinct().join(listed, "query", "left").join(fetched, "query", "left")
    parts = F.struct("query", *(F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("search_results", "extracted_results")))
    return joined.select("query", F.to_json(parts, {"pretty": "true"}).alias("document"))


def record_json(extracted: DataFrame) -> DataFrame:
    """(page_id, document): each extraction as pretty JSON with explicit nulls."""
    fields = [c for c in extracted.columns if c != "page_id"]
    return extracted.select("page_id", F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))


def health_check(spark: SparkSession, provider: SearchProvider | None = None, version: str = "0.1.0") -> DataFrame:
    """One row: state, version and whether the provider answers; a provider that raises does not."""
    try:
        ready = bool(provider.is_available()) if provider is not None else False
    except Exception:
        ready = False
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(version).alias("version"), F.lit(ready).alias("search_ready"))
