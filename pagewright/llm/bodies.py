"""Problem 3: the main body of each page, by the two-pass block rules of `blocks`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.pages import page_facts, staged_facts
from pagewright.llm.quality import flagged


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """(result_id, line_no) of each non-empty line that is not main body, of records that are prose and no residue.

    A null or empty text has no lines; null markup leaves the rules to the text; rows that
    repeat a result_id give each line once; an empty table gives no rows.
    """
    facts = staged_facts(spark, base)
    kept = flagged(facts).where(~F.col("not_prose") & ~F.coalesce(F.col("residue"), F.lit(False)))
    return kept.select("result_id", F.explode("noise_lines").alias("line_no")).distinct()


def p3_body(spark: SparkSession, base: str) -> DataFrame:
    """Each record with its main body alone: the lines that the block rules keep, empty lines as they stand between them."""
    pages = page_facts(spark, base)
    body = F.expr("array_join(filter(split(text_content, '\\n', -1), (x, i) -> not array_contains(noise_lines, i + 1)), '\\n')")
    trimmed = F.regexp_replace(F.regexp_replace(body, r"\n\s*\n(?:\s*\n)+", "\n\n"), r"^\s+|\s+$", "")
    return pages.select("result_id", F.coalesce(trimmed, F.lit("")).alias("main_body"), F.coalesce(F.size("noise_lines"), F.lit(0)).alias("lines_dropped"))
