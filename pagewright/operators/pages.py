"""Queries over extracted pages and their audits: policy, duplicates, scores, noise, audit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import quality, text, urls
from pagewright.functions.markup import tag_link_density


def policy(pages: DataFrame) -> DataFrame:
    """Host, private-host flag and error code of each page's URL."""
    name = urls.host(F.col("url"))
    return pages.select("result_id", name.alias("host"), urls.is_http(F.col("url")).alias("is_http"), urls.is_private_host(name).alias("is_private"), urls.url_error(F.col("url")).alias("error_code"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """The latest fetch of each canonical URL; of equal times the lowest result_id. Aggregated, so that hot pages merge before the shuffle."""
    newest = F.max_by("result_id", F.struct("fetched_at", (-F.col("result_id")).alias("first")))
    return pages.where(F.col("url").isNotNull()).groupBy(urls.canonical(F.col("url")).alias("canonical")).agg(newest.alias("result_id"), F.count("*").alias("copies"))


def scored(rows: DataFrame, key: str, body: Column, density: Column, title: Column, byline: Column, excerpt: Column, date: Column) -> DataFrame:
    """Features, score, label and weak flag from a text and the presence of its metadata; a null text counts as empty."""
    said = F.coalesce(body, F.lit(""))
    features = rows.select(
        key, F.length(said).cast("long").alias("text_length"), text.sentence_count(said).alias("sentences"), density.alias("link_density"), text.boilerplate_hits(said).alias("boilerplate_hits"),
        title.isNotNull().alias("has_title"), byline.isNotNull().alias("has_byline"), excerpt.isNotNull().alias("has_excerpt"), date.isNotNull().alias("has_date"),
    )
    c = F.col
    points = quality.score(c("text_length"), c("sentences"), c("link_density"), c("boilerplate_hits"), c("has_title"), c("has_byline"), c("has_excerpt"), c("has_date"), F.lit(True))
    out = features.withColumn("page_score", points)
    return out.withColumns({"page_label": quality.label(c("page_score")), "is_weak": quality.weak(c("page_score"), c("text_length"), c("link_density"))})


def page_scores(pages: DataFrame) -> DataFrame:
    return scored(pages, "result_id", F.col("text_content"), tag_link_density(F.col("cleaned_html")), F.col("title"), F.col("byline"), F.col("excerpt"), F.col("published_date"))


def noise_rows(pages: DataFrame) -> DataFrame:
    """One row for each noise pattern that a page's text matches, with the match and its surroundings."""
    return pages.select("result_id", F.explode(text.noise_hits(F.coalesce("text_content", F.lit("")))).alias("n")).select("result_id", "n.*")


def audit_report(audits: DataFrame, least_score: int = 65) -> DataFrame:
    """By tier: entries, successes, good ones (score and no noise), noisy, weak and failed ones, and the pass rate in per cent."""
    d = F.col("diagnostics")
    done = F.coalesce("success", F.lit(False))
    good = done & (d["score"] >= least_score) & (d["noise_hits"] == 0)
    return audits.groupBy("tier").agg(
        F.count("*").alias("entries"), F.count_if(done).alias("succeeded"), F.count_if(good).alias("good"), F.count_if(done & (d["noise_hits"] > 0)).alias("noisy"),
        F.count_if(done & d["weak_extraction"]).alias("weak"), F.count_if(~done).alias("failed"), F.floor(F.count_if(good) * 100.0 / F.count("*") + 0.5).cast("long").alias("pass_rate"),
    )


def latest_audits(audits: DataFrame) -> DataFrame:
    """The last audit of each URL, with its figures where it succeeded."""
    last = F.max_by(F.struct("audit_id", "tier", "success", F.col("diagnostics.score").alias("score"), F.col("diagnostics.noise_hits").alias("noise_hits")), F.struct("audited_at", "audit_id"))
    return audits.where(F.col("url").isNotNull()).groupBy("url").agg(last.alias("last"), F.count("*").alias("audits")).select("url", "last.*", "audits")
