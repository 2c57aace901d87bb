"""Items of an RSS feed as rows, and sinks for reports and page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import SAMPLE_STOP, bare_text, text_sample
from pagewright.functions.urls import domain, short_hash


def feed_items(feeds: DataFrame, most_items: int = 5, most_urls: int = 2) -> DataFrame:
    """(feed_id, item_no, keyword, traffic, urls) of the items of feeds (feed_id, xml).

    Items without a title in CDATA are dropped; traffic is '0' where missing; of the http
    links at most ``most_urls`` are kept, and of the items at most ``most_items``.
    """
    raw = F.regexp_extract_all("xml", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    item = feeds.select("feed_id", F.posexplode(raw).alias("at", "item"))
    keyword = F.regexp_extract("item", r"<title><!\[CDATA\[(.*?)\]\]></title>", 1)
    traffic = F.regexp_extract("item", r"<ht:approx_traffic>(.*?)</ht:approx_traffic>", 1)
    links = F.filter(F.transform(F.regexp_extract_all("item", F.lit(r"<ht:news_item_url>(.*?)</ht:news_item_url>"), F.lit(1)), lambda u: F.trim(u)), lambda u: u.startswith("http"))
    rows = item.select("feed_id", "at", keyword.alias("keyword"), F.coalesce(F.nullif(traffic, F.lit("")), F.lit("0")).alias("traffic"), F.slice(links, 1, most_urls).alias("urls")).where("keyword != ''")
    ranked = rows.groupBy("feed_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "keyword", "traffic", "urls"))), 1, most_items).alias("items"))
    return ranked.select("feed_id", F.posexplode("items").alias("no", "i")).select("feed_id", (F.col("no") + 1).alias("item_no"), "i.keyword", "i.traffic", "i.urls")


#: A page with less markup is not kept as a snapshot; the least score expected of one that is.
LEAST_MARKUP, LEAST_SCORE = 500, 40


def snapshot_records(pages: DataFrame) -> DataFrame:
    """(snapshot, url, domain, html, with, without, min_quality) of pages (url, html) worth keeping: what their extraction must hold and must not.

    Pages with little markup, or without a sentence to look for, are left out.
    """
    name = F.concat(domain(F.col("url")), F.lit("-"), short_hash(F.col("url")))
    rows = pages.where(F.col("url").isNotNull() & (F.length("html") >= LEAST_MARKUP)).withColumn("with", text_sample(bare_text(F.col("html"))))
    without = F.array(*map(F.lit, SAMPLE_STOP[:5]))
    return rows.where(F.size("with") > 0).select(name.alias("snapshot"), "url", domain(F.col("url")).alias("domain"), "html", "with", without.alias("without"), F.lit(LEAST_SCORE).alias("min_quality"))


def write_expectations(pages: DataFrame, folder: str) -> None:
    """Write `snapshot_records` without the markup as JSON lines, parted by site, beside what `write_snapshots` writes."""
    snapshot_records(pages).drop("html").withColumn("site", F.col("domain")).write.partitionBy("site").mode("overwrite").json(folder)


def write_snapshots(pages: DataFrame, folder: str) -> None:
    """Write pages (url, html) as JSON lines, parted by site, each with the directory name <domain>-<hash> it is known by."""
    name = F.concat(domain(F.col("url")), F.lit("-"), short_hash(F.col("url")))
    pages.where("url is not null").select(domain(F.col("url")).alias("site"), name.alias("snapshot"), "url", "html").write.partitionBy("site").mode("overwrite").json(folder)


def write_report(report: DataFrame, folder: str, date: str) -> None:
    """Write an audit report as JSON under a dated name."""
    report.write.mode("overwrite").json(f"{folder}/audit-{date}")
