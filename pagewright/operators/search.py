"""Search: providers of ranked results, from saved results pages or from a corpus, and the shaping they share."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.dom.serp import rows_of
from pagewright.functions.text import collapse
from pagewright.functions.urls import absolute, is_engine_page, is_http, unwrap_redirect

MOST_RESULTS = 10

_SERP = T.StructType(
    [
        T.StructField("blocked", T.StringType()),
        T.StructField(
            "rows",
            T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n == "is_ad" else T.StringType()) for n in ("title", "href", "display_url", "snippet", "is_ad")])),
        ),
    ]
)


def clamp_count(wanted: Column, most: int = MOST_RESULTS) -> Column:
    """A wanted number of results as a whole number from 1 to ``most``; null counts as 1."""
    return F.least(F.greatest(F.floor(F.coalesce(wanted, F.lit(1))), F.lit(1)), F.lit(most)).cast("int")


@F.pandas_udf(_SERP)
def read_serp(html: pd.Series, address: pd.Series) -> pd.DataFrame:
    pages = [rows_of(h if isinstance(h, str) else None, a if isinstance(a, str) else None) for h, a in zip(html, address)]
    return pd.DataFrame(pages, columns=["blocked", "rows"])


def parse_serps(pages: DataFrame) -> DataFrame:
    """Ranked rows of saved results pages (query, html, and address): query, position, title, url, display_url, snippet.

    Links are resolved and unwrapped from redirects; ads, engine pages and links that are no
    http(s) are dropped; positions are dense in document order.
    """
    read = pages.select("query", read_serp("html", "address").alias("s"))
    # Links are resolved before the rows are unnested, so that each link is a plain column to the tests that follow and their code stays small.
    links = F.transform("s.rows", lambda r: F.struct(r["title"].alias("title"), absolute(r["href"]).alias("link"), r["display_url"].alias("display_url"), r["snippet"].alias("snippet"), r["is_ad"].alias("is_ad")))
    targets = F.transform(links, lambda r: F.struct(r["title"].alias("title"), unwrap_redirect(r["link"]).alias("url"), r["display_url"].alias("display_url"), r["snippet"].alias("snippet"), r["is_ad"].alias("is_ad")))
    rows = read.select("query", F.posexplode(targets).alias("at", "r")).select("query", "at", "r.*")
    resolved = rows.where(~F.col("is_ad") & is_http(F.col("url")) & ~is_engine_page(F.col("url")))
    position = F.row_number().over(Window.partitionBy("query").orderBy("at"))
    return resolved.select("query", position.alias("position"), "title", "url", "display_url", "snippet")


def serp_errors(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """(query, error_code, error_message) of pages that give no rows: SERP_BLOCKED even where rows exist, else SERP_NO_RESULTS."""
    read = pages.select("query", "html", read_serp("html", "address").alias("s"))
    found = parsed.select("query").distinct().withColumn("found", F.lit(True))
    code = F.when(F.col("html").isNull(), "SERP_PARSE_FAILED").when(F.col("s.blocked").isNotNull(), "SERP_BLOCKED").when(F.col("found").isNull(), "SERP_NO_RESULTS")
    out = read.join(found, "query", "left").select("query", code.alias("error_code"), F.coalesce("s.blocked", F.lit("No results")).alias("error_message"))
    return out.where("error_code is not null")


def shape_results(raw: DataFrame, key: list[str], order: str, count: Column) -> DataFrame:
    """Raw rows (title, url, display_url, snippet, is_ad) as results: ads dropped, at most ``count`` a key, ranked densely from 1.

    Exact repeats of a row count once; ties in ``order`` go by url.
    """
    kept = raw.where(~F.coalesce("is_ad", F.lit(False))).dropDuplicates([*key, order, "url"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order), F.col("url")))
    return kept.withColumn("result_rank", rank).where(F.col("result_rank") <= count)


class SearchProvider(Protocol):
    """A source of results: queries (query, num_results) in, (query, rank, title, url, snippet, source) out."""

    name: str

    def is_available(self) -> bool: ...

    def search(self, queries: DataFrame) -> DataFrame: ...


class SerpHtmlProvider:
    """Answers queries from saved results pages (query, html, address)."""

    name = "google"

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def is_available(self) -> bool:
        return True

    def search(self, queries: DataFrame) -> DataFrame:
        wanted = queries.select("query", clamp_count(F.col("num_results")).alias("n"))
        parsed = parse_serps(self.pages.join(wanted.select("query"), "query", "left_semi"))
        ranked = parsed.join(wanted, "query").where("position <= n")
        return ranked.select("query", F.col("position").alias("rank"), "title", "url", "snippet", F.lit(self.name).alias("source"))


class TableProvider:
    """Answers queries from recorded results (search_results), matching queries without regard to case and spacing."""

    name = "table"

    def __init__(self, results: DataFrame):
        self.results = results

    def is_available(self) -> bool:
        return True

    def search(self, queries: DataFrame) -> DataFrame:
        same = lambda c: F.lower(collapse(c))
        wanted = queries.select("query", same(F.col("query")).alias("key"), clamp_count(F.col("num_results")).alias("n"))
        rows = self.results.withColumn("key", same(F.col("query_text"))).withColumn("url", unwrap_redirect(F.col("url")))
        rows = rows.join(wanted.select("key").distinct(), "key", "left_semi")
        # The last search of a query is found by aggregation, as one query may hold a large part of all rows.
        latest = rows.groupBy("key").agg(F.max(F.struct("searched_at", "search_id")).alias("last")).select("key", "last.search_id")
        rows = rows.join(latest, ["key", "search_id"])
        ranked = shape_results(rows.join(wanted, "key"), ["query"], "rank_no", F.col("n"))
        return ranked.select("query", F.col("result_rank").alias("rank"), "title", "url", "snippet", "source")


def corpus_search(documents: DataFrame, terms: list[str], count: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ``count`` documents that use the terms most: each term's occurrences are counted, sums compared, ties go to the lower id."""
    text = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    hits = sum((((F.length(text) - F.length(F.replace(text, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long") for t in terms if t), F.lit(0).cast("long"))
    scored = documents.select(F.col(id_column), hits.alias("hits")).where("hits > 0")
    return scored.orderBy(F.col("hits").desc(), F.col(id_column)).limit(count)
