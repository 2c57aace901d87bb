"""Names for SQL: table functions on results pages and page blocks, and Arrow functions on text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.dom.content import link_share, squeezed
from pagewright.dom.render import render
from pagewright.dom.serp import rows_of
from pagewright.dom.tree import body_of, parse
from pagewright.functions.text import nfkc


@F.udtf(returnType="position int, title string, href string, display_url string, snippet string, is_ad boolean")
class SerpResults:
    """serp_results(html): the headed links of a results page in order; none for null."""

    def eval(self, html: str):
        for position, row in enumerate(rows_of(html)[1] if html else [], 1):
            yield position, row["title"], row["href"], row["display_url"], row["snippet"], row["is_ad"]


@F.udtf(returnType="block_no int, tag string, text string, link_share double")
class PageBlocks:
    """page_blocks(html): innermost text blocks of a page in order with their share of link text; none for null."""

    TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td", "th", "dd", "dt", "small", "figcaption")

    def eval(self, html: str):
        number = 0
        for node in body_of(parse(html)).elements() if html else ():
            if node.tag in self.TAGS and node.find(*self.TAGS) is None and (words := squeezed(node)):
                number += 1
                yield number, node.tag, words, round(link_share(node), 6)


@F.pandas_udf(T.StringType())
def plain_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: render(h, "text", 10**9)[1] if isinstance(h, str) else None)


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: render(h, "markdown", 10**9)[0] if isinstance(h, str) else None)


def register(spark: SparkSession) -> None:
    """Make serp_results, page_blocks, nfkc, plain_text and markdown usable in ``spark.sql``."""
    spark.udtf.register("serp_results", SerpResults)
    spark.udtf.register("page_blocks", PageBlocks)
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("plain_text", plain_text)
    spark.udf.register("markdown", markdown)
