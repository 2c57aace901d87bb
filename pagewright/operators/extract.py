"""Extraction of pages: URL policy, one Arrow-batched document stage, then scoring in Catalyst.

Catalyst cannot push a filter below a Python stage, so the URL policy is applied before it:
pages that may not be fetched never reach Python. ``fields`` prunes what the stage renders.
"""

from __future__ import annotations

import signal
import threading
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.dom.cleanup import clean_tree
from pagewright.dom.content import article_of, is_readable
from pagewright.dom.metadata import FIELDS, metadata_of
from pagewright.dom.postclean import post_clean_tree
from pagewright.dom.render import render_tree, tree_link_density
from pagewright.dom.tree import Node, body_of, parse
from pagewright.functions import quality
from pagewright.functions.text import boilerplate_hits, sentence_count
from pagewright.functions.urls import url_error
from pagewright.session import spread

FORMATS = ("text", "markdown", "html")
WAITS = ("load", "domcontentloaded", "network-idle-like")

_STAGE = T.StructType(
    [
        *(T.StructField(f"meta_{name}", T.StringType()) for name in FIELDS),
        T.StructField("article_title", T.StringType()),
        T.StructField("byline", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("content_body", T.StringType()),
        T.StructField("cleaned_html", T.StringType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("link_density", T.DoubleType()),
        T.StructField("stage_warnings", T.ArrayType(T.StringType())),
        T.StructField("stage_error", T.StringType()),
    ]
)


def extract_page(source: str | None, output_format: str, limit: int, strict_parity: bool = True) -> tuple:
    """All document stages of one page; never raises, so that one broken page cannot fail a task.

    With ``strict_parity`` the content stands in one more block, as readers' output does; a
    page whose whole text matches two boilerplate phrases is then dropped as a block.
    """
    if source is None:
        return (*[None] * len(FIELDS), None, None, None, None, None, None, None, 0.0, [], "NAVIGATION_FAILED")
    try:
        root = parse(source)
        meta = metadata_of(root)
        clean_tree(root)
        warnings = [] if is_readable(root) else ["READABILITY_UNCERTAIN"]
        article = article_of(root, meta["title"], meta["language"])
        if article is None:
            return (*meta.values(), None, None, None, None, "", "", "", 0.0, [*warnings, "READABILITY_FAILED"], "READABILITY_EMPTY")
        holder, wrapper = Node("body"), Node("div")
        for node in article.node.children if article.node.tag == "body" or not strict_parity else [article.node]:
            (wrapper if strict_parity else holder).append(node)
        if strict_parity:
            holder.append(wrapper)
        cleaned, more = post_clean_tree(holder)
        final = body_of(parse(cleaned))
        density = tree_link_density(final)
        content, text = render_tree(final, output_format, limit)
        error = None if text else "READABILITY_EMPTY"
        return (*meta.values(), article.title, article.byline, article.excerpt, article.lang, content, cleaned, text, density, [*warnings, *more], error)
    except Exception as problem:  # any defect of a page becomes data
        return (*[None] * len(FIELDS), None, None, None, None, None, None, None, 0.0, [type(problem).__name__], "INTERNAL_ERROR")


class _Late(BaseException):
    """The deadline of a page; no Exception, so that no repair on the way takes it for its own."""


@contextmanager
def deadline(seconds: float):
    """Raise `_Late` in the main thread after ``seconds``; elsewhere, where no timer can interrupt, nothing happens."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise _Late

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def timely_page(source: str | None, output_format: str, limit: int, strict_parity: bool, seconds: float) -> tuple:
    """`extract_page`, or LOAD_TIMEOUT for a page that takes longer, so that one page cannot hold its task."""
    try:
        with deadline(seconds):
            return extract_page(source, output_format, limit, strict_parity)
    except _Late:
        return (*[None] * len(FIELDS), None, None, None, None, None, None, None, 0.0, [], "LOAD_TIMEOUT")


def document_stage(output_format: str, limit: int, strict_parity: bool = True, timeout_ms: int = 15_000):
    names = [f.name for f in _STAGE]

    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([timely_page(h if isinstance(h, str) else None, output_format, limit, strict_parity, timeout_ms / 1000) for h in html], columns=names)

    return F.pandas_udf(run, _STAGE).asNondeterministic()


def extract(pages: DataFrame, output_format: str = "text", max_chars: int = 12_000, timeout_ms: int = 15_000, wait_until: str = "load", settle_ms: int = 1200, strict_parity: bool = True) -> DataFrame:
    """One row for each of ``pages`` (page_id, url, html, and optional final_url and elapsed_ms): the extraction, or its error code.

    Columns: page_id, url, final_url, output_format, content_body, cleaned_html,
    text_content, title, byline, excerpt, site_name, lang, author, description,
    published_date, image_url, canonical_url, score, score_label, weak_extraction, warnings,
    error_code. A null html is NAVIGATION_FAILED, a URL against policy INVALID_URL, a load
    that took longer than ``timeout_ms``, in loading or in the document stage, LOAD_TIMEOUT, a page without text
    READABILITY_EMPTY; such rows have null figures. Other columns of ``pages`` are ignored.
    """
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {FORMATS}")
    if wait_until not in WAITS:
        raise ValueError(f"wait_until must be one of {WAITS}")
    if not (100 <= max_chars <= 100_000 and 1000 <= timeout_ms <= 60_000 and 0 <= settle_ms <= 30_000):
        raise ValueError("max_chars, timeout_ms or settle_ms is out of range")
    elapsed = F.col("elapsed_ms") if "elapsed_ms" in pages.columns else F.lit(None).cast("int")
    final = F.col("final_url") if "final_url" in pages.columns else F.col("url")
    early = F.coalesce(url_error(F.col("url")), F.when(elapsed > timeout_ms, F.lit("LOAD_TIMEOUT")))
    inputs = pages.select("page_id", "url", final.alias("final_url"), "html", early.alias("early"))
    refused = inputs.where(F.col("early").isNotNull())
    loaded = spread(inputs.where(F.col("early").isNull())).withColumn("d", document_stage(output_format, max_chars, strict_parity, timeout_ms)("html")).select("page_id", "url", "final_url", "d.*")
    text = F.col("text_content")
    failed = F.col("stage_error").isNotNull()
    title = F.coalesce(F.nullif("article_title", F.lit("")), F.col("meta_title"))
    points = quality.score(
        F.length(text), sentence_count(text), F.col("link_density"), boilerplate_hits(text), title.isNotNull(), F.col("byline").isNotNull(),
        F.col("excerpt").isNotNull(), F.col("meta_published_date").isNotNull(), F.lit(True),
    )
    scored = loaded.withColumn("score", F.when(~failed, points))
    good = scored.select(
        "page_id", "url", "final_url", F.lit(output_format).alias("output_format"), "content_body", "cleaned_html", "text_content", title.alias("title"), "byline", "excerpt",
        F.col("meta_site_name").alias("site_name"), F.coalesce("lang", "meta_language").alias("lang"), F.col("meta_author").alias("author"), F.col("meta_description").alias("description"),
        F.col("meta_published_date").alias("published_date"), F.col("meta_image_url").alias("image_url"), F.col("meta_canonical_url").alias("canonical_url"), "score",
        F.when(~failed, quality.label(F.col("score"))).alias("score_label"), F.when(~failed, quality.weak(F.col("score"), F.length(text), F.col("link_density"))).alias("weak_extraction"),
        quality.merged_warnings(F.col("stage_warnings")).alias("warnings"), F.col("stage_error").alias("error_code"),
    )
    types = {f.name: f.dataType for f in good.schema}
    given = {"page_id", "url", "final_url"}
    blank = refused.select(*(F.col(c) if c in given else F.lit(output_format).alias(c) if c == "output_format" else F.col("early").alias(c) if c == "error_code" else F.lit(None).cast(types[c]).alias(c) for c in good.columns))
    return good.unionByName(blank)
