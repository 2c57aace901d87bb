"""Queries over markup written from the columns of speeches, so that SQL can state what must come out of it.

Each speech becomes a page with everything that extraction has to see through: metadata in
tags and linked data, menus, consent and side boxes, hidden text, empty blocks, link-dense
blocks, sign-up forms, lazy images, and the speech itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import collapse
from pagewright.operators import tools
from pagewright.operators.extract import extract
from pagewright.sources.tables import read_table

#: The longest extraction allowed.
MOST_CHARS = 100_000
#: A paragraph that every page has, long enough to be content by itself.
STANDING = (
    "The clerks of the House keep this record of what was said in the chamber, in the order in which it was said, and they set it down in full, with the names of those who "
    "spoke and the number of the sitting, so that it can be read again by all who wish to."
)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _meta(kind: str, name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f'<meta {kind}="{name}" content="'), _escaped(value), F.lit('">')), F.lit(""))


def written_pages(documents: DataFrame, rich: bool = False) -> DataFrame:
    """(page_id, url, html) of each speech; ``rich`` adds a quotation, lists, a table, code, marks and a lazy image."""
    paragraphs = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: collapse(x) != "")
    number = F.col("doc_id").cast("string")
    data = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.array(F.struct(F.lit("").alias("name")), F.struct(F.coalesce("speaker", F.lit("")).alias("name"))).alias("author"), F.struct(F.lit("Other").alias("name")).alias("publisher")))
    head = F.concat(
        F.lit('<!doctype html><html lang="'), _escaped(F.coalesce("lang", F.lit(""))), F.lit('"><head><title> Record of \n the House </title>'),
        _meta("property", "og:title", F.col("agenda_item")), _meta("name", "description", F.concat(F.lit("Speech  "), number)), _meta("property", "og:site_name", F.lit("Record")),
        _meta("property", "article:published_time", F.col("sitting_date").cast("string")), _meta("name", "twitter:image", F.concat(F.lit("https://img.test/"), number, F.lit(".png"))),
        F.lit('<link rel="canonical" href="https://record.test/'), number, F.lit('"><script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script></head>"),
    )
    before = F.lit(
        "<body><nav><a href='/'>Home</a></nav><div class='cookie-banner'>We use cookies here</div><div class='left-rail'><p>Elsewhere</p></div><p style='display: none'>Hidden words</p><p hidden>More of them</p>"
        "<svg><text>Drawn</text></svg><article>"
    )
    heading = F.coalesce(F.concat(F.lit("<h1>"), _escaped(F.nullif(collapse(F.col("agenda_item")), F.lit(""))), F.lit("</h1>")), F.lit(""))
    said = F.array_join(F.transform(paragraphs, lambda x: F.concat(F.lit("<p class='said'>"), _escaped(x), F.lit("</p>"))), "")
    extra = F.concat(
        F.lit("<blockquote><p>As in number "), number, F.lit("</p></blockquote><ul><li>First of "), number, F.lit("</li><li><strong>Second</strong><ol><li>Below</li></ol></li></ul><table><tr><th>Sitting</th><th>Speech</th></tr><tr><td>"),
        _escaped(F.coalesce(collapse(F.col("sitting_no")), F.lit("-"))), F.lit("</td><td>"), number, F.lit("</td></tr></table><pre><code class='language-sql'>select "), number,
        F.lit("</code></pre><p>Read <em>as</em> <a href='https://record.test/"), number, F.lit("' class='x'>speech "), number, F.lit("</a> or <code>x["), number, F.lit("]</code>.</p><img data-src='https://img.test/"), number, F.lit(".png' alt='Seal'>"),
    )
    after = F.lit(
        f"<p>{STANDING}</p><p> </p><div><span></span></div><p><a href='https://other.test/'>Another piece of theirs</a></p><form><input type='email'><button>Join in</button></form></article><footer>All rights reserved</footer></body></html>"
    )
    html = F.concat(head, before, heading, said, *([extra] if rich else []), after)
    return documents.where("doc_id is not null").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://record.test/"), number).alias("url"), html.alias("html"))


def _documents(spark, base) -> DataFrame:
    return read_table(spark, base, "documents")


def written_text(spark, base):
    """Text, score, label, weakness, warnings and error of each written page."""
    rows = extract(written_pages(_documents(spark, base)), max_chars=MOST_CHARS)
    return rows.select("page_id", "text_content", "score", "score_label", "weak_extraction", F.array_join("warnings", ",").alias("warnings"), "error_code")


def written_fields(spark, base):
    """The metadata of each written page, read back from its pretty JSON document, and the number of the document's keys."""
    documents = tools.record_json(extract(written_pages(_documents(spark, base)), max_chars=MOST_CHARS))
    fields = ("title", "byline", "excerpt", "site_name", "lang", "author", "description", "published_date", "image_url", "canonical_url", "output_format")
    keys = F.size(F.json_object_keys("document")).cast("long").alias("keys")
    return documents.select("page_id", *(F.get_json_object("document", f"$.{f}").alias(f) for f in fields), keys)


def written_markdown(spark, base):
    rows = extract(written_pages(_documents(spark, base), rich=True), output_format="markdown", max_chars=MOST_CHARS)
    return rows.select("page_id", "content_body", "error_code")


def written_html(spark, base):
    rows = extract(written_pages(_documents(spark, base), rich=True), output_format="html", max_chars=MOST_CHARS)
    return rows.select("page_id", "content_body", "error_code")


QUERIES = (written_text, written_fields, written_markdown, written_html)
