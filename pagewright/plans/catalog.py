"""The core's queries by name, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text, urls
from pagewright.functions.markup import tag_link_density
from pagewright.operators import logs, pages, search, settle, tools
from pagewright.operators.extract import extract
from pagewright.plans import oracle, oracle_written, written
from pagewright.sources import feeds
from pagewright.sources.tables import read_table

#: Words of the corpus search query.
TERMS = ("harbour", "pensions", "railway")
TOP = 10
#: The longest extraction allowed, so that content, scores and labels come from whole texts.
MOST_CHARS = 100_000


def _pages(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "extraction_results")


def _results(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "search_results")


def url_policy(spark, base):
    return pages.policy(_pages(spark, base))


def strip_tracking(spark, base):
    return _pages(spark, base).select("result_id", urls.strip_tracking(F.col("url")).alias("clean_url"))


def canonical_dedupe(spark, base):
    return pages.latest_pages(_pages(spark, base))


def unwrap_redirect(spark, base):
    return _results(spark, base).select("search_id", "rank_no", urls.unwrap_redirect(F.col("url")).alias("target"))


def domain_counts(spark, base):
    return _pages(spark, base).groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


def search_urls(spark, base):
    one = _results(spark, base).groupBy("search_id").agg(F.min("query_text").alias("query_text"), F.min("locale").alias("locale"), F.min("region_code").alias("region_code"))
    return one.select("search_id", urls.search_url(text.collapse(F.col("query_text")), F.lit(10), F.col("locale"), F.col("region_code")).alias("address"))


def page_titles(spark, base):
    lang = F.nullif(F.lower(F.regexp_extract("lang", r"^([A-Za-z]{2,3})", 1)), F.lit(""))
    return _pages(spark, base).select("result_id", text.clean_string(F.col("title")).alias("clean_title"), lang.alias("base_lang"))


def page_link_density(spark, base):
    return _pages(spark, base).select("result_id", tag_link_density(F.col("cleaned_html")).alias("link_density"))


def page_quality(spark, base):
    return pages.page_scores(_pages(spark, base))


def label_histogram(spark, base):
    return page_quality(spark, base).groupBy("page_label").agg(F.count("*").alias("pages"), F.min("page_score").alias("least_score"), F.max("page_score").alias("most_score"))


def recorded_scores(spark, base):
    return _pages(spark, base).groupBy("score_label").agg(F.count("*").alias("pages"), F.count_if("weak_extraction").alias("weak_pages"), F.sum(F.size("warnings").cast("long")).alias("warning_count"))


def doc_quality(spark, base):
    docs = read_table(spark, base, "documents")
    none = F.lit(None).cast("string")
    return pages.scored(docs, "doc_id", F.col("text"), F.lit(0.0), F.col("agenda_item"), F.col("speaker"), none, F.col("sitting_date"))


def boilerplate_hits(spark, base):
    return _pages(spark, base).select("result_id", text.boilerplate_hits(F.coalesce("text_content", F.lit(""))).alias("hits"))


def noise_hits(spark, base):
    return _pages(spark, base).select("result_id", text.noise_count(F.coalesce("text_content", F.lit(""))).alias("noise_hits"))


def noise_context(spark, base):
    return pages.noise_rows(_pages(spark, base))


def paragraph_stats(spark, base):
    said = F.coalesce("text_content", F.lit(""))
    return _pages(spark, base).select("result_id", text.paragraph_count(said).alias("paragraphs"), text.average_sentence_words(said).alias("avg_sentence_words"))


def text_sample(spark, base):
    return _pages(spark, base).select("result_id", F.array_join(text.text_sample(text.bare_text(F.coalesce("cleaned_html", F.lit("")))), " | ").alias("sample"))


def short_hash(spark, base):
    return _pages(spark, base).select("result_id", F.concat(urls.domain(F.col("url")), F.lit("-"), urls.short_hash(F.col("url"))).alias("snapshot"))


def normalize_docs(spark, base):
    """The operator with its limit: NFKC, normalised lines, cut at a word."""
    return read_table(spark, base, "documents").select("doc_id", text.normalize_text(F.col("text"), 400).alias("short_text"))


def normalize_texts(spark, base):
    """The operator over whole texts: NFKC, normalised lines, nothing cut."""
    return read_table(spark, base, "documents").select("doc_id", text.normalize_text(F.col("text"), None).alias("normal_text"))


def search_corpus_topk(spark, base):
    return search.corpus_search(read_table(spark, base, "documents"), list(TERMS), TOP)


def search_ranks(spark, base):
    shaped = search.shape_results(_results(spark, base), ["search_id"], "rank_no", F.lit(5))
    return shaped.select("search_id", "result_rank", "rank_no", urls.unwrap_redirect(F.col("url")).alias("target"))


def _linked(spark, base, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shaped results and the latest extraction of each canonical URL, ready for the tools.

    The latest one is chosen by aggregation with only the columns wanted, so texts are
    shuffled at most once, and by the key that they are joined on.
    """
    shaped = search.shape_results(_results(spark, base), ["search_id"], "rank_no", F.lit(5))
    results = shaped.select(F.col("search_id").alias("query"), F.col("result_rank").alias("rank"), "title", urls.unwrap_redirect(F.col("url")).alias("url"), "snippet")
    body = F.col("content_body") if with_text else F.lit(None).cast("string")
    row = F.struct("result_id", "url", "title", "excerpt", body.alias("content_body"), F.length("text_content").alias("text_length"), "score", "warnings")
    order = F.struct("fetched_at", (-F.col("result_id")).alias("first"))
    pages_ = _pages(spark, base).where("url is not null").withColumn("page", urls.canonical(F.col("url")))
    if with_text:  # only pages that were searched for carry their text through the aggregation
        pages_ = pages_.join(results.select(urls.canonical(F.col("url")).alias("page")).distinct(), "page", "left_semi")
    latest = pages_.groupBy("page").agg(F.max_by(row, order).alias("last"))
    return results, latest.select("last.*").withColumn("error_code", F.lit(None).cast("string"))


def open_result_rank(spark, base):
    results, latest = _linked(spark, base)
    opened = tools.open_result(results, latest, 1)
    return opened.select(F.col("query").alias("search_id"), "result_id", "score")


def open_result_outcomes(spark, base):
    """Rank 5 of each search, so that many lack it."""
    results, latest = _linked(spark, base)
    searches = _results(spark, base).select(F.col("search_id").alias("query"))
    return tools.open_outcomes(searches, results, latest, 5).withColumnRenamed("query", "search_id")


def search_web(spark, base):
    """Every query as it was typed, for one to twelve results."""
    typed = _results(spark, base).select(F.col("query_text").alias("query")).distinct()
    return tools.search_web(typed.withColumn("num_results", F.pmod(F.length("query"), F.lit(13))), search.TableProvider(_results(spark, base)))


def sub_resources(spark, base):
    """Whether each page may load its image, itself as a document, and its canonical address as a font or a script."""
    kinds = F.array(*(F.struct(F.lit(k).alias("resource_type"), F.col(c).alias("address")) for k, c in (("image", "image_url"), ("document", "url"), ("font", "canonical_url"), ("script", "canonical_url"))))
    rows = _pages(spark, base).select("result_id", F.explode(kinds).alias("r")).select("result_id", "r.*").where("address is not null")
    free = urls.may_load(F.col("address"), F.col("resource_type"), block_images=False, block_media=False, block_fonts=False)
    return rows.select("result_id", "resource_type", urls.may_load(F.col("address"), F.col("resource_type")).alias("may_load"), free.alias("may_load_all"))


def nested_results(spark, base):
    """The documents of searches read back: what is listed and extracted in rank order; searches without results have empty lists."""
    results, latest = _linked(spark, base)
    searches = _results(spark, base).select(F.col("search_id").alias("query")).distinct()
    documents = tools.nested(searches, results, tools.search_and_extract(results, latest))
    listed, got = "array<struct<rank int, title string, url string>>", "array<struct<rank int, title string, content_length long, extraction_score long>>"
    read = documents.select(F.col("query").alias("search_id"), F.from_json("document", f"query long, search_results {listed}, extracted_results {got}").alias("d"))
    ranks = F.array_join(F.transform("d.search_results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["url"])), " ")
    pulled = F.array_join(F.transform("d.extracted_results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["content_length"].cast("string"), r["extraction_score"].cast("string"))), " ")
    return read.select("search_id", F.size("d.search_results").cast("long").alias("listed"), ranks.alias("ranks"), pulled.alias("extracted"))


def unextracted_urls(spark, base):
    """Addresses that results or log lines name and no extraction holds."""
    results, latest = _linked(spark, base)
    logged = read_table(spark, base, "log_entries").where("url is not null").select("url")
    named = results.select("url").unionByName(logged).select(urls.canonical(F.col("url")).alias("canonical")).distinct()
    return named.join(latest.select(urls.canonical(F.col("url")).alias("canonical")), "canonical", "left_anti")


def snapshot_records(spark, base):
    """What each page's snapshot is expected to hold, phrases joined."""
    rows = feeds.snapshot_records(_pages(spark, base).select("result_id", "url", F.col("cleaned_html").alias("html")))
    return rows.select("snapshot", "url", "domain", F.array_join("with", " | ").alias("wanted"), F.array_join("without", " | ").alias("unwanted"), "min_quality")


def fetch_search_extract(spark, base):
    results, latest = _linked(spark, base)
    rows = tools.search_and_extract(results, latest)
    return rows.select(F.col("query").alias("search_id"), "rank", "title", "content_length", "extraction_score", F.array_join("warnings", ",").alias("warnings"))


def fetch_search_documents(spark, base):
    results, latest = _linked(spark, base, with_text=True)
    return tools.nested(results, results, tools.search_and_extract(results, latest))


def failed_extractions(spark, base):
    results, latest = _linked(spark, base)
    keyed = results.select(urls.canonical(F.col("url")).alias("canonical")).distinct()
    return keyed.join(latest.select(urls.canonical(F.col("url")).alias("canonical")), "canonical", "left_anti")


def tier_audit(spark, base):
    return pages.audit_report(read_table(spark, base, "audit_entries"))


def latest_audits(spark, base):
    return pages.latest_audits(read_table(spark, base, "audit_entries"))


def audit_rollup(spark, base):
    audits = read_table(spark, base, "audit_entries")
    return audits.rollup("tier", "category").agg(F.count("*").alias("entries"), F.count_if("success").alias("succeeded"), F.grouping_id().cast("int").alias("grouping_level"))


def log_levels(spark, base):
    rows = logs.at_least(read_table(spark, base, "log_entries"), "warn")
    return rows.groupBy(F.lower(F.trim("log_level")).alias("level_name"), "error_code").agg(F.count("*").alias("lines"))


def log_requests(spark, base):
    return logs.requests(read_table(spark, base, "log_entries"))


def tool_report(spark, base):
    return logs.tool_report(read_table(spark, base, "log_entries"))


def error_messages(spark, base):
    rows = logs.distinct_lines(read_table(spark, base, "log_entries")).where("error_code is not null")
    return rows.select("log_id", logs.client_message(F.col("error_code"), F.col("message")).alias("client_message"))


def search_gaps(spark, base):
    return logs.search_gaps(_results(spark, base), 3600)


def _request_events(spark, base) -> tuple[DataFrame, DataFrame]:
    """Log lines of requests (page_id, t_ms, ...), and their starts and ends; a line with an elapsed time ends what began so long before."""
    lines = logs.distinct_lines(read_table(spark, base, "log_entries")).where("request_id is not null and logged_at is not null")
    lines = lines.withColumns({"page_id": F.col("request_id"), "at": F.unix_millis(F.col("logged_at").cast("timestamp"))})
    ends = lines.where("elapsed_ms is not null")
    events = ends.select("page_id", (F.col("at") - F.col("elapsed_ms")).cast("long").alias("t_ms"), (F.col("log_id") * 2).alias("seq"), F.lit(1).alias("delta")).unionByName(
        ends.select("page_id", F.col("at").alias("t_ms"), (F.col("log_id") * 2 + 1).alias("seq"), F.lit(-1).alias("delta"))
    )
    opened = lines.where("elapsed_ms is null").select("page_id", F.col("at").alias("t_ms"), (F.col("log_id") * 2).alias("seq"), F.lit(1).alias("delta"))
    return lines, events.unionByName(opened)


def open_requests(spark, base):
    """The number of open calls of each request after each start and end."""
    return settle.in_flight(_request_events(spark, base)[1])


def settle_requests(spark, base):
    """Requests as pages: each log line is a poll, with the length of its message as the text seen so far and the calls still open then."""
    lines, events = _request_events(spark, base)
    counts = settle.in_flight(events).groupBy("page_id", "t_ms").agg(F.max_by("in_flight", "seq").alias("in_flight"))
    seen = lines.groupBy("page_id", F.col("at").alias("t_ms")).agg(F.max(F.length("message")).alias("text_length"), F.max(F.col("error_code").isNotNull()).alias("mutated"))
    return settle.settle(seen.join(counts, ["page_id", "t_ms"], "left"), settle.SettleOptions(max_wait_ms=60_000, min_text_length=10, fast_path=60, stable_polls=1, network_idle=True))


def _as_pages(spark, base) -> DataFrame:
    return _pages(spark, base).select(F.col("result_id").alias("page_id"), "url", "final_url", F.col("cleaned_html").alias("html"))


def extract_text(spark, base):
    return extract(_as_pages(spark, base))


def extract_markdown(spark, base):
    return extract(_as_pages(spark, base), output_format="markdown", max_chars=MOST_CHARS).select("page_id", "content_body", "score", "error_code")


def extract_html(spark, base):
    return extract(_as_pages(spark, base), output_format="html", max_chars=MOST_CHARS).select("page_id", "content_body", "score", "error_code")


def extract_json(spark, base):
    return tools.record_json(extract(_as_pages(spark, base), max_chars=MOST_CHARS))


def _card(title: Column, url: Column, display: Column, snippet: Column, ad: Column) -> Column:
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(
        F.lit("<div class='card'>"), F.when(ad, F.lit("<span>Sponsored</span>")).otherwise(F.lit("")), F.lit('<a href="'), escape(url), F.lit('"><h3>'), escape(title), F.lit("</h3></a><cite>"),
        F.coalesce(escape(display), F.lit("")), F.lit("</cite><div class='s'>"), F.coalesce(escape(snippet), F.lit("")), F.lit("</div></div>"),
    )


def serp_pages(results: DataFrame) -> DataFrame:
    """Recorded results written back as results pages: (query, html, address)."""
    rows = results.where("title is not null and url is not null").dropDuplicates(["search_id", "rank_no"])
    card = _card(F.col("title"), F.col("url"), F.col("display_url"), F.col("snippet"), F.coalesce("is_ad", F.lit(False)))
    cards = F.array_sort(F.collect_list(F.struct("rank_no", card.alias("card"))))
    page = F.concat(F.lit("<html><body>"), F.array_join(F.transform(cards, lambda c: c["card"]), ""), F.lit("</body></html>"))
    return rows.groupBy(F.col("search_id").alias("query")).agg(page.alias("html")).withColumn("address", F.lit("https://www.google.com/search?q=x"))


def _dressed(title: Column, url: Column, display: Column, snippet: Column, form: Column) -> Column:
    """A result in one of five forms: plain, with a badge, with a labelled sign, its snippet beside the link, or without address line."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit('<a href="'), escape(url), F.lit('"><h3>'), escape(title), F.lit("</h3></a>"))
    cite, said = F.concat(F.lit("<cite>"), escape(F.coalesce(display, F.lit(""))), F.lit("</cite>")), escape(F.coalesce(snippet, F.lit("")))
    return (
        F.when(form == 1, F.concat(F.lit("<li><label> AD </label>"), link, cite, F.lit("<span>"), said, F.lit("</span></li>")))
        .when(form == 2, F.concat(F.lit("<div><i aria-label='Sponsored result'></i>"), link, cite, F.lit("<div>"), said, F.lit("</div></div>")))
        .when(form == 3, F.concat(F.lit("<section><b>"), link, F.lit("</b><span>"), said, F.lit("</span>"), cite, F.lit("</section>")))
        .when(form == 4, F.concat(F.lit("<article>"), link, F.lit("<div>short</div><span>"), said, F.lit("</span></article>")))
        .otherwise(F.concat(F.lit("<div>"), link, cite, F.lit("<div>"), said, F.lit("</div></div>")))
    )


def serp_cards(spark, base):
    """Results written in every form and read again, with address lines and snippets; ads in two forms go."""
    rows = _results(spark, base).where("title is not null and url is not null").dropDuplicates(["search_id", "rank_no"])
    form = F.when(F.coalesce("is_ad", F.lit(False)), F.col("rank_no") % 2 + 1).otherwise(F.element_at(F.array(F.lit(0), F.lit(3), F.lit(4)), (F.col("rank_no") % 3 + 1).cast("int")))
    cards = F.array_sort(F.collect_list(F.struct("rank_no", _dressed(F.col("title"), F.col("url"), F.col("display_url"), F.col("snippet"), form).alias("card"))))
    page = F.concat(F.lit("<html><body>"), F.array_join(F.transform(cards, lambda c: F.concat(F.lit("<div>"), c["card"], F.lit("</div>"))), ""), F.lit("</body></html>"))
    shown = rows.groupBy(F.col("search_id").alias("query")).agg(page.alias("html")).withColumn("address", F.lit("https://www.google.com/search?q=x"))
    return search.parse_serps(shown).select(F.col("query").alias("search_id"), "position", "title", F.col("url").alias("target"), "display_url", "snippet")


def serp_roundtrip(spark, base):
    parsed = search.parse_serps(serp_pages(_results(spark, base)))
    return parsed.select(F.col("query").alias("search_id"), "position", "title", F.col("url").alias("target"))


def serp_blocks(spark, base):
    """Results pages as they are, and with each sign of a block or none of a result, by turns; a sign counts even where results stand beside it."""
    shown, turn = serp_pages(_results(spark, base)), F.col("query") % 8
    plus = lambda extra: F.replace(F.col("html"), F.lit("</body>"), F.lit(f"{extra}</body>"))
    html = (
        F.when(turn == 1, plus("<iframe src='https://www.google.com/recaptcha/api'></iframe>")).when(turn == 2, plus("<form><input name='captcha'></form>"))
        .when(turn == 3, F.lit("<html><body><p>Our systems have detected\n unusual traffic.</p></body></html>")).when(turn == 4, F.lit(None)).when(turn == 5, F.lit("<html><body><p>Nothing matches.</p></body></html>"))
        .otherwise(F.col("html"))
    )
    address = F.when(turn == 0, F.lit("https://www.google.com/sorry/index?q=x")).otherwise(F.col("address"))
    both = shown.withColumns({"html": html, "address": address})
    return search.serp_errors(both, search.parse_serps(both))


def health(spark, base):
    return tools.health_check(spark, search.TableProvider(_results(spark, base)))


_ALL = (
    page_quality, url_policy, strip_tracking, canonical_dedupe, unwrap_redirect, domain_counts, search_urls, page_titles, page_link_density, label_histogram, recorded_scores, doc_quality,
    boilerplate_hits, noise_hits, noise_context, paragraph_stats, text_sample, short_hash, normalize_docs, normalize_texts, search_corpus_topk, search_ranks, open_result_rank, fetch_search_extract,
    fetch_search_documents, failed_extractions, tier_audit, latest_audits, audit_rollup, log_levels, log_requests, tool_report, error_messages, search_gaps, settle_requests, extract_text,
    extract_markdown, extract_html, extract_json, serp_roundtrip, serp_blocks, health, open_result_outcomes, search_web, sub_resources, nested_results, unextracted_urls, open_requests, serp_cards, snapshot_records,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_ALL, *written.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | oracle_written.statements()
