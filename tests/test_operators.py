import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.operators import logs, pages, search, settle, tools
from pagewright.operators.extract import extract
from pagewright.sources.feeds import feed_items, write_snapshots
from pagewright.streaming import ingest

PAGE = "<html><body><article><p>" + "Boats came home early, and the quay was full of people that day. " * 12 + "</p></article></body></html>"
PAGES = "page_id long, url string, html string, elapsed_ms int"


def test_extract_keeps_failed_rows(spark):
    rows = [(1, "https://a.example/x", PAGE, 10), (2, "http://10.0.0.1/", PAGE, 10), (3, "https://a.example/y", None, 10), (4, "https://a.example/z", PAGE, 99_000), (5, "https://a.example/e", "<p></p>", None), (6, None, None, None)]
    out = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: r["error_code"] for k, r in out.items()} == {1: None, 2: "INVALID_URL", 3: "NAVIGATION_FAILED", 4: "LOAD_TIMEOUT", 5: "READABILITY_EMPTY", 6: "INVALID_URL"}
    assert out[1]["score"] == 10 + 25 + 4 + 15
    assert out[1]["score_label"] and out[2]["score"] is None


def test_extract_edges(spark):
    empty = extract(spark.createDataFrame([], PAGES))
    assert empty.count() == 0
    extra = spark.createDataFrame([(1, "https://a.example", PAGE, 1, "clash", "clash")], PAGES + ", score string, text_content string")
    assert extract(extra).first()["error_code"] is None
    twice = spark.createDataFrame([(1, "https://a.example", PAGE, 1)] * 2, PAGES)
    assert extract(twice).count() == 2
    long = spark.createDataFrame([(1, "https://a.example", "<p>" + "word " * 400_000, 1)], PAGES)
    assert len(extract(long, max_chars=1000).first()["text_content"]) <= 1000
    for bad in ({"output_format": "pdf"}, {"max_chars": 5}, {"wait_until": "never"}):
        with pytest.raises(ValueError):
            extract(twice, **bad)


def test_filter_comes_before_python(spark, capsys):
    extract(spark.createDataFrame([(1, "https://a.example", PAGE, 1)], PAGES)).explain()
    plan = capsys.readouterr().out
    assert plan.index("ArrowEvalPython") < plan.index("Filter", plan.index("ArrowEvalPython"))


def test_clamp(spark):
    rows = spark.createDataFrame([(0.0,), (3.7,), (99.0,), (None,)], "n double").select(search.clamp_count(F.col("n")).alias("c"))
    assert [r["c"] for r in rows.collect()] == [1, 3, 10, 1]


SERP = "<div><a href='/url?q=https%3A%2F%2Fone.example%2F&sa=U'><h3>One</h3></a></div><div><span>Ad</span><a href='https://ad.example'><h3>Ad</h3></a></div><div><a href='https://www.google.com/search?q=1'><h3>Own</h3></a></div><div><a href='https://two.example'><h3>Two</h3></a></div>"


def test_search_tools(spark):
    pages_df = spark.createDataFrame([("boats", SERP, None), ("blocked", "<p>not a robot</p>" + SERP, None), ("none", "<p>x</p>", None)], "query string, html string, address string")
    provider = search.SerpHtmlProvider(pages_df)
    queries = spark.createDataFrame([("boats", 5), ("none", 5), ("", 3)], "query string, num_results int")
    results = tools.search_web(queries, provider)
    assert [(r["query"], r["rank"], r["url"]) for r in results.orderBy("rank").collect()] == [("boats", 1, "https://one.example/"), ("boats", 2, "https://two.example")]
    errors = {r["query"]: r["error_code"] for r in search.serp_errors(pages_df, search.parse_serps(pages_df)).collect()}
    assert errors == {"blocked": "SERP_BLOCKED", "none": "SERP_NO_RESULTS"}
    done = extract(spark.createDataFrame([(1, "http://www.one.example/?utm_source=x", PAGE, 1)], PAGES))
    rows = tools.search_and_extract(results, done).orderBy("rank").collect()
    assert rows[0]["content_length"] > 0 and rows[0]["warnings"] == []
    assert rows[1]["extraction_score"] == 0 and rows[1]["title"] == "Two" and rows[1]["warnings"] == ["EXTRACTION_FAILED: NAVIGATION_FAILED"]
    assert tools.open_result(results, done, 1).count() == 1 and tools.open_result(results, done, 2).count() == 0
    documents = {r["query"]: r["document"] for r in tools.nested(queries, results, tools.search_and_extract(results, done)).collect()}
    assert '"search_results" : [ ]' in documents["none"] and '"rank" : 1' in documents["boats"]

    class Broken:
        def is_available(self):
            raise RuntimeError

    assert tools.health_check(spark, Broken()).first()["search_ready"] is False


def test_table_provider(spark):
    when = datetime.datetime(2024, 1, 1)
    rows = [(1, "Boat  Trip", 1, "a", "https://a.example", None, "web", False, when), (1, "Boat  Trip", 2, "ad", "https://ad.example", None, "web", True, when), (1, "Boat  Trip", 3, "b", "https://b.example", "s", "web", None, when)]
    rows += rows[:1]
    table = spark.createDataFrame(rows, "search_id long, query_text string, rank_no int, title string, url string, snippet string, source string, is_ad boolean, searched_at timestamp")
    got = search.TableProvider(table).search(spark.createDataFrame([("boat trip", 9)], "query string, num_results int")).orderBy("rank").collect()
    assert [(r["rank"], r["title"]) for r in got] == [(1, "a"), (2, "b")]


def test_corpus_search(spark):
    docs = spark.createDataFrame([(1, "Boat boat quay"), (2, "quay"), (3, None), (4, ""), (5, "boat quay boat")], "doc_id long, text string")
    assert [(r[0], r[1]) for r in search.corpus_search(docs, ["boat", "quay"], 2).collect()] == [(1, 3), (5, 3)]


def poll(*rows):
    return [("p", *r) for r in rows]


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        (poll((0, 4000, False, 0)), ("precheck", 0, 4000)),
        (poll((0, 300, False, 0), (100, 300, False, 0), (200, 300, False, 0), (300, 300, False, 0)), ("stabilized", 300, 300)),
        (poll((0, 10, False, 0), (100, 300, True, 0), (200, 300, False, 0), (300, 300, False, 0), (400, 300, False, 0)), ("stabilized", 400, 300)),
        (poll((0, 10, False, 0), (100, 20, True, 0), (200, 30, True, 0)), ("timeout", 200, 30)),
        (poll((0, 50, False, 0), (100, 50, False, 0), (200, 50, False, 0), (300, 50, False, 0), (400, 50, False, 0)), ("timeout", 400, 50)),
    ],
)
def test_settle(spark, rows, wanted):
    seen = spark.createDataFrame(rows, "page_id string, t_ms long, text_length int, mutated boolean, in_flight int")
    assert tuple(settle.settle(seen, settle.SettleOptions()).first())[1:] == wanted


def test_settle_modes(spark):
    assert settle.SettleOptions.for_mode("load", 1200, 3000).max_wait_ms == 500
    idle = settle.SettleOptions.for_mode("network-idle-like", 4000, 15_000)
    rows = [("p", t, 900, False, int(t <= 600)) for t in range(0, 2000, 100)]
    seen = spark.createDataFrame(rows, "page_id string, t_ms long, text_length int, mutated boolean, in_flight int")
    assert tuple(settle.settle(seen, idle).first()) == ("p", "stabilized", 1100, 900)


def test_logs(spark):
    t = datetime.datetime(2024, 1, 1)
    row = lambda i, level, code=None: (i, level, t, t, "r", "search_web", "q", None, 10, None, 3, 0, code, "m")
    table = spark.createDataFrame(
        [row(1, "WARN"), row(2, "warn "), row(3, "error", "SERP_BLOCKED"), row(4, "debug"), row(5, "odd")],
        "log_id long, log_level string, logged_at timestamp, received_at timestamp, request_id string, tool_name string, query_text string, url string, elapsed_ms int, extraction_score int, result_count int, warning_count int, error_code string, message string",
    )
    assert logs.at_least(table, "warn").count() == 3
    assert logs.distinct_lines(table).count() == 4
    assert logs.requests(table).first()["lines"] == 4
    assert logs.tool_report(table).first()["failed"] == 1


def test_audit_report(spark):
    rows = [("A", True, (70, 0, False)), ("A", True, (70, 2, True)), ("A", False, None), ("B", None, None)]
    table = spark.createDataFrame(rows, "tier string, success boolean, diagnostics struct<score int, noise_hits int, weak_extraction boolean>")
    got = {r["tier"]: tuple(r)[1:] for r in pages.audit_report(table).collect()}
    assert got == {"A": (3, 2, 1, 1, 1, 1, 33), "B": (1, 0, 0, 0, 0, 1, 0)}


def test_feeds_and_snapshots(spark, tmp_path):
    item = "<item><title><![CDATA[%s]]></title><ht:news_item_url> https://a.example/1 </ht:news_item_url><ht:news_item_url>x</ht:news_item_url></item>"
    feeds = spark.createDataFrame([(1, "<rss>" + item % "one" + item % "" + item % "two" + "</rss>"), (2, None)], "feed_id int, xml string")
    assert [(r["item_no"], r["keyword"], r["traffic"], r["urls"]) for r in feed_items(feeds).orderBy("item_no").collect()] == [(1, "one", "0", ["https://a.example/1"]), (2, "two", "0", ["https://a.example/1"])]
    write_snapshots(spark.createDataFrame([("https://www.a.example/1", "<p>x</p>"), (None, "y")], "url string, html string"), str(tmp_path / "snap"))
    back = spark.read.json(str(tmp_path / "snap"))
    assert back.count() == 1 and back.first()["snapshot"].startswith("a.example-")


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "https://a.example/x", PAGE, t), (2, "http://www.a.example/x#f", PAGE, t), (3, "https://a.example/y", PAGE, t)]
    spark.createDataFrame(rows, ingest.PAGES).write.parquet(str(tmp_path / "in"))
    query = ingest.extract_stream(ingest.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
