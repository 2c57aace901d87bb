import pytest
from pyspark.sql import functions as F

from pagewright.config import Settings, flag, whole
from pagewright.functions import quality, text, urls
from pagewright.functions.markup import tag_link_density


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "code"),
    [
        ("https://river.example/a", None),
        ("http://www.river.example:8080/x?y=1#z", None),
        ("ftp://river.example/a", "INVALID_URL"),
        ("not a url", "INVALID_URL"),
        ("http://127.0.0.1/", "INVALID_URL"),
        ("http://172.20.1.1/", "INVALID_URL"),
        ("http://172.32.1.1/", None),
        ("http://LOCALHOST/", "INVALID_URL"),
        ("http://[::1]/", "INVALID_URL"),
        ("http://[fd00::1]/", "INVALID_URL"),
        ("http://fdx.example/", None),
        (None, "INVALID_URL"),
        ("", "INVALID_URL"),
    ],
)
def test_policy(spark, url, code):
    assert one(spark, url, urls.url_error) == code


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://a.example/x?utm_source=m&id=7&fbclid=q#top", "https://a.example/x?id=7#top"),
        ("https://a.example/x?utm_source=m", "https://a.example/x"),
        ("https://a.example/x?utm_sources=m", "https://a.example/x?utm_sources=m"),
        ("nothing?utm_source=1", "nothing?utm_source=1"),
    ],
)
def test_tracking(spark, url, wanted):
    assert one(spark, url, urls.strip_tracking) == wanted


def test_redirects_and_hosts(spark):
    assert one(spark, "https://www.google.com/url?q=https%3A%2F%2Fa.example%2Fb&sa=U", urls.unwrap_redirect) == "https://a.example/b"
    assert one(spark, "https://www.google.com/url?url=https%3A%2F%2Fa.example", urls.unwrap_redirect) == "https://a.example"
    assert one(spark, "https://a.example/url2?q=x", urls.unwrap_redirect) == "https://a.example/url2?q=x"
    assert one(spark, "https://www.google.com/search?q=x", urls.is_engine_page) is True
    assert one(spark, "https://a.example/search", urls.is_engine_page) is False
    assert one(spark, "garbage", urls.domain) == "unknown"
    assert one(spark, "http://m.a.example/x/?gclid=1#f", urls.canonical) == "https://a.example/x"
    assert one(spark, "/url?q=1", urls.absolute) == "https://www.google.com/url?q=1"
    assert one(spark, "#x", urls.absolute) is None


def test_text(spark):
    assert one(spark, "a  b\n\n c ", text.collapse) == "a b c"
    assert one(spark, " \n", text.clean_string) is None
    assert one(spark, "one two three", lambda c: text.truncate_words(c, 9)) == "one two"
    assert one(spark, "one two", lambda c: text.truncate_words(c, 3)) == "one"
    assert one(spark, "unbroken", lambda c: text.truncate_words(c, 4)) == ""
    assert one(spark, "ﬁ ½", lambda c: text.normalize_text(c, 100)) == "fi 1⁄2"
    assert one(spark, "a \n\n\n\n b\t c", text.normalize_lines) == "a\n\nb c"
    assert one(spark, "One. Two! Three?! x.y", text.sentence_count) == 3
    assert one(spark, "Copyright. Join our newsletter! copyrighté", text.boilerplate_hits) == 3
    assert one(spark, "x" * 51 + "\n\n" + "y" * 50, text.paragraph_count) == 1
    assert one(spark, "One two three. Four five!", text.average_sentence_words) == 3
    assert one(spark, "no end", text.average_sentence_words) == 0
    hits = one(spark, "Please CLICK\nHERE now", text.noise_hits)
    assert [(h["matched_text"], h["near_text"]) for h in hits] == [("CLICK\nHERE", "Please CLICK HERE now")]
    assert one(spark, "<p>ab <a href='x'>cd</a></p>", tag_link_density) == 0.4


def test_score(spark):
    def score(length, sentences, density, hits, flags=True):
        values = [F.lit(x) for x in (length, sentences, density, hits)] + [F.lit(flags)] * 5
        return spark.range(1).select(quality.score(*values).alias("s")).first()["s"]

    assert score(6000, 60, 0.0, 0) == 100
    assert [100 - score(6000, 60, 0.0, n) for n in (1, 3, 5, 7)] == [3, 9, 15, 15]
    assert score(6000, 60, 0.51, 0) == 80
    assert score(6000, 60, 0.31, -2) == 90
    assert score(0, 0, 0.0, 0, False) == 0
    labels = spark.createDataFrame([(x,) for x in (85, 84, 70, 69, 50, 49, 30, 29)], "s int").select(quality.label(F.col("s")).alias("l"))
    assert [r["l"] for r in labels.collect()] == ["excellent", "good", "good", "fair", "fair", "poor", "poor", "failed"]


def test_settings():
    assert whole("12px", 3) == 12 and whole("px", 3) == 3 and whole(None, 3) == 3
    assert flag("TRUE", False) and flag("1", False) and not flag("yes", True) and flag(None, True)
    assert Settings.load({"MAX_RESULTS": "7", "RESOURCE_BLOCK_FONTS": "no"}) == Settings(max_results=7, resource_block_fonts=False)


def test_stems():
    from pagewright.functions.text import stem

    assert [stem(p) for p in ("all rights", "editor'?s picks?", "a|b", "(x|y)[ ]*page", r"subscribe\s*(now|to\s*(our|the))", r"©\s*\d{4}", "ab+c")] == ["all rights", "editor", "", "page", "subscribe", "©", "ab"]
