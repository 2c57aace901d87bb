"""Queries that must treat whole texts, against a plain computation of the operator."""

import json
import re
import unicodedata

from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators.extract import extract
from pagewright.plans import catalog

#: White space as browsers see it, without line ends.
SPACE = "\\t\\x0b\\f \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
TEXTS = ["\ufb01 \u00bd", "N\u00ba 5 of the  session\n\n\n\n  and\u3000wide \t spaces \n", "word " * 3000 + "\uff45\uff4e\uff44", "", None, " \n ", "\u00e9t\u00e9 \u2460\r\nnext\u2003one", "x" * 900 + " \u2116" + "7"]


def plain(t):
    """NFKC, runs of white space but line feeds as one space, at most one empty line, lines and text trimmed."""
    if t is None:
        return None
    t = re.sub(rf"[{SPACE}]+", " ", unicodedata.normalize("NFKC", t))
    trim = lambda x: re.sub(rf"^[{SPACE}\r\n]+|[{SPACE}\r\n]+\Z", "", x)
    return trim("\n".join(map(trim, re.sub(r"\n{3,}", "\n\n", t).split("\n"))))


def documents(spark, folder):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_normalize_texts(spark, tmp_path):
    got = dict(map(tuple, catalog.normalize_texts(spark, documents(spark, tmp_path)).collect()))
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert got[0] == "fi 1⁄2" and got[2].endswith("word end") and len(got[2]) > 15_000 and got[7].endswith("No7")


def test_truncation_on_its_own(spark):
    cut = lambda t, n: spark.range(1).select(text.truncate_words(F.lit(t), n)).first()[0]
    assert cut("one two three", 13) == "one two three" and cut("one two three", 9) == "one two" and cut("one two three", 7) == "one two"
    assert cut("unbroken", 4) == "" and cut("one", 0) == ""


HTML = "<html><head><title>The quay</title></head><body><article>%s<p>The very last words are harbour wall.</p></article></body></html>" % "".join(f"<p>Boat number {k} came home late, and the village slept well, as it does after a long night at sea.</p>" for k in range(400))


def pages(spark, folder):
    spark.createDataFrame([(1, "https://a.example/x", "https://a.example/x", HTML)], "result_id long, url string, final_url string, cleaned_html string").write.parquet(f"{folder}/extraction_results.parquet")
    return str(folder)


def test_extractions_are_whole(spark, tmp_path):
    base = pages(spark, tmp_path)
    said = json.loads(catalog.extract_json(spark, base).first()["document"])
    rows = [said, catalog.extract_markdown(spark, base).first().asDict(), catalog.extract_html(spark, base).first().asDict()]
    assert all("Boat number 399" in r["content_body"] and "harbour wall." in r["content_body"] and len(r["content_body"]) > 30_000 for r in rows)
    assert said["text_content"].endswith("harbour wall.") and len({r["score"] for r in rows}) == 1


def test_small_limits(spark, tmp_path):
    given = spark.read.parquet(f"{pages(spark, tmp_path)}/extraction_results.parquet").selectExpr("result_id as page_id", "url", "cleaned_html as html")
    for form in ("text", "markdown"):
        row = extract(given, output_format=form, max_chars=150).first()
        assert 100 < len(row["content_body"]) <= 150 and len(row["text_content"]) <= 150
