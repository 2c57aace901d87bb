from pagewright.functions.register import register


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "<div><a href='https://a.example'><h3>One</h3></a></div><p>Some <a>link</a></p><ul><li>x<li>y</ul>"), (2, None)], "id int, html string").createOrReplaceTempView("shown")
    rows = spark.sql("SELECT id, s.position, s.title, s.href FROM shown, LATERAL serp_results(html) s").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "One", "https://a.example")]
    blocks = spark.sql("SELECT b.tag, b.text, b.link_share FROM shown, LATERAL page_blocks(html) b ORDER BY block_no").collect()
    assert [tuple(r) for r in blocks] == [("h3", "One", 0.0), ("p", "Some link", 0.444444), ("li", "x", 0.0), ("li", "y", 0.0)]
    out = spark.sql("SELECT nfkc('ﬁ') AS n, plain_text('<p>a</p><p>b</p>') AS t, markdown('<b>x</b>') AS m, plain_text(NULL) AS e").first()
    assert tuple(out) == ("fi", "a\n\nb", "**x**", None)
