from pagewright.dom.cleanup import clean_tree
from pagewright.dom.metadata import metadata_of
from pagewright.dom.postclean import post_clean
from pagewright.dom.render import link_density, normalize, render, truncate_words
from pagewright.dom.select import select
from pagewright.dom.serp import block_reason, rows_of
from pagewright.dom.tree import body_of, parse, serialize
from pagewright.operators.extract import extract_page

LONG = "The harbour opened its gates at dawn, and the boats left one by one, as they had done for years. " * 8
PAGE = f"""<html lang="en"><head><title>Old title</title><meta property="og:title" content=" Harbour  day ">
<meta name="author" content="Ada Quill"><link rel="canonical" href="https://h.example/day">
<script type="application/ld+json">{{"@graph": [{{"name": "Org"}}, {{"headline": "LD", "datePublished": "2024-05-01", "image": [{{"url": "i.png"}}]}}]}}</script>
<script type="application/ld+json">broken</script></head>
<body><nav>Home News</nav><div class="cookie-banner">We use cookies</div><article><h1>Harbour day</h1><p>{LONG}<p><b>Second {LONG}
<div class="share">Share on</div></article><footer>Fine print</footer></body></html>"""


def cleaned(source):
    root = parse(source)
    clean_tree(root)
    return serialize(body_of(root))


def test_tree_repairs():
    assert serialize(body_of(parse("<p>a<p>b<br><ul><li>1<li>2</ul>"))) == "<p>a</p><p>b<br></p><ul><li>1</li><li>2</li></ul>"
    assert serialize(body_of(parse("<table><tr><td>1<td>2<tr><td>3</table>"))) == "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    assert serialize(body_of(parse("a &amp; b &lt;"))) == "a &amp; b &lt;"
    assert body_of(parse("")).text_content() == ""
    assert body_of(parse(None)).children == []
    assert len(serialize(body_of(parse("<div>" * 3000 + "x")))) > 0


def test_selectors():
    root = parse('<main><nav id="a">x</nav></main><nav id="b" class="Big ad-1">y</nav><i aria-label="An ADVERTISEMENT"></i>')
    ids = lambda s: [n.get("id") for n in select(root, s)]
    assert ids("nav:not(article nav):not(main nav)") == ["b"]
    assert ids('[class*=" ad-"]') == ["b"] and ids('[class^="ad-"]') == []
    assert len(select(root, '[aria-label*="advertisement" i]')) == 1
    assert ids("main nav, i") == ["a", ""]


def test_metadata():
    meta = metadata_of(parse(PAGE))
    assert meta == {
        "title": "Harbour day", "description": None, "author": "Ada Quill", "site_name": None, "published_date": "2024-05-01", "image_url": "i.png",
        "canonical_url": "https://h.example/day", "language": "en",
    }


def test_cleanup():
    out = cleaned('<body><div class="advert"><img src="x"></div><div class="advert">gone</div><div class="ad">stays</div><div><span></span></div><img data-src="l.png"><p style="display: none">x</p></body>')
    assert "gone" not in out and "stays" in out and "<img src=\"x\">" in out and 'src="l.png"' in out and "<span>" not in out and "<p" not in out


def test_post_clean():
    html, warnings = post_clean("<p>Read about boats.</p><p>Share this article</p><p><a href='#'>More and more links</a></p><p> </p>")
    assert "Share" not in html and "links" not in html and warnings == ["BOILERPLATE_REMOVED", "LINK_DENSE_BLOCKS_REMOVED"]
    assert post_clean("<p>see https://a.example/?utm_source=x&amp;ref=1 now</p>")[0] == "<p>see https://a.example/?&amp;ref=1 now</p>"
    assert post_clean("<form><input type='email'></form><p>kept</p>")[0] == "<p>kept</p>"
    assert post_clean("  ") == ("", [])


def test_text_and_markup():
    assert render("<p>a</p><div>b<br>c</div><td>d</td><td>e</td>", "text", 100)[0] == "a\n\nb\nc\n\nde"
    assert render('<p class="x" href="y" onclick="z">a</p>', "html", 100)[0] == '<p href="y">a</p>'
    assert render("<p>one</p><p>two</p>", "html", 14)[0] == "<p>one</p><p></p>"
    assert truncate_words("one two", 5) == "one" and truncate_words("one", 2) == ""
    assert normalize("a  b\n\n\n\nc  ") == "a b\n\nc"
    assert link_density("<p>abcd<a>efgh</a></p>") == 0.5 and link_density("") == 0.0


def test_markdown():
    md = lambda s: render(s, "markdown", 5000)[0]
    assert md("<h2>T <em>x</em></h2><p>a <strong>b</strong> <a href='u'>l</a> *</p>") == "## T *x*\n\na **b** [l](u) \\*"
    assert md("<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>") == "- a\n- b\nc\n- d"
    assert md("<ol><li>x</li><li>y</li></ol>") == "1. x\n2. y"
    assert md("<table><tr><th>h|1</th><th></th></tr><tr><td>v</td></tr></table>") == "| h\\|1 | |\n| --- | --- |\n| v | |"
    assert md("<blockquote><p>q</p><p>r</p></blockquote>") == "> q\n>\n>\n>\n> r"
    assert md('<pre><code class="language-py">x = 1\n</code></pre>') == "```py\nx = 1\n```"
    assert md("<pre>raw</pre><hr><img src='s' alt='a'>") == "```\nraw\n```\n\n---\n\n![a](s)"


def test_extraction():
    names = ["content_body", "cleaned_html", "text_content"]
    row = extract_page(PAGE, "text", 12_000)
    assert row[8] == "Harbour day" and row[-1] is None and row[-2] == []
    text = row[8 + 4 + names.index("text_content")]
    assert text.startswith("Harbour day\n\nThe harbour") and "cookies" not in text and "Share on" not in text and "Fine print" not in text
    assert extract_page("<html><head><title>x</title></head><body></body></html>", "text", 100)[-1] == "READABILITY_EMPTY"
    assert extract_page(None, "text", 100)[-1] == "NAVIGATION_FAILED"
    assert extract_page("<p>short words here</p>", "text", 100)[-2] == ["READABILITY_UNCERTAIN"]


SERP = """<html><body><nav><a href="/search?q=x">Nav</a></nav>
<div class="g"><a href="/url?q=https%3A%2F%2Fone.example%2Fa&sa=U"><h3>First  result</h3></a><cite>one.example</cite>
<div><span>A snippet that is long enough to be taken as the snippet.</span></div></div>
<div class="g"><span>Sponsored</span><a href="https://ad.example"><h3>Ad</h3></a></div>
<div class="g"><a href="javascript:x"><h3>Script</h3></a></div><div class="g"><a href="https://two.example"><h3>Second</h3></a></div></body></html>"""


def test_serp_rows():
    reason, rows = rows_of(SERP)
    assert reason is None
    assert [(r["title"], r["is_ad"]) for r in rows] == [("First result", False), ("Ad", True), ("Script", False), ("Second", False)]
    assert rows[0]["display_url"] == "one.example" and rows[0]["snippet"].startswith("A snippet")


def test_serp_blocks():
    why = lambda s, a=None: block_reason(parse(s), a)
    assert why("<p>x</p>", "https://g.example/sorry/index") == "Google returned a /sorry/ anti-bot page"
    assert why('<iframe src="https://x/ReCaptcha/api"></iframe>') == "Google reCAPTCHA challenge detected"
    assert why('<form action="/Sorry"></form>') == "Google CAPTCHA form detected"
    assert why("<p>Unusual   Traffic here</p>") == "Google block/rate-limit signal detected: unusual traffic"
    assert why(SERP) is None


def test_deep_pages():
    for output_format in ("text", "markdown", "html"):
        assert extract_page("<div>" * 5000 + LONG + "<blockquote><ul><li>" * 500 + "x", output_format, 2000)[-1] is None
    assert extract_page("<p>" + LONG * 300, "markdown", 1000)[-1] is None
