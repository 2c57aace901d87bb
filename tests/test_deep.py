"""Trees of any depth, and pages that take too long."""

import time

import pytest

from pagewright.dom.render import render
from pagewright.dom.tree import parse
from pagewright.operators import extract as stage
from pagewright.operators.extract import extract_page, timely_page

SAID = "The boats of the harbour came home late in the evening, and all of the village was on the quay to see them, as it had been for years and years."


@pytest.mark.parametrize("depth", [10, 239, 240, 241, 1000, 20_000])
@pytest.mark.parametrize("tag", ["div", "section", "span", "b", "blockquote", "ul><li", "table><tr><td"])
def test_nesting_of_any_depth(depth, tag):
    names = tag.split("><")
    depth = min(depth, 1000) if len(names) == 3 else depth  # each row of a table repeats the text of those within
    source = f"<p>{SAID}</p>" + f"<{tag}>" * depth + "innermost" + "".join(f"</{n}>" for n in reversed(names)) * depth + "<p>after</p>"
    root = parse(source)
    steps, node = 0, next(n for n in root.walk() if n.tag is None and n.text == "innermost")
    while node.parent is not None:
        node, steps = node.parent, steps + 1
    assert steps >= depth * len(names)
    for form in ("text", "markdown", "html"):
        content, text = render(source, form, 100_000_000)
        assert "innermost" in content and text.endswith("after") and "innermost" in text


@pytest.mark.parametrize("depth", [1000, 30_000])
def test_deep_pages_are_extracted(depth):
    began = time.time()
    page = extract_page(f"<html><body>{'<div>' * depth}<p>{SAID}</p><p>{SAID} Twice.</p>{'</div>' * depth}</body></html>", "markdown", 12_000)
    assert page[-1] is None and page[-4].endswith("Twice.") and time.time() - began < 60


def test_two_million_characters():
    page = extract_page(f"<article>{''.join(f'<p>{SAID} {k}</p>' for k in range(14_000))}</article>", "text", 100_000)
    assert page[-1] is None and len(page[-4]) > 99_000


def test_a_slow_page_is_late(monkeypatch):
    def slow(*_):
        while True:
            pass

    monkeypatch.setattr(stage, "extract_page", slow)
    began = time.time()
    row = timely_page("<p>x", "text", 100, True, 0.2)
    assert row[-1] == "LOAD_TIMEOUT" and row[0] is None and time.time() - began < 5
