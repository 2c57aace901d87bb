"""Markup and its lines: open elements at any depth, alignment at any size, cues at any length."""

import random
import time

import numpy as np
import pytest
from make import COMMON

from pagewright.llm import furniture
from pagewright.llm.blocks import BAD, GOOD, Markup, blocks_of, mark_blocks
from pagewright.llm.linear import Stretches

STOP = frozenset(w for v in COMMON.values() for w in v)
PROSE = "The boats of the harbour came home late in the evening, and all of the village was on the quay to see them, as it had been for years and years."


def roles(source, *lines):
    page = Markup(source)
    return [page.describe(page.text.find(x), len(x))[1] for x in lines]


@pytest.mark.parametrize("side", ["aside", "nav", "footer"])
@pytest.mark.parametrize("row", ["<tr><td>a<td>b", "<tr><th>a<td>b<td>c", "<div>x", "<dt>a<dd>b"])
@pytest.mark.parametrize("count", [3, 60, 4000])
def test_end_tag_finds_its_element_at_any_depth(side, row, count):
    holder = "dl" if "dt" in row else "table" if "tr" in row else "section"
    assert roles(f"<{side}><{holder}>{row * count}</{side}><p>after", "after") == [0]
    assert roles(f"<{side}><{holder}>{row * count}</{holder}>inside</{side}><p>after", "inside", "after") == [-1, 0]


def test_rows_and_terms_end_at_the_next_one():
    assert roles("<table><tr class=''><td class='share'>one<td>two<tr><td>three</table>", "one", "two", "three") == [-1, 0, 0]
    assert roles("<dl><dt class='promo'>one<dd>two<dd class='promo'><dl><dt>inner</dl>still<dt>last</dl>", "one", "two", "inner", "still", "last") == [-1, 0, -1, -1, 0]
    assert roles("<table><tr><td class='share'>a<table><tr><td>b<td>c</table>d<td>e</table>", "b", "c", "d", "e") == [-1, -1, -1, 0]


def test_open_elements_cost_linear_time():
    began = time.time()
    Markup("<div>" * 60_000 + "</p></section>" * 60_000 + "x")
    assert time.time() - began < 8


def test_lines_beyond_a_long_stretch_of_other_text():
    embedded = "".join(f"<li>comment {k} by a reader of the paper</li>" for k in range(20_000))
    text = f"{PROSE} First.\n{PROSE} Second.\nMore boats"
    for between in ("<li>comment</li>", embedded):
        source = f"<main><p>{PROSE} First.</p></main><ul>{between}</ul><main><p>{PROSE} Second.</p></main><nav><a href='#'>More boats</a></nav>"
        assert [(b.role, b.tag, b.link) for b in blocks_of(text, source, STOP)] == [(1, "p", 0), (1, "p", 0), (-1, "nav", 1)]


def test_index_gives_the_answers_of_a_plain_search():
    rng = random.Random(2)
    text = "".join(rng.choice("abé😀") for _ in range(3000))
    plain, indexed = Markup(f"<p>{text}"), Markup(f"<p>{text}")
    for _ in range(3000):
        size, at = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 31, 64, 200, 2999, 3000]), rng.randrange(3000)
        piece, cursor = text[at : at + size] if rng.random() < 0.8 else text[at : at + size] + "b", rng.randrange(3001)
        plain.left, indexed.left = 1, 0
        assert plain.find(piece, cursor) == indexed.find(piece, cursor)
    assert indexed.find("z", 0) == -1 == indexed.find("a" * 4000, 5)


def test_many_lines_that_stand_nowhere_cost_linear_time():
    source = "".join(f"<p>A line of markup number {k} is here to be read" for k in range(40_000))
    began = time.time()
    blocks = blocks_of("\n".join(f"A line of markup number {k} is not to be found" for k in range(40_000)), source, STOP)
    assert {b.tag for b in blocks} == {""} and time.time() - began < 60


NOTICES = [
    "We use cookies and similar means to learn how the pages of this paper are read and to show what fits, and by going on you agree to this, which you can change at any time in the settings that stand at the foot of the page.",
    "The Daily Quay is a trading name of Harbour Papers, which is registered under number 4711 in the list of the county; all rights reserved, and no part of it may be copied, kept or sent on without leave given in writing by the owner.",
    "© 2021 Harbour Papers. The pieces on these pages are the work of those who are named above them, and the paper and its owners are not bound by what is said in them, nor by what is said on pages that they may point to in any way.",
]


@pytest.fixture(scope="module")
def learned():
    """Furniture classifiers from pages whose markup tells notices from the piece."""
    lines, labels, main = [], [], []
    rng = random.Random(5)
    for k in range(60):
        notice = NOTICES[k % 3].replace("4711", str(k)).replace("Daily Quay", rng.choice(["Morning Tide", "Old Mill Gazette", "Market Post"])).replace("Harbour Papers", rng.choice(["Tide Press", "Mill House"]))
        blocks = blocks_of(f"{PROSE} {k}.\n{notice}", f"<article><p>{PROSE} {k}.</p></article><footer>{notice}</footer>", STOP)
        lines += blocks
        labels += furniture.labels_of(blocks)
        main += [b.role > 0 for b in blocks]
    stretches = Stretches([b.codes for b in lines], [furniture.signs_of(b, "", []) for b in lines])
    return furniture.fit_furniture([f"s{k}" for k in range(60)], [2] * 60, stretches, np.array([x for x, _ in labels]), np.array([y for _, y in labels]), np.array(main))


def marked(learned, text, markup=None):
    blocks = blocks_of(text, markup, STOP)
    furniture.score_lines([(blocks, "", [])], learned)
    mark_blocks(blocks, None, (), None)
    return [b.mark for b in blocks]


@pytest.mark.parametrize("notice", NOTICES)
@pytest.mark.parametrize("markup", [False, True])
@pytest.mark.parametrize("size", [100, 189, 190, 191, 230])
def test_notices_of_any_length(learned, notice, markup, size):
    lines = [PROSE, notice[:size], PROSE]
    assert marked(learned, "\n\n".join(lines), "".join(f"<div>{x}</div>" for x in lines) if markup else None) == [GOOD, BAD, GOOD]


def test_long_prose_with_a_cue_word_stays(learned):
    for line in (f"The baker of the village sold cookies and bread. {PROSE} {PROSE}", f"{PROSE} {PROSE} Then they would all ask about cookies and the newsletter."):
        assert marked(learned, f"{PROSE}\n\n{line}\n\n{PROSE}") == [GOOD] * 3
