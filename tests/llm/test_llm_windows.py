"""What problem 4 judges: every spelling, place and length of a sign of residue."""

import random
import time

import numpy as np
import pytest
from make import COMMON

from pagewright.llm import residue
from pagewright.llm.blocks import blocks_of, mark_blocks
from pagewright.llm.linear import Stretches, fit

STOP = frozenset(w for v in COMMON.values() for w in v)
LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed eiusmod tempor incididunt labore et dolore magna aliqua."
FILL = "The boats came home late and the whole village slept well after the long night at sea. "
NAMES = ["first_name", "city", "product.title", "user.name", "ORDER_NO", "item2", "dateLong", "sku"]
FORMS = ["{{{{ {} }}}}", "{{{}}}", "${{{}}}", "#{{{}}}", "[[{}]]", "%%{}%%", "@@{}@@", "*|{}|*", "<%= {} %>", "[INSERT {} HERE]"]


def parsed(title, text, markup=None):
    blocks = blocks_of(text, markup, STOP)
    mark_blocks(blocks, title, (), None)
    return title, blocks


@pytest.fixture(scope="module")
def weights():
    """A classifier from pages of prose, pages with a hole, pages that quote one, and pages that are a notice or filler."""
    rng = random.Random(11)
    words = "harbour council village timetable market bridge letter school railway garden winter supper boat window".split()
    say = lambda: " ".join(rng.choice(words) if k % 2 else rng.choice(COMMON["en"]) for k in range(16)).capitalize()
    pages = [parsed(say(), "\n\n".join(f"{say()}. {say()}." for _ in range(6))) for _ in range(150)]
    for k in range(120):
        pages.append(parsed(say(), f"{say()}. {say()} {FORMS[k % len(FORMS)].format(NAMES[k % 8])} {say()}.\n\n{say()}. {say()}. {say()}. {say()}."))
    for k in range(60):
        pages.append(parsed(say(), f"{say()}. In the lesson she wrote {FORMS[k % 2].format(NAMES[k % 8])} on the board and explained the template. {say()}.\n\n{say()}. {say()}. {say()}."))
        pages.append(parsed(say(), "\n".join(f"for(var i=0;i<{k + j};i++){{boat[i]=mill(i)||null}}" for j in range(9))))
    for k in range(30):
        pages += [parsed("404 Not Found", "The requested page was not found on this server."), parsed("Loading", "Please enable JavaScript to continue using this application."), parsed(say(), LOREM * 3), parsed(say(), f"Posted by undefined on undefined, {k} views.")]
        pages.append(parsed(say(), f"{say()}. {say()}. {say()}. {say()}. {say()}. {say()}. {say()}. {say()}. {say()}. {say()}.\n\nPlease turn on scripts to see the comments on Daily Quay."))
    codes, signs, labels = [], [], []
    for title, blocks in pages:
        c, s = residue.judged(title, blocks)
        codes, signs, labels = codes + c, signs + s, labels + [y for y, _ in residue.labelled(title, blocks)]
    return fit(Stretches(codes, signs), np.array(labels), epochs=16)


def found(weights, text, title=None):
    return bool(residue.are_residue([parsed(title, text)], weights)[0])


@pytest.mark.parametrize("mark", ["{CITY}", "{firstName}", "{item1}", "{user.firstName}", "{{ last_name }}", "{{unknown.field}}", "[[long_name]]", "%%LONG_NAME%%", "[INSERT company HERE]", "@@other@@", "*|FNAME|*", "<%= price %>", "${amount}"])
@pytest.mark.parametrize("before", [0, 1, 60])
def test_marks_of_any_case_place_and_name(weights, mark, before):
    assert found(weights, FILL * before + f"Dear reader in {mark} we greet you today. " + FILL * 20)


def test_code_and_quotations_are_no_residue(weights):
    assert not found(weights, "for(var i=0;i<7;i++){lamp[i]=rope(i)||null}\n" * 8)
    assert not found(weights, FILL * 9 + "In the lesson she wrote {{ surname }} on the board and explained the template. " + FILL * 9)


@pytest.mark.parametrize("piece", ["{a_", "__A", ".__A", "@@a_ ", "{{ ", "[ADD ", "<% "])
def test_marks_never_closed_cost_linear_time(weights, piece):
    began = time.time()
    title, blocks = parsed(None, piece * 30_000)
    residue.are_residue([(title, blocks)], weights)
    residue.labelled(title, blocks)
    assert time.time() - began < 20


def test_filler_below_a_long_menu(weights):
    menu = [f"Topic {a}{b}" for a in "abcdef" for b in "uvwxyz"]
    for head in (menu, [f"The {x} stands for itself as a line of its own, once" for x in menu[:14]]):
        assert found(weights, "\n".join([*head, *[f"{LOREM} Vestibulum {k}." for k in range(30)]]))


@pytest.mark.parametrize("lines", [1, 13, 40])
def test_notices_among_many_lines_of_a_thin_page(weights, lines):
    """A thin page is judged by all its lines, whatever their number."""
    assert found(weights, "\n".join([*(f"Section {k}" for k in range(lines)), "The requested page was not found on this server."]), "404 Not Found")


@pytest.mark.parametrize("value", ["undefined", "NaN", "[object Object]"])
@pytest.mark.parametrize("before", [0, 1, 60])
def test_missing_values_have_their_weak_label_anywhere(value, before):
    title, blocks = parsed(None, FILL * before + f"Posted by {value} on {value}. " + FILL * 20)
    assert [y for y, kind in residue.labelled(title, blocks) if kind == "hole"] == [1]


def test_notices_are_labelled_by_what_stands_beside_them():
    notice = "Please enable JavaScript to continue to the page."
    label = lambda text: [y for y, p in residue.labelled(*parsed(None, text)) if p][-1]
    assert label(notice) == 1 and label(FILL * 9 + "\n\n" + notice) == 0 and label(FILL * 4 + "\n\n" + notice) == -1


def test_every_word_of_a_long_sentence_counts():
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "bdfgklm"]
    sizes = [len(Stretches(*residue.judged(*parsed(None, " ".join(words[:n])))).features()[0]) for n in (180, 245)]
    assert sizes[1] - sizes[0] == 3 * 65


def test_two_million_characters():
    began = time.time()
    title, blocks = parsed("T", FILL * 23_000 + "Dear {{ name }} reader.")
    assert len(residue.judged(title, blocks)[0]) == 23_002 and time.time() - began < 60
