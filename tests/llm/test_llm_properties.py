"""Properties of the text-corpus functions on generated input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import residue
from pagewright.llm.blocks import BAD, GOOD, blocks_of, mark_blocks
from pagewright.llm.linear import Stretches
from pagewright.llm.packing import Packer
from pagewright.llm.pii import KINDS, Finder, redact

FINDER = Finder(["Ada Quill", "Bruno Marsh"])
words = st.sampled_from(["Ada ", "Bruno ", "Fenn ", "van ", "@", " at ", "(at)", "x.test", "+999 ", "0", "12 ", "345-", "/", "Flat 3, ", "Mill Hill, ", "Oldby ", "P.O. Box ", "VK ", "\n", ".", ", ", "Straße ", "rue ", "yours, "])
lines = st.lists(st.sampled_from(["Home", "the boat is in the harbour and it was late.", "<p>", "</p>", "<li><a href='#'>", "</a>", "{{ x }}", "undefined", "\n", "© 2020 News", "12 comments", "​", "<nav>", "[1] A, B 2001."]), max_size=30).map("\n".join)


@settings(deadline=None)
@given(st.lists(words, max_size=40).map("".join))
def test_spans_are_disjoint_and_inside(text):
    last = 0
    for start, end, kind in FINDER.spans(text):
        assert last <= start < end <= len(text) and kind in KINDS
        last = end
    assert redact(text, []) == text


@settings(deadline=None)
@given(lines, lines, st.one_of(st.none(), st.text(max_size=20)))
def test_every_line_is_decided(text, markup, title):
    blocks = blocks_of(text, markup, frozenset(("the", "is", "in", "and")))
    mark_blocks(blocks, title, (None, title), title)
    assert all(b.mark in (GOOD, BAD) for b in blocks)
    assert [b.line_no for b in blocks] == [k for k, line in enumerate(text.split("\n"), 1) if line.replace("​", "").strip()]
    codes, signs = residue.judged(title, blocks)
    assert len(codes) == len(signs) == len(residue.labelled(title, blocks)) and all(codes)
    row, index, value = Stretches(codes, signs).features()
    assert len(row) == len(index) == len(value) and set(row.tolist()) == set(range(len(codes)))


@given(st.integers(1, 50), st.lists(st.lists(st.integers(0, 50), max_size=30), max_size=4))
def test_containers_never_overflow(capacity, windows):
    packer, load = Packer(capacity, 0), {}
    for sizes in windows:
        sizes = [min(s, capacity) for s in sizes]
        for (box, offset), size in zip(packer.pack(sizes), sizes):
            assert offset + size <= capacity
            load.setdefault(box, []).append((offset, size))
    for items in load.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
