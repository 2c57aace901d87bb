"""How site furniture reads, learned from the pages themselves.

Two linear classifiers over hashed n-grams of a line: whether it is site furniture, and
whether it opens a list of other pieces. Their labels come from pages that tell: lines in
telling containers, lines that stand on several pages of one site, and lines with linked
ones below them; all other lines are the counter-examples, at less weight. So what pages with
markup say is applied to those without, and no list of phrases is kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from pagewright.llm.blocks import LINKED, Block
from pagewright.llm.lexicon import fold, tidy
from pagewright.llm.linear import Stretches, fit, score

#: Pages of the sample, of one site, on which a line stands that counts as repeated.
LEAST_PAGES = 3
_DATED = re.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b")


#: What a line that no markup places counts as a counter-example, against 1 of one in a main container.
UNTOLD = 0.05
#: How a line begins: its first words, and the kinds of their signs.
_HEAD, _LETTERS, _NUMBER = re.compile(r".{0,48}"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def signs_of(b: Block, site: str, people: list[str]) -> tuple[int, ...]:
    """How the line begins, and whether the site, an author or a date is named. Length and common words are left to the block rules."""
    out = []
    if len(site) > 5 and site in b.low:
        out.append(170)
    if any(p in b.low for p in people):
        out.append(171)
    if b.digits and _DATED.search(b.low):
        out.append(172)
    head = _HEAD.match(b.low).group()
    out.append(zlib.crc32(" ".join(head.split()[:2]).encode("utf-8", "surrogatepass")))
    shape = _NUMBER.sub("0", _LETTERS.sub("w", head))
    out += [zlib.crc32(shape[:k].encode("utf-8", "surrogatepass")) for k in (5, 9)]
    return tuple(out)


def named(byline: str | None, author: str | None, site_name: str | None) -> tuple[str, list[str]]:
    """The folded name of the site ('' for none) and those of the authors."""
    return fold(tidy(site_name)) if site_name else "", [fold(tidy(x)) for x in (byline, author) if x and len(x) > 3]


def labels_of(blocks: list[Block]) -> list[tuple[int, int]]:
    """For each line its label by markup alone as furniture and as an opener: 1, 0, or -1 for none. What no markup tells is 0 until it is seen to be repeated."""
    out = []
    for k, b in enumerate(blocks):
        linked = b.link >= LINKED
        below = [x.link >= LINKED for x in blocks[k + 1 : k + 3]]
        opener = 1 if not linked and b.role < 0 and len(below) == 2 and all(below) and len(b.words) <= 8 else 0 if b.link >= 0 and not (below and below[0]) else -1
        own = -1 if linked and b.role < 0 else 1 if b.role < 0 else 0
        out.append((own, opener))
    return out


def fit_furniture(sites: list[str], counts: list[int], lines: Stretches, own: np.ndarray, opens: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both classifiers, from the lines of pages in their order: each page's site and number of lines, each line's labels and whether a main container holds it.

    Lines are alike if they differ in case, spacing or the digits of most numbers alone.
    """
    ends = np.concatenate([[0], np.cumsum(np.bincount(lines.row, minlength=lines.rows))])
    keys = [lines.codes[ends[k] : ends[k + 1]].tobytes() for k in range(lines.rows)]
    seen: dict[str, Counter] = defaultdict(Counter)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    for site, start, stop in zip(sites, bounds, bounds[1:]):
        seen[site].update(set(keys[start:stop]))
    repeated = np.array([seen[site][key] >= LEAST_PAGES for site, start, stop in zip(sites, bounds, bounds[1:]) for key in keys[start:stop]], bool)
    labels = np.where(repeated & ~main, 1, own)
    return fit(lines, labels, trust=np.where((labels == 0) & ~main, UNTOLD, 1.0)), fit(lines, opens)


def score_lines(pages: list[tuple[list[Block], str, list[str]]], weights: tuple[np.ndarray, np.ndarray]) -> None:
    """Set ``cue`` and ``opens`` of all lines of (blocks, site, people)."""
    lines = [b for blocks, _, _ in pages for b in blocks]
    stretches = Stretches([b.codes for b in lines], [signs_of(b, site, people) for blocks, site, people in pages for b in blocks])
    for b, cue, opens in zip(lines, *(x.tolist() for x in score(stretches, *weights))):
        b.cue, b.opens = cue, opens
