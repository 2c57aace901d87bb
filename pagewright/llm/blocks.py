"""Lines of a page as blocks: features from text and markup, and the two-pass block rules of problem 3.

Pass one decides each block from stop-word density, length, link density, telling tags and
how much its words read as site furniture, which `furniture` learns from the pages
themselves. Pass two lets the blocks that stayed
ambiguous (short lines, headings, list items) inherit the label of their nearest decided
neighbours, neighbours in the same markup container first.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

from pagewright.llm.lexicon import fold, tidy, visible
from pagewright.llm.linear import STOP, codes_of, tokens_of

GOOD, BAD, OPEN, HEAD, ITEM = 1, -1, 0, 2, 3
#: Block rules: characters below which a block is short, above which it is long; stop-word densities; link density.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKED = 70, 200, 0.18, 0.28, 0.5

#: Score as furniture above which even a line in a main container is.
IN_MAIN = 1.0

#: A page is searched as plain text for so many times its length in all, then by an index with the same answers.
SCANS = 64

_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>", re.S | re.I)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*["']([^"']*)["']""", re.I)
_NOISE_TOKEN = re.compile(
    r"(?:^|[\s_-])(?:nav|navigation|menu|cookies?|consent|gdpr|promo|promos|share|sharing|social|newsletter|subscribe|signup|sidebar|aside|rail"
    r"|related|recommended|comments?|footer|byline|meta|dateline|advert|advertisement|ads?|sponsor|sponsored|banner|popup|modal|dialog|breadcrumbs?|pagination|pager|paywall|widget|toolbar)(?=$|[\s_-])",
    re.I,
)
_MAIN_TOKEN = re.compile(r"(?:^|[\s_-])(?:article|main|article-body|story-body|entry-content|post-content|prose)(?=$|[\s_-])", re.I)
_NOISE_TAGS = {"nav", "aside", "footer", "form", "small", "button", "noscript"}
_MAIN_TAGS = {"article", "main"}
_BLOCK_TAGS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "table", "ul", "ol", "div", "section", "blockquote", "pre", "br", "dl", "dd", "dt", "small"} | _NOISE_TAGS | _MAIN_TAGS
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_IMPLIED_END = {"p", "li"} | _HEADINGS
#: Tags whose start ends an open element of the second set, unless one of the third was opened in between.
_ENDS = {
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "dt": (("dt", "dd"), ("dl", "table", "tr", "td", "th", "ul", "ol", "section", "blockquote", *sorted((_NOISE_TAGS | _MAIN_TAGS) - {"small", "button", "noscript"}))),
}
_ENDS["dd"] = _ENDS["dt"]

_SENTENCE_END = re.compile(r"[.!?…][\"'»“”’)\]]*$")
_BULLET = re.compile(r"^(?:[-–—•*·▪◦]|\(?\d{1,3}[.)]|\[\d{1,3}\])\s")
_SEPARATED = re.compile(r"\s[|·•/]\s")
_ADDRESS = re.compile(r"^(?:https?://|www\.)\S+$")


@dataclass(slots=True)
class Block:
    """One non-empty line of the text."""

    line_no: int
    text: str  #: tidy
    low: str  #: folded
    words: list
    codes: list  #: token hashes
    digits: int
    marks: int  #: signs that are no letter, digit or white space, but for those inside words
    stop: float  #: share of common words
    link: float  #: share of characters inside links; -1 without markup
    role: int  #: 1 in a main container, -1 in site furniture, 0 unknown
    tag: str  #: nearest block tag
    box: int  #: number of the markup container, -1 unknown
    cue: float = 0.0  #: score as site furniture by its words (`furniture`), above 0 where it reads as such
    opens: float = 0.0  #: score as a line that opens a list of other pieces
    mark: int = OPEN
    why: str = ""


def _uncommented(source: str) -> str:
    """Markup without comments; one that is never closed stays, as it hides nothing for certain. Linear in the length."""
    if "<!--" not in source:
        return source
    parts, at = [], 0
    while (start := source.find("<!--", at)) >= 0 and (end := source.find("-->", start + 4)) >= 0:
        parts.append(source[at:start])
        at = end + 3
    return "".join([*parts, source[at:]])


class Places:
    """Where pieces stand in a text, by hashes of stretches of 1, 2, 4, ... characters: a piece is a head and a tail of such a length."""

    def __init__(self, text: str):
        self.levels = [self._codes(text)]
        self.orders: dict[int, np.ndarray] = {}
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _double(level: np.ndarray, k: int) -> np.ndarray:
        """Hashes of stretches twice as long."""
        mixed = level[: -(1 << k)] * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0xBF58476D1CE4E5B9) + level[1 << k :]

    def of(self, piece: str) -> np.ndarray:
        """The positions of a piece, ascending; each distinct piece is looked up once."""
        if piece not in self.known:
            self.known[piece] = self._look(piece)
        return self.known[piece]

    def _look(self, piece: str) -> np.ndarray:
        k = len(piece).bit_length() - 1
        while len(self.levels) <= k:
            self.levels.append(self._double(self.levels[-1], len(self.levels) - 1))
        level, own = self.levels[k], self._codes(piece)
        for j in range(k):
            own = self._double(own, j)
        if k not in self.orders:
            self.orders[k] = np.argsort(level, kind="stable")
        order = self.orders[k]
        at = order[np.searchsorted(level, own[0], "left", order) : np.searchsorted(level, own[0], "right", order)]
        tail = len(piece) - (1 << k)
        at = at[at + tail < len(level)]
        return at[level[at + tail] == own[-1]]


class Markup:
    """The text of a page without white space, and for each stretch of it the link and container it lies in."""

    __slots__ = ("text", "starts", "info", "left", "places")

    def __init__(self, source: str):
        parts: list[str] = []
        self.starts: list[int] = []
        self.info: list[tuple] = []
        stack: list[list] = []  # [tag, role, box]
        places: dict[str, list[int]] = {t: [] for t in _BLOCK_TAGS}  # where in the stack each tag is open

        def close(depth: int) -> None:
            while len(stack) > depth:
                places[stack.pop()[0]].pop()

        at = last = boxes = 0
        linked = False
        source = _uncommented(visible(source))
        for hit in _TAG.finditer(source):
            if hit.start() > last:
                at = self._add(parts, source[last : hit.start()], at, linked, stack)
            last = hit.end()
            tag = hit.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                linked = not hit.group(2)
                continue
            if tag not in _BLOCK_TAGS:
                continue
            linked = False
            if hit.group(2):
                if places[tag]:
                    close(places[tag][-1])
                continue
            while stack and stack[-1][0] in _IMPLIED_END:
                close(len(stack) - 1)
            if tag in _ENDS:
                ended, kept = _ENDS[tag]
                least = max((places[t][-1] for t in kept if places[t]), default=-1)
                first = [k for t in ended for k in places[t][-1:] if k > least]
                if first:
                    close(min(first))
            if tag in _VOID:
                continue
            inherited = stack[-1][1] if stack else 0
            box = stack[-1][2] if stack else 0
            role = -1 if tag in _NOISE_TAGS else 1 if tag in _MAIN_TAGS else 0
            attributes = hit.group(4)
            if attributes and "=" in attributes:
                for value in _ATTR.findall(attributes):
                    if _NOISE_TOKEN.search(value):
                        role = -1
                    elif role == 0 and _MAIN_TOKEN.search(value):
                        role = 1
            if tag in ("div", "section", "article", "main", "nav", "aside", "footer"):
                boxes += 1
                box = boxes
            places[tag].append(len(stack))
            stack.append([tag, role or inherited, box])
        if last < len(source):
            self._add(parts, source[last:], at, linked, stack)
        self.text = "".join(parts)
        self.left = SCANS * len(self.text)
        self.places: Places | None = None

    def _add(self, parts: list, raw: str, at: int, linked: bool, stack: list) -> int:
        piece = "".join((visible(_html.unescape(raw)) if "&" in raw else raw).split())
        if piece:
            parts.append(piece)
            self.starts.append(at)
            top = stack[-1] if stack else ("", 0, 0)
            self.info.append((linked, top[1], top[0], top[2]))
            at += len(piece)
        return at

    def find(self, piece: str, cursor: int) -> int:
        """Where ``piece`` stands, at or after ``cursor`` if it does, else anywhere; -1 if nowhere."""
        if self.left > 0:
            at = self.text.find(piece, cursor)
            self.left -= (at if at >= 0 else len(self.text)) - cursor
            if at < 0:
                at = self.text.find(piece)
                self.left -= at if at >= 0 else len(self.text)
            return at
        if len(piece) > len(self.text):
            return -1
        if self.places is None:
            self.places = Places(self.text)
        known = self.places.of(piece)
        first = int(np.searchsorted(known, cursor))
        for k in (*range(first, len(known)), *range(first)):
            if self.text.startswith(piece, int(known[k])):  # but for a clash of hashes the first does
                return int(known[k])
        return -1

    def describe(self, at: int, length: int) -> tuple[float, int, str, int]:
        """Link share, role, tag and container of ``length`` characters from ``at``."""
        k = bisect_right(self.starts, at) - 1
        linked, role, tag, box = self.info[k]
        end, in_link, stop = at + length, 0, len(self.starts)
        while k < stop and self.starts[k] < end:
            if self.info[k][0]:
                upper = self.starts[k + 1] if k + 1 < stop else len(self.text)
                in_link += min(upper, end) - max(self.starts[k], at)
            k += 1
        return in_link / length, role, tag, box


def blocks_of(text: str | None, markup: str | None, stopwords: frozenset) -> list[Block]:
    """The non-empty lines of ``text`` with their features."""
    out: list[Block] = []
    if not text:
        return out
    page = Markup(markup) if markup else None
    cursor = 0
    for number, raw in enumerate(visible(text).split("\n"), 1):
        line = " ".join(raw.split())
        if not line:
            continue
        low = fold(line)
        tokens = tokens_of(low)
        words = [t for t in tokens if t[0].isalpha()]
        digits = marks = 0
        if len(words) < len(tokens):
            figures = [t for t in tokens if t[0].isdigit()]
            digits = len("".join(figures))
            marks = len(tokens) - len(words) - len(figures) - tokens.count(STOP)
        stop = len([w for w in words if w in stopwords]) / len(words) if words else 0.0
        link, role, tag, box = -1.0, 0, "", -1
        if page is not None:
            piece = line.replace(" ", "")
            at = page.find(piece, cursor)
            if at >= 0:
                link, role, tag, box = page.describe(at, len(piece))
                cursor = at + len(piece)
        out.append(Block(number, line, low, words, codes_of(tokens), digits, marks, stop, link, role, tag, box))
    return out


def _menu_runs(blocks: list[Block]) -> None:
    """Three or more neighbouring lines of one to three words without an end of sentence are a menu."""
    k = 0
    while k < len(blocks):
        j = k
        while j < len(blocks) and len(blocks[j].words) <= 3 and len(blocks[j].text) <= 28 and not _SENTENCE_END.search(blocks[j].text) and not _BULLET.match(blocks[j].text) and not blocks[j].digits and blocks[j].role <= 0:
            j += 1
        if j - k >= 3:
            for b in blocks[k:j]:
                b.mark, b.why = BAD, "menu"
        k = max(j, k + 1)


def _is_menu_line(b: Block) -> bool:
    parts = _SEPARATED.split(b.text)
    return len(parts) >= 3 and len(b.words) <= 2.2 * len(parts) and b.stop < 0.34 and not b.digits


def _adjacent(blocks: list[Block], k: int) -> bool:
    """Whether line ``k`` follows or precedes another without an empty line in a text whose blocks are set apart by one."""
    if blocks[-1].line_no < 1.5 * len(blocks):
        return False
    here = blocks[k].line_no
    return k > 0 and blocks[k - 1].line_no == here - 1 or k + 1 < len(blocks) and blocks[k + 1].line_no == here + 1


def mark_blocks(blocks: list[Block], title: str | None, names: tuple, site_name: str | None) -> None:
    """Both passes. Sets ``mark`` to GOOD or BAD and ``why`` to the rule that decided."""
    wanted = fold(tidy(title)) if title else ""
    people = [fold(tidy(n)) for n in names if n and len(n) > 3]
    site = fold(tidy(site_name)) if site_name else ""
    tagged_main = any(b.role > 0 for b in blocks)
    _menu_runs(blocks)
    for k, b in enumerate(blocks):
        n = len(b.text)
        if b.mark == BAD:
            continue
        if k < 4 and wanted and b.low == wanted:
            b.mark, b.why = GOOD, "title"
        elif b.role < 0:
            b.mark, b.why = BAD, "container"
        elif b.opens > (IN_MAIN if b.role > 0 else 0):
            b.mark, b.why = BAD, "related"
        elif b.cue > (IN_MAIN if b.role > 0 else 0):
            b.mark, b.why = BAD, "words"
        elif _is_menu_line(b):
            b.mark, b.why = BAD, "menu"
        elif n <= 90 and people and any(p in b.low for p in people) and len(b.words) <= 9 and b.stop < 0.34 and not _SENTENCE_END.search(b.text):
            b.mark, b.why = BAD, "author"
        elif n <= 140 and site and len(site) > 5 and site in b.low and (b.stop < 0.55):
            b.mark, b.why = BAD, "site"
        elif b.link >= LINKED:
            b.mark, b.why = BAD, "link"
        elif _BULLET.match(b.text) or b.tag in ("li", "td", "th") or b.box < 0 and n < 130 and _adjacent(blocks, k):
            b.mark = ITEM
        elif b.tag in _HEADINGS or (n < 130 and not _SENTENCE_END.search(b.text.rstrip("?")) and not (b.text[0].islower() and b.stop >= STOP_HIGH and n >= SHORT)):
            b.mark = HEAD
        elif n >= LONG and b.stop >= STOP_HIGH:
            b.mark, b.why = GOOD, "prose"
        elif b.stop >= STOP_HIGH and n >= SHORT:
            b.mark, b.why = GOOD, "near"
        elif n >= LONG and b.stop >= STOP_LOW:
            b.mark, b.why = GOOD, "near"
        else:
            b.mark = OPEN
    _inherit(blocks, tagged_main)


def _inherit(blocks: list[Block], tagged_main: bool) -> None:
    first_pass = [b.mark if b.mark in (GOOD, BAD) else 0 for b in blocks]
    anything = GOOD in first_pass
    size = len(blocks)
    before, last = [-1] * size, -1
    for k in range(size):
        before[k] = last
        if first_pass[k]:
            last = k
    after, last = [-1] * size, -1
    for k in range(size - 1, -1, -1):
        after[k] = last
        if first_pass[k]:
            last = k
    for k, b in enumerate(blocks):
        if first_pass[k]:
            continue
        p, q, kind = before[k], after[k], b.mark
        b.why = "neighbour"
        if b.role > 0:
            b.mark = GOOD
            continue
        left = first_pass[p] if p >= 0 else 0
        right = first_pass[q] if q >= 0 else 0
        if kind == ITEM and (b.link == 0 or _BULLET.match(b.text)) and anything:
            b.mark = GOOD  # unlinked items belong to the piece
            continue
        if left == right:
            b.mark = left or GOOD
            continue
        if not left or not right:
            b.mark = left or right
            if kind == ITEM and b.mark == BAD and blocks[p if p >= 0 else q].why != "related":
                b.mark = GOOD
            continue
        # One side is the piece, the other site furniture.
        bad = blocks[p] if left == BAD else blocks[q]
        good = blocks[p] if left == GOOD else blocks[q]
        if b.box >= 0 and bad.box != good.box and b.box in (bad.box, good.box):
            b.mark = GOOD if b.box == good.box else BAD
        elif left == BAD and blocks[p].why == "related" and kind != ITEM:
            b.mark = BAD  # titles listed below a heading of related pieces
        elif kind == ITEM:
            b.mark = GOOD
        elif kind == HEAD and left == GOOD and blocks[q].why in ("link", "related"):
            b.mark = BAD  # a heading over links
        elif k - p == q - k:
            b.mark = GOOD if right == GOOD and kind == HEAD or left == GOOD else BAD
        else:
            b.mark = left if k - p < q - k else right
