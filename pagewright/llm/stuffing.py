"""Problem 5: keyword-stuffed and link-list pages by a hidden Markov model over lines.

States are prose, list (ordinary lists, tables and headings), links, tags, menu and junk
(garbled or machine-made lines, which are no spam). A line emits eight discrete signs, independent given the state. Start, transition and
emission tables come from weakly labelled lines of a bounded sample, refined by hard
(Viterbi) re-estimation. A page is flagged when lines labelled links or tags hold more
than half of the words of its body; lines that the block rules call site furniture are
labelled along but not counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from pagewright.llm.blocks import BAD, Block

PROSE, LIST, LINKS, TAGS, MENU, JUNK = range(6)
STATES = ("prose", "list", "links", "tags", "menu", "junk")
#: Number of values of each sign, in the order of `signs_of`.
SIGNS = (4, 5, 7, 5, 5, 3, 4, 4)
#: Share of body words in links or tags from which a page is stuffed.
STUFFED_SHARE = 0.5

_SEPARATORS, _DASH = "#,;|/·•!", re.compile(r"\s[-–—]\s")
_SYMBOL = re.compile(r"[^\w\s#,|;/·•!\-–—.'’\"()?:%&«»“”„…]|[\u00c2\u00c3\u00e2\ufffd](?=[^a-zà-ÿ\s]|[\u00c2\u00c3])")
_MOJIBAKE = re.compile(r"[\u00c2\u00c3\u00e2\ufffd]")
_END = re.compile(r"[.!?…][\"'»“”’)\]]*$")
_URL = re.compile(r"(?:https?://|www\.)\S|^\S+\.(?:com|org|net|info|invalid|test|example)(?:/\S*)?$")


def signs_of(b: Block, repeated: float) -> tuple[int, ...]:
    """Link share, stop-word share, length, separators a word, repetition within the page, ending, and kind of content."""
    n = len(b.words)
    link = 0 if b.link < 0 else 1 if b.link < 0.05 else 2 if b.link < 0.5 else 3
    stop = 0 if b.stop == 0 else 1 if b.stop < 0.1 else 2 if b.stop < 0.2 else 3 if b.stop < 0.3 else 4
    size = 0 if n <= 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 12 else 4 if n <= 24 else 5 if n <= 48 else 6
    rate = separators(b) / max(1, n)
    sep = 0 if rate == 0 else 1 if rate < 0.12 else 2 if rate < 0.25 else 3 if rate < 0.45 else 4
    rep = 0 if repeated < 0.2 else 1 if repeated < 0.4 else 2 if repeated < 0.6 else 3 if repeated < 0.8 else 4
    end = 0 if _END.search(b.text) else 1 if b.text[:1].isupper() else 2
    kind = 3 if b.marks and _URL.search(b.low) else 2 if b.digits > 0.25 * len(b.text) or n == 0 else 1 if b.digits else 0
    return link, stop, size, sep, rep, end, kind, strangeness(b)


def separators(b: Block) -> int:
    """Commas, bars and the like, and dashes set apart by white space."""
    if not b.marks:
        return 0
    return sum(map(b.text.count, _SEPARATORS)) + len(_DASH.findall(b.text))


def strangeness(b: Block) -> int:
    """1 letters set apart, 2 many symbols, 3 overlong words, 0 none of these."""
    tokens = b.text.split(" ")
    if len(tokens) >= 6 and len(b.text) < 2.7 * len(tokens):
        return 1
    if len(b.text) > 8 and (b.marks > 0.05 * len(b.text) or not b.text.isascii() and _MOJIBAKE.search(b.text)) and len(_SYMBOL.findall(b.text)) > 0.05 * len(b.text):
        return 2
    return 3 if max(map(len, tokens)) > 30 and not _URL.search(b.low) else 0


def repetition(blocks: list[Block]) -> list[float]:
    """For each line the share of its words that occur at least four times in the page, common words left out."""
    counts = Counter(w for b in blocks for w in b.words)
    out = []
    for b in blocks:
        if not b.words:
            out.append(0.0)
            continue
        hits = sum(counts[w] >= 4 for w in b.words)
        out.append(max(0.0, hits / len(b.words) - b.stop))
    return out


def weak_state(b: Block, signs: tuple[int, ...]) -> int:
    """A rule's guess at the state of a line, -1 where it has none. It only starts the training."""
    link, stop, size, sep, rep, _, kind, strange = signs
    n = len(b.words)
    if link < 3 and (strange == 1 or strange and stop <= 2):
        return JUNK
    if b.mark == BAD and b.why == "menu" or link == 3 and n <= 2 and kind != 3:
        return MENU
    if kind == 3 and n <= 8 or link == 3 and n >= 3:
        return LINKS
    if stop >= 3 and size >= 3 and sep <= 2:
        return PROSE
    if stop <= 1 and rep >= 3 and size >= 4:
        return TAGS
    if stop <= 1 and sep >= 3 and rep >= 2 and size >= 4:
        return TAGS
    if link in (0, 1) and stop <= 2 and (kind == 2 or size <= 3 and rep <= 2):
        return LIST
    return -1


@dataclass
class LineModel:
    """Logarithms of start (S), transition (S, S) and emission (a table S x values for each sign)."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def scores(self, signs: np.ndarray) -> np.ndarray:
        return sum(table[:, signs[:, k]].T for k, table in enumerate(self.emit))

    def path(self, signs: np.ndarray) -> np.ndarray:
        """The likeliest states of a page's lines (Viterbi)."""
        n = len(signs)
        if not n:
            return np.zeros(0, np.int8)
        emitted = self.scores(signs)
        best, back = self.start + emitted[0], np.zeros((n, len(STATES)), np.int8)
        for t in range(1, n):
            reach = best[:, None] + self.move
            back[t] = reach.argmax(0)
            best = reach.max(0) + emitted[t]
        out = np.zeros(n, np.int8)
        out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def _estimate(pages: list[tuple[np.ndarray, np.ndarray]], smooth: float = 0.5) -> LineModel:
    size = len(STATES)
    start, move = np.full(size, 1.0), np.full((size, size), 1.0)
    emit = [np.full((size, k), smooth) for k in SIGNS]
    for signs, states in pages:
        known = states >= 0
        if known.any():
            for k, table in enumerate(emit):
                np.add.at(table, (states[known], signs[known, k]), 1.0)
            if known[0]:
                start[states[0]] += 1
            both = known[1:] & known[:-1]
            np.add.at(move, (states[:-1][both], states[1:][both]), 1.0)
    return LineModel(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in emit])


def read_signs(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of a page's lines, a row a line, and the weak guesses at their states."""
    rows = [signs_of(b, r) for b, r in zip(blocks, repetition(blocks))]
    return np.array(rows, np.int64).reshape(-1, len(SIGNS)), np.array([weak_state(b, s) for b, s in zip(blocks, rows)], np.int64)


def fit_line_model(pages: Iterable[tuple[bytes, bytes]], rounds: int = 2) -> LineModel:
    """Train on the signs and weak guesses of pages, one byte each: first on the guesses, then by hard re-estimation
    on the decoded states, where a guess, if there is one, is kept. Each page is also shown with its markup withheld,
    so that pages without markup are read from the shape of their lines."""
    signs, weak = [], []
    for lines, guesses in pages:
        guess = np.frombuffer(guesses, np.int8).astype(np.int64)
        if not len(guess):
            continue
        seen = np.frombuffer(lines, np.int8).astype(np.int64).reshape(-1, len(SIGNS))
        bare = seen.copy()
        bare[:, 0] = 0
        signs += [seen, bare]
        weak += [guess, guess]
    model = _estimate(list(zip(signs, weak)))
    for _ in range(rounds):
        decoded = [np.where(w >= 0, w, model.path(s)) for s, w in zip(signs, weak)]
        model = _estimate(list(zip(signs, decoded)))
    return model


def states_of(blocks: list[Block], model: LineModel) -> np.ndarray:
    rows = [signs_of(b, r) for b, r in zip(blocks, repetition(blocks))]
    return model.path(np.array(rows, np.int64).reshape(-1, len(SIGNS)))


#: Rules of site furniture that say nothing about a line being a link of the page itself.
FURNITURE = frozenset(("container", "words", "related", "author", "site", "menu", "title"))


def body_flags(blocks: list[Block]) -> list[bool]:
    """Which lines count as body here: not site furniture, and not the links listed below a heading of related pieces."""
    out, listed = [], False
    for b in blocks:
        if b.why in FURNITURE or (b.mark == BAD and b.role < 0):
            listed = b.why == "related"
            out.append(False)
        elif listed and (b.link >= 0.5 or b.mark == BAD):
            out.append(False)
        else:
            listed = False
            out.append(True)
    return out


def is_stuffed(blocks: list[Block], states: np.ndarray, body: list[bool]) -> bool:
    """Whether lines of links or tags hold at least half of the body's words. A page without body is not stuffed."""
    total = spam = 0
    for b, state, counts in zip(blocks, states, body):
        if counts:
            n = max(1, len(b.words))
            total += n
            spam += n if state in (LINKS, TAGS) else 0
    return total > 0 and spam >= STUFFED_SHARE * total
