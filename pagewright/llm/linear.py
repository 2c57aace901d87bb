"""Hashed word n-grams of many stretches of text at once, and the regularised linear classifier over them.

Tokens become 32-bit hashes, n-grams are mixed from neighbouring hashes, and both scoring
and fitting work on whole arrays: a stretch is a run of tokens, and no n-gram crosses its
ends. A stretch's n-grams together have length 1, beside its heavier signs (length, title
and setting features), so long and short stretches weigh alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from itertools import chain

import numpy as np

#: Size of the hashed feature space.
DIMENSIONS = 1 << 17
#: Value of all signs of a stretch together against 1 of all its n-grams.
SIGN_WEIGHT = 0.9
#: Words, numbers (all of three digits stay, others are one), signs, and the end of a sentence.
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\x1e|[^\w\s]|_")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[.!?…][\"'»“”’)\]])\s+(?=\S)")
#: Tokens whose hashes are remembered at a time.
MOST_KNOWN = 200_000
#: The token that ends a sentence, and its hash.
STOP, END = "\x1e", 0x9E3779B1

_known: dict[str, int] = {}


def _hash(token: str) -> int:
    if token == STOP:
        code = END
    elif token[0].isdigit():
        code = zlib.crc32(token.encode()) if len(token) == 3 else zlib.crc32(b"0")
    else:
        code = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    if len(_known) >= MOST_KNOWN:
        _known.clear()
    _known[token] = code
    return code


def tokens_of(low: str) -> list[str]:
    """The tokens of a folded line, the ends of its sentences as \\x1e."""
    return TOKEN.findall(_SENTENCE.sub(STOP, low))


def codes_of(tokens: list[str]) -> list[int]:
    known = _known.get
    return [known(t) or _hash(t) for t in tokens]


class Stretches:
    """Token hashes of many stretches one after the other, and where each starts; ``signs`` are extra hashes of a stretch."""

    def __init__(self, codes: Iterable[list[int]], signs: Iterable[tuple[int, ...]]):
        lists, extra = list(codes), list(signs)
        sizes, sign_sizes = (np.fromiter(map(len, x), np.int32, len(x)) for x in (lists, extra))
        self._set(np.fromiter(chain.from_iterable(lists), np.uint64, int(sizes.sum())), sizes, np.fromiter(chain.from_iterable(extra), np.uint64, int(sign_sizes.sum())), sign_sizes)

    @classmethod
    def flat(cls, codes: np.ndarray, sizes: np.ndarray, signs: np.ndarray, sign_sizes: np.ndarray) -> Stretches:
        """From all hashes in a row and the number of each stretch's."""
        made = cls.__new__(cls)
        made._set(codes.astype(np.uint64), sizes, signs.astype(np.uint64), sign_sizes)
        return made

    def _set(self, codes: np.ndarray, sizes: np.ndarray, signs: np.ndarray, sign_sizes: np.ndarray) -> None:
        self.rows, self.codes, self.sign_codes = len(sizes), codes, signs
        self.row = np.repeat(np.arange(self.rows, dtype=np.int32), sizes)
        self.sign_row = np.repeat(np.arange(self.rows, dtype=np.int32), sign_sizes)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, index, value) of all features, in the order of rows within each kind."""
        c, row = self.codes, self.row
        where, index = [row], [_slot(c, 1)]
        if len(c) > 1:
            both = row[1:] == row[:-1]
            pair = c[:-1] * np.uint64(0xD6E8FEB86659FD93) + c[1:]
            where.append(row[1:][both])
            index.append(_slot(pair[both], 2))
            if len(c) > 2:
                three = row[2:] == row[:-2]
                triple = pair[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
                where.append(row[2:][three])
                index.append(_slot(triple[three], 3))
        grams = np.concatenate(where)
        count = np.bincount(grams, minlength=self.rows)
        value = (1.0 / np.sqrt(np.maximum(count, 1)))[grams]
        if len(self.sign_row):
            signs = np.bincount(self.sign_row, minlength=self.rows)
            where.append(self.sign_row)
            index.append(_slot(self.sign_codes, 5))
            value = np.concatenate([value, (SIGN_WEIGHT / np.sqrt(np.maximum(signs, 1)))[self.sign_row]])
        return np.concatenate(where), np.concatenate(index), value.astype(np.float32)


def _slot(mixed: np.ndarray, kind: int) -> np.ndarray:
    mixed = (mixed + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)).astype(np.int32) & (DIMENSIONS - 1)


def score(stretches: Stretches, *weights: np.ndarray) -> list[np.ndarray]:
    """Each classifier's score of each stretch; above 0 it is taken for a case."""
    if not stretches.rows:
        return [np.zeros(0) for _ in weights]
    row, index, value = stretches.features()
    return [np.bincount(row, w[index] * value, minlength=stretches.rows) + float(w[-1]) for w in weights]


def fit(stretches: Stretches, labels: np.ndarray, epochs: int = 10, batch: int = 512, rate: float = 0.5, l2: float = 2e-6, lift: float = 8.0, seed: int = 7, trust: np.ndarray | None = None) -> np.ndarray:
    """L2-regularised logistic regression by AdaGrad over small batches; the last weight is the intercept.

    A label of -1 is none. A case counts up to ``lift`` times a non-case where cases are
    rare; ``trust`` is what a label counts beside that. Without any case the classifier takes
    nothing for a case.
    """
    weights = np.zeros(DIMENSIONS + 1, np.float32)
    labels = np.asarray(labels, np.float32)
    known = np.flatnonzero(labels >= 0)
    if not len(known) or not (labels == 1).any():
        weights[-1] = -1.0
        return weights
    row, index, value = stretches.features()
    by = np.argsort(row, kind="stable")
    row, index, value = row[by], index[by], value[by]
    begin = np.searchsorted(row, np.arange(stretches.rows + 1))
    lift = min(lift, max(1.0, float((labels == 0).sum() / (labels == 1).sum())))
    counts = np.where(labels > 0, lift, 1.0) * (1.0 if trust is None else trust)
    square = np.full(DIMENSIONS + 1, 1e-3, np.float32)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(known)
        for chunk in range(0, len(order), batch):
            rows = order[chunk : chunk + batch]
            sizes = begin[rows + 1] - begin[rows]
            own = np.repeat(np.arange(len(rows)), sizes)
            place = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
            at, x = index[place], value[place]
            margin = np.bincount(own, weights[at] * x, minlength=len(rows)) + weights[-1]
            error = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]
            error *= counts[rows]
            gradient = np.bincount(at, error[own] * x, minlength=DIMENSIONS + 1).astype(np.float32)
            gradient[-1] = error.sum()
            gradient[:-1] += np.float32(l2 * len(rows)) * weights[:-1]
            square += gradient * gradient
            weights -= np.float32(rate) * gradient / np.sqrt(square)
            weights[-1] = min(weights[-1], 0.0)  # what it knows nothing of is no case
    return weights
