"""Token counts with a public tokenizer. The vocabulary file's path is a parameter; files are never copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The byte-level BPE used where no other file is given.
DEFAULT_VOCABULARY = os.environ.get("PAGEWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the vocabulary's tokenizer cuts text into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Texts are tokenised in stretches of at most so many characters, cut before white space: merges never cross it, so counts are exact and long texts take linear time.
STRETCH = 20_000


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    try:
        import public_tokenizers

        pattern = getattr(public_tokenizers, "PATTERN", PIECES)
    except ImportError:
        pattern = PIECES
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of ``text``; 0 for null or empty text."""
    if not text:
        return 0
    coder = encoding(path)
    return sum(len(coder.encode_ordinary(piece)) for piece in stretches(text))


def stretches(text: str):
    """``text`` in pieces cut before a single space between two letters; where there is none the piece goes on."""
    start = 0
    while len(text) - start > STRETCH:
        cut = start + STRETCH
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def token_counter(path: str = DEFAULT_VOCABULARY):
    """A column function giving the token count of a text."""

    def run(text: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t if isinstance(t, str) else None, path) for t in text], dtype="int64")

    return F.pandas_udf(run, T.LongType()).asNondeterministic()
