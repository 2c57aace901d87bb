"""Column functions on text: white space, truncation, counts, boilerplate and noise. Only NFKC needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.constants import BOILERPLATE, NOISE

#: White space as browsers see it; Java's \s is ASCII only.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Word boundaries by ASCII letters, as Java's \b also counts letters beyond ASCII.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, in Arrow batches; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def collapse(text: Column) -> Column:
    """Each run of white space as one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), r"^ | $", "")


def clean_string(text: Column) -> Column:
    """Collapsed text, null where nothing is left."""
    return F.nullif(collapse(text), F.lit(""))


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word's end; '' where the first word is longer."""
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    chunk = F.substring(text, 1, limit)
    whole = F.length(text) <= limit
    at_break = F.substring(text, limit + 1, 1).rlike(SPACE)
    to_break = F.regexp_extract(chunk, r"(?s)^(.+)[ \n\r\t]", 1)
    tail = rf"{SPACE}+\z"
    return F.when(whole, text).when(at_break, F.regexp_replace(chunk, tail, "")).otherwise(F.regexp_replace(to_break, tail, ""))


def normalize_lines(text: Column) -> Column:
    """Horizontal white space collapsed, at most one empty line in a row, lines and text trimmed."""
    flat = F.regexp_replace(text, r"[ \t\x0B\f\r\x{00A0}]+", " ")
    few = F.regexp_replace(flat, r"\n{3,}", "\n\n")
    lines = F.regexp_replace(F.regexp_replace(few, r" *\n *", "\n"), r"^ +| +\z", "")
    return trim_white(lines)


def normalize_text(text: Column, limit: int | None, compose: bool = True) -> Column:
    """NFKC, normalised lines, truncation at a word unless ``limit`` is None. ``compose=False`` skips NFKC where texts are known to be composed, and with it Python."""
    lines = normalize_lines(nfkc(text) if compose else text)
    return lines if limit is None else truncate_words(lines, limit)


def sentence_count(text: Column) -> Column:
    """Runs of . ! ? before white space or the end."""
    return F.regexp_count(text, F.lit(rf"[.!?]+(?:{SPACE}|\z)")).cast("long")


def boilerplate_pattern(phrase: str) -> str:
    return f"(?i){LEFT}(?:{phrase}){RIGHT}"


def stem(pattern: str) -> str:
    """The longest piece of plain text, in lower case, that every match of a pattern contains; '' where its top level has alternatives.

    Groups, classes, escapes and quantified signs end a piece.
    """
    pieces, piece, depth, skip = [], "", 0, False
    for c in pattern:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
            pieces.append(piece)
            piece = ""
        elif c in "([{":
            if c == "{":
                piece = piece[:-1]
            depth += 1
            pieces.append(piece)
            piece = ""
        elif c in ")]}":
            depth -= 1
        elif depth:
            continue
        elif c == "|":
            return ""
        elif c in "?*":
            pieces.append(piece[:-1])
            piece = ""
        elif c == "+":
            pieces.append(piece)
            piece = ""
        else:
            piece += c
    return max([*pieces, piece], key=len).lower()


def _present(text: Column, low: Column, pattern: str, regex: str) -> Column:
    """Whether ``regex`` matches, tried only where the pattern's stem occurs: a substring search is far cheaper than a scan by regex."""
    piece = stem(pattern)
    return F.when(low.contains(piece), text.rlike(regex)).otherwise(F.lit(False)) if piece else text.rlike(regex)


def boilerplate_hits(text: Column) -> Column:
    """How many of the boilerplate phrases occur at least once."""
    low = F.lower(text)
    return sum((_present(text, low, p, boilerplate_pattern(p)).cast("long") for p in BOILERPLATE), F.lit(0).cast("long"))


def _noise(pattern: str, prefix: str = "") -> str:
    """A noise pattern as Java reads it, white space and digits ASCII only; case counts only for the copyright sign's pattern."""
    body = pattern.replace(r"\s", r"[ \t\n\r\f]").replace(r"\d", "[0-9]")
    flags = "s" if pattern.startswith("©") else "is"
    return f"(?{flags}){prefix}({body})"


def noise_hits(text: Column) -> Column:
    """Array of (noise_pattern, matched_text, near_text) for each noise pattern's first match, with 40 characters around it."""
    entries = []
    for pattern in NOISE:
        matched = F.regexp_extract(text, _noise(pattern), 1)
        start = F.length(F.regexp_extract(text, _noise(pattern, "^(.*?)"), 1))
        low = F.greatest(start - 40, F.lit(0))
        near = F.regexp_replace(F.substring(text, low + 1, start - low + F.length(matched) + 40), "\n", " ")
        entry = F.struct(F.lit(pattern).alias("noise_pattern"), matched.alias("matched_text"), near.alias("near_text"))
        entries.append(F.when(text.rlike(_noise(pattern)), entry))
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def noise_count(text: Column) -> Column:
    """How many noise patterns match."""
    low = F.lower(text)
    return sum((_present(text, low, p, _noise(p)).cast("long") for p in NOISE), F.lit(0).cast("long"))


def paragraph_count(text: Column) -> Column:
    """Paragraphs, parted by empty lines, of more than 50 characters."""
    return F.size(F.filter(F.split(text, r"\n\n+"), lambda p: F.length(trim_white(p)) > 50)).cast("long")


def average_sentence_words(text: Column) -> Column:
    """Rounded words a sentence over stretches that end in . ! or ?; 0 without any."""
    sentences = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+"), F.lit(0))
    words = F.aggregate(sentences, F.lit(0), lambda total, s: total + F.size(F.split(trim_white(s), f"{SPACE}+")))
    return F.when(F.size(sentences) == 0, F.lit(0).cast("long")).otherwise(F.floor(words / F.size(sentences) + F.lit(0.5)).cast("long"))


# Substrings that keep a sentence out of a sample.
SAMPLE_STOP = ("cookie", "subscribe", "newsletter", "privacy policy", "terms of service", "advertisement", "sign up", "follow us", "all rights reserved", "copyright")


def text_sample(text: Column, count: int = 5) -> Column:
    """The first ``count`` sentences of 31 to 299 characters that hold none of the substrings above. For markup, pass `bare_text`."""
    sentences = F.transform(F.regexp_extract_all(collapse(text), F.lit(r"[^.!?]+[.!?]+"), F.lit(0)), lambda s: F.trim(s))
    return F.slice(F.filter(sentences, lambda s: (F.length(s) > 30) & (F.length(s) < 300) & ~F.lower(s).rlike("|".join(SAMPLE_STOP))), 1, count)


def bare_text(markup: Column) -> Column:
    """Markup without scripts, styles and tags, white space collapsed; entities stay."""
    return collapse(F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", ""), r"<[^>]+>", " "))
