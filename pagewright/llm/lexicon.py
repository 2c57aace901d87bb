"""Small helpers on text."""

from __future__ import annotations

import unicodedata

#: Characters that readers do not see: zero-width signs, soft hyphen, byte order mark.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def visible(text: str) -> str:
    """``text`` without invisible characters."""
    for sign in INVISIBLE:
        if sign in text:
            text = text.replace(sign, "")
    return text


def tidy(text: str) -> str:
    """Visible text with each run of white space as one space, trimmed."""
    return " ".join(visible(text).split())


def squash(text: str) -> str:
    """Visible text without any white space; used to align lines with markup."""
    return "".join(visible(text).split())


def fold(text: str) -> str:
    """Lower case with ß as ss, as upper-casing and back gives."""
    return text.upper().lower()


def plain_ascii(text: str) -> str:
    """Letters without accents, for comparing names."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
