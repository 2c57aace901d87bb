"""Column functions on markup that need no document tree: text length and link density by tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import collapse


def tag_text(markup: Column) -> Column:
    """Markup without tags, white space collapsed; '' for null."""
    return collapse(F.regexp_replace(F.coalesce(markup, F.lit("")), r"<[^>]*>", ""))


def tag_link_density(markup: Column) -> Column:
    """Characters within links over all characters, at most 1, rounded to 6 places; 0 without text."""
    anchors = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?is)<a(?:\s[^>]*)?>(.*?)</a>"), F.lit(1))
    linked = F.aggregate(anchors, F.lit(0), lambda n, a: n + F.length(tag_text(a)))
    total = F.length(tag_text(markup))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), linked / total), 6))
