"""Column functions for the page score: points, penalties, label, weakness and warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.constants import LABELS, LENGTH_POINTS


def _steps(value: Column, table, otherwise) -> Column:
    out = None
    for least, result in table:
        out = F.when(value >= least, F.lit(result)) if out is None else out.when(value >= least, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def length_points(length: Column) -> Column:
    return _steps(length, LENGTH_POINTS, 0)


def density_points(length: Column, sentences: Column) -> Column:
    """25 for 40 to 200 characters a sentence, 12 for 20 to 300, else 0; 0 without sentences."""
    average = length / F.when(sentences > 0, sentences)
    return F.coalesce(F.when(average.between(40, 200), F.lit(25)).when(average.between(20, 300), F.lit(12)), F.lit(0))


def link_penalty(density: Column) -> Column:
    return F.when(density > 0.5, F.lit(-20)).when(density > 0.3, F.lit(-10)).when(density > 0.15, F.lit(-5)).otherwise(F.lit(0))


def boilerplate_penalty(hits: Column) -> Column:
    return F.greatest(F.lit(-15), F.greatest(hits, F.lit(0)).cast("int") * F.lit(-3))


def metadata_points(title: Column, byline: Column, excerpt: Column, date: Column) -> Column:
    return F.when(title, 7).otherwise(0) + F.when(byline, 4).otherwise(0) + F.when(excerpt, 4).otherwise(0) + F.when(date, 5).otherwise(0)


def score(length: Column, sentences: Column, density: Column, hits: Column, title: Column, byline: Column, excerpt: Column, date: Column, readable: Column) -> Column:
    """The integer score, 0 to 100. Null figures count as 0, null flags as false."""
    zero = F.lit(0)
    flag = lambda c: F.coalesce(c, F.lit(False))
    length, sentences, density, hits = F.coalesce(length, zero), F.coalesce(sentences, zero), F.coalesce(density, F.lit(0.0)), F.coalesce(hits, zero)
    total = (
        length_points(length) + density_points(length, sentences) + link_penalty(density) + boilerplate_penalty(hits)
        + metadata_points(flag(title), flag(byline), flag(excerpt), flag(date)) + F.when(flag(readable), 15).otherwise(0)
    )
    return F.least(F.lit(100), F.greatest(zero, total)).cast("int")


def label(points: Column) -> Column:
    return _steps(points, LABELS, "failed")


def weak(points: Column, length: Column, density: Column) -> Column:
    """Under 45 points, under 300 characters with over 35 % links, or under 120 characters."""
    return (points < 45) | ((length < 300) & (density > 0.35)) | (length < 120)


def merged_warnings(*lists: Column) -> Column:
    """All warnings in order, each once."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def settle_budget(settle_ms: Column, timeout_ms: Column) -> Column:
    """Time for waiting on a page: the wanted time, at most what the timeout leaves after 2.5 s."""
    return F.least(settle_ms, F.greatest(F.lit(0), timeout_ms - F.lit(2500)))
