"""Problem 1: text statistics of each page's main body, placed in the corpus by mergeable quantile sketches.

A KLL sketch of each statistic is built per language (partial sketches merge, so no group
is ever gathered), medians and half-spreads are read from it, and each page's values become
percentiles and robust z-scores. Pages in the distribution tails are flagged: few common
words; fewer common words along with unusual word lengths; very many symbols; few words in
lines of prose, alone or along with few punctuated lines. A short
body varies more by chance, so its z-scores allow for the sampling error of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.pages import staged_facts
from pagewright.llm.tables import bounded_rows, read_table

STATISTICS = ("common_word_share", "mean_word_length", "symbol_ratio", "punct_line_share", "prose_word_share", "body_words")
#: Ranks kept of each sketch, close enough together for values between them to be placed by a straight line.
RANKS = tuple(k / 200 for k in range(1, 200))
#: A language's quantiles are drawn towards those of all languages as if it had so many pages of them beside its own.
PRIOR_PAGES = 20.0
#: Language codes have two or three letters (or are 'und'), so there are never more rows of quantiles than this.
MOST_LANGUAGES = 26**2 + 26**3 + 1
#: Smallest scale of each statistic that enters a z-score: what two bodies of prose differ by at least.
FLOORS = {"common_word_share": 0.012, "mean_word_length": 0.08, "symbol_ratio": 0.004, "punct_line_share": 0.1, "prose_word_share": 0.05}
#: Tail rules: z of common words alone; of common words with word length; of symbols; of prose words alone; of prose words with punctuated lines.
#: Set so that a sketch's error (1.4 % of the ranks) and the sampling error of a body of 40 words do not reach them.
Z_COMMON, Z_COMMON_LENGTH, Z_LENGTH, Z_SYMBOLS, Z_PROSE, Z_PROSE_PUNCT, Z_PUNCT = -5.0, -2.2, 4.0, 12.0, -9.0, -6.5, -2.0
#: Standard deviation of the length of a word, for the sampling error of its mean; words of a line, for that of shares of lines.
WORD_SD, LINE_WORDS = 2.5, 12.0


def sketch_quantiles(facts: DataFrame, prior: float = PRIOR_PAGES) -> DataFrame:
    """For each language: number of pages and for each statistic its quantiles at `RANKS`, drawn towards all languages as by ``prior`` pages of them.

    Partial sketches merge per language and again over languages; only quantiles, a bounded number of rows, reach the driver.
    """
    spark = facts.sparkSession
    bodies = facts.where(F.col("body_words") > 0)
    per = bodies.groupBy("base_lang").agg(F.count("*").alias("pages"), *(F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in STATISTICS))
    everything = per.agg(F.lit("*").alias("base_lang"), F.sum("pages").alias("pages"), *(F.kll_merge_agg_double(s).alias(s) for s in STATISTICS)).where("pages > 0")
    ranks = F.array(*(F.lit(float(r)) for r in RANKS))
    read = per.unionByName(everything).select("base_lang", "pages", *(F.kll_sketch_get_quantile_double(F.col(s), ranks).alias(s) for s in STATISTICS))
    rows = {r["base_lang"]: r for r in bounded_rows(read, MOST_LANGUAGES + 1, "languages")}
    whole = rows.pop("*", None)

    def drawn(row, name: str) -> list[float]:
        own = row["pages"] / (row["pages"] + prior)
        return [own * a + (1 - own) * b for a, b in zip(row[name], whole[name])]

    out = [(code, row["pages"], *(drawn(row, s) for s in STATISTICS)) for code, row in rows.items()]
    return spark.createDataFrame(out, "base_lang string, pages long, " + ", ".join(f"{s} array<double>" for s in STATISTICS))


def _at(quantiles: Column, rank: float) -> Column:
    return quantiles[RANKS.index(rank)]


def place(facts: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Facts with z-scores and percentiles in the distribution of their language.

    ``quantiles`` is a local table of known size, so Catalyst broadcasts it only below its threshold.
    """
    joined = facts.join(quantiles.select("base_lang", F.struct("pages", *STATISTICS).alias("q")), "base_lang", "left")
    words, chars = F.greatest(F.col("body_words"), F.lit(1)), F.greatest(F.col("body_chars"), F.lit(1))

    def z(name: str, low_side: bool, error: Column) -> Column:
        median = _at(F.col("q")[name], 0.5)
        # The half-spread on the side away from the flagged tail is not stretched by that tail.
        half = (median - _at(F.col("q")[name], 0.25)) if low_side else (_at(F.col("q")[name], 0.75) - median)
        scale = F.greatest(half / F.lit(0.6745), F.lit(FLOORS[name]))
        return (F.col(name) - median) / F.sqrt(scale * scale + error)

    def share_error(name: str, of: Column) -> Column:
        median = _at(F.col("q")[name], 0.5)
        return F.greatest(median * (F.lit(1.0) - median), F.lit(0.0)) / of

    out = joined.withColumns(
        {
            "z_common": z("common_word_share", False, share_error("common_word_share", words)),
            "z_length": z("mean_word_length", True, F.lit(WORD_SD * WORD_SD) / words),
            "z_symbols": z("symbol_ratio", True, share_error("symbol_ratio", chars)),
            "z_punct": z("punct_line_share", False, share_error("punct_line_share", words / LINE_WORDS)),
            "z_prose": z("prose_word_share", False, share_error("prose_word_share", words / LINE_WORDS)),
        }
    )
    return out.withColumns({f"pct_{name}": _percentile(F.col(name).cast("double"), F.col("q")[name]) for name in STATISTICS}).drop("q")


def _percentile(value: Column, quantiles: Column) -> Column:
    """The rank of a value among the quantiles, by a straight line between the two it lies between; null without quantiles."""
    below = F.size(F.filter(quantiles, lambda x: x <= value))
    low, high = F.element_at(quantiles, F.greatest(below, F.lit(1))), F.element_at(quantiles, F.least(below + 1, F.lit(len(RANKS))))
    part = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    step = F.lit(1.0 / (len(RANKS) + 1))
    return F.when(quantiles.isNull(), F.lit(None)).when(below == 0, F.lit(0.0)).when(below == len(RANKS), F.lit(1.0)).otherwise((below + part) * step)


def tail() -> Column:
    """Whether a placed page lies in the tails that tell lists, tables and junk from prose; a page without body does not."""
    few = F.col("z_common") <= Z_COMMON
    odd = (F.col("z_common") <= Z_COMMON_LENGTH) & (F.abs(F.col("z_length")) >= Z_LENGTH)
    symbols = F.col("z_symbols") >= Z_SYMBOLS
    broken = (F.col("z_prose") <= Z_PROSE) | (F.col("z_prose") <= Z_PROSE_PUNCT) & (F.col("z_punct") <= Z_PUNCT)
    return (F.col("body_words") > 0) & F.coalesce(few | odd | symbols | broken, F.lit(False)) | (F.col("body_words") == 0) & (F.col("body_chars") >= 20)


def flagged(facts: DataFrame) -> DataFrame:
    """``facts`` (staged, as it is read twice) with ``not_prose``: in a tail or stuffed, and no residue."""
    placed = place(facts, sketch_quantiles(facts))
    return placed.withColumn("not_prose", (tail() | F.coalesce(F.col("stuffed"), F.lit(False))) & ~F.coalesce(F.col("residue"), F.lit(False)))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """result_id of each record whose main body is no prose.

    A record without text or with site furniture alone is none; rows that repeat a result_id
    give it once; a null lang is read from the text; an empty table gives no rows.
    """
    facts = staged_facts(spark, base)
    return flagged(facts).where("not_prose").select("result_id").distinct()


def p1_stats(spark: SparkSession, base: str) -> DataFrame:
    """Each record's statistics, percentiles and z-scores, beside the latest audited figures of its url."""
    facts = staged_facts(spark, base)
    audits = (
        read_table(spark, base, "audit_entries")
        .where(F.col("diagnostics").isNotNull() & F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max_by(F.struct(F.col("diagnostics.avg_sentence_length").alias("audit_avg_sentence_length"), F.col("diagnostics.paragraphs").alias("audit_paragraphs")), F.struct("audited_at", "audit_id")).alias("audit"))
    )
    numbers = [*STATISTICS, "z_common", "z_length", "z_symbols", "z_punct", "z_prose", *(f"pct_{s}" for s in STATISTICS)]
    return flagged(facts).join(audits, "url", "left").select("result_id", "base_lang", *numbers, "not_prose", "audit.audit_avg_sentence_length", "audit.audit_paragraphs")
