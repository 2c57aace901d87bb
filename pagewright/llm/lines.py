"""Problem 2: lines repeated across one site's documents, by compressed bitmaps of document ids.

For each site and each spelling of a line, the ids of its documents are kept as a chunked
compressed bitmap: ids are cut into chunks of 32 768; a chunk holds the sorted 16-bit
positions that are set while they are few, or a dense bit string (`bitmap_construct_agg`'s
layout) from `DENSE_FROM` on. The bitmaps of the spellings of one line are united, the
cardinalities of the chunks add up exactly, and lines in at least `LEAST_RECORDS` documents
are deleted from a document by looking its bit up in the line's bitmap.

A chunk never exceeds 32 768 ids, so no group is unbounded however many documents a line is
in, and the lookup join is spread by chunk. Partial sets merge before each shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.lexicon import INVISIBLE
from pagewright.llm.pages import page_facts
from pagewright.llm.tables import read_table, site_of, stage

#: A line is repeated if it occurs in at least so many different records of a site.
LEAST_RECORDS = 5
#: Positions in a chunk from which it is stored as a dense bit string (4 096 bytes) instead of 2 bytes a position.
DENSE_FROM = 2048

_WHITE = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def unify(text: Column) -> Column:
    """A text with what does not tell lines apart removed, but for its line breaks: invisible signs, case, the digits of numbers.

    Each run of digits becomes one 0; case is folded by way of upper case, so that ß and SS agree.
    """
    return F.lower(F.upper(F.regexp_replace(F.translate(text, INVISIBLE, ""), r"\p{Nd}+", "0")))


def line_rows(pages: DataFrame) -> DataFrame:
    """(result_id, site, line_no, k1, k2, spelling) of each non-empty line; k1 and k2 hash the unified line without white space.

    A null text or one without visible characters has no lines; a null url is the site ''.
    """
    pages = pages.where(F.col("text_content").isNotNull())
    both = F.arrays_zip(F.split(F.col("text_content"), "\n", -1).alias("raw"), F.split(unify(F.col("text_content")), "\n", -1).alias("same"))
    rows = pages.select("result_id", F.xxhash64(site_of(F.col("url"))).alias("site"), F.posexplode(both).alias("at", "line"))
    same = F.regexp_replace(F.col("line.same"), _WHITE, "")
    rows = rows.select("result_id", "site", (F.col("at") + 1).alias("line_no"), same.alias("same"), F.xxhash64("line.raw").alias("spelling")).where("same != ''")
    return rows.select("result_id", "site", "line_no", F.xxhash64("same").alias("k1"), F.hash("same").alias("k2"), "spelling")


def _chunk(result_id: Column) -> Column:
    return F.bitmap_bucket_number(result_id)


def _position(result_id: Column) -> Column:
    return F.bitmap_bit_position(result_id).cast("short")


@F.pandas_udf(T.BinaryType())
def pack(positions: pd.Series) -> pd.Series:
    """The dense bit string of sorted positions: bit p of byte p // 8 is set, 4 096 bytes."""
    import numpy as np

    out = []
    for p in positions:
        bits = np.zeros(32768, np.uint8)
        bits[np.asarray(p, np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pd.Series(out)


def compress(chunks: DataFrame) -> DataFrame:
    """Chunks (positions array) with ``sparse`` or, from `DENSE_FROM` positions on, ``dense`` filled, the other null.

    Dense strings have the layout of `bitmap_construct_agg` and are packed only for the few chunks that need them.
    """
    dense = F.size("positions") >= DENSE_FROM
    return chunks.withColumns({"dense": F.when(dense, pack(F.when(dense, F.col("positions")).otherwise(F.array().cast("array<smallint>")))), "sparse": F.when(~dense, F.col("positions"))}).drop("positions")


def has_bit(position: Column) -> Column:
    """Whether a compressed chunk (columns sparse, dense) holds ``position``."""
    # hex digits of the byte that holds the bit
    byte = F.conv(F.hex(F.substring(F.col("dense"), (F.shiftright(position.cast("int"), 3) + 1), F.lit(1))), 16, 10).cast("int")
    dense = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(position as int) & 7)")) != 0
    return F.coalesce(dense, F.array_contains(F.col("sparse"), position), F.lit(False))


def line_bitmaps(rows: DataFrame) -> DataFrame:
    """(site, k1, k2, chunk, positions): the united bitmaps of all spellings of a line."""
    per_spelling = rows.groupBy("site", "k1", "k2", _chunk(F.col("result_id")).alias("chunk"), "spelling").agg(F.collect_set(_position(F.col("result_id"))).alias("ids"))
    return per_spelling.groupBy("site", "k1", "k2", "chunk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("positions"))


def repeated_lines(rows: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """(site, k1, k2, chunk, sparse, dense, records): compressed bitmaps of the lines in at least ``least`` records of their site."""
    from pyspark.sql import Window

    chunks = line_bitmaps(rows)
    whole = Window.partitionBy("site", "k1", "k2")
    counted = chunks.withColumn("records", F.sum(F.size("positions")).over(whole))
    return compress(counted.where(F.col("records") >= least))


def occurrences(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(result_id, line_no) of each occurrence of a repeated line: the record's bit is looked up in the line's bitmap."""
    placed = rows.select("result_id", "line_no", "site", "k1", "k2", _chunk(F.col("result_id")).alias("chunk"), _position(F.col("result_id")).alias("position"))
    return placed.join(bitmaps, ["site", "k1", "k2", "chunk"]).where(has_bit(F.col("position"))).select("result_id", "line_no")


def counted_rows(spark: SparkSession, base: str) -> DataFrame:
    """The staged lines of all records that are neither residue nor stuffed."""
    facts = page_facts(spark, base)
    kept = facts.where(~F.coalesce("residue", F.lit(False)) & ~F.coalesce("stuffed", F.lit(False))).select("result_id", "url", "text_content")
    return stage(line_rows(kept), "p2-lines")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """(result_id, line_no) of each occurrence of a line repeated within its site, records of residue and stuffed ones left out.

    Rows without result_id are no records; a null or empty text has no lines; a null url is
    the site ''; rows that repeat a result_id count as one record; an empty table gives none.
    """
    rows = counted_rows(spark, base)
    return occurrences(rows, repeated_lines(rows)).distinct()


def p2_all_lines(spark: SparkSession, base: str) -> DataFrame:
    """As `p2_found`, with no record left out: what the bitmaps alone give."""
    pages = read_table(spark, base, "extraction_results").where(F.col("result_id").isNotNull()).select("result_id", "url", "text_content")
    rows = stage(line_rows(pages), "p2-all-lines")
    return occurrences(rows, repeated_lines(rows)).distinct()


def p2_clean(spark: SparkSession, base: str) -> DataFrame:
    """Each record with its text without the repeated lines, and how many were deleted; records left out keep their text."""
    pages = read_table(spark, base, "extraction_results").where(F.col("result_id").isNotNull())
    hits = p2_found(spark, base).groupBy("result_id").agg(F.collect_set("line_no").alias("gone"))
    lines = F.split("text_content", "\n", -1)
    kept = F.expr("array_join(filter(split(text_content, '\\n', -1), (x, i) -> gone is null or not array_contains(gone, i + 1)), '\\n')")
    joined = pages.select("result_id", "text_content").join(hits, "result_id", "left")
    return joined.select("result_id", kept.alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_deleted"), F.coalesce(F.size(lines), F.lit(0)).alias("lines_before"))
