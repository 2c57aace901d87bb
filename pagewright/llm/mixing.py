"""Problem 7: mixing sources to target shares of the total size.

Tokens are summed per source; each source's repetition rate follows from its target share,
and a document is emitted floor(rate) times plus once more with a probability equal to the
rate's fraction, decided by a hash of its id. The size of the mix is the largest at which
no source needs a record more often than it may be used. Targets of sources without
records cannot be met: the others keep their proportions, and the shares that come out
are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.tables import bounded_rows, fingerprint, once, read_table, stage, tune
from pagewright.llm.tokens import token_counter

#: Target shares are a small fixed table.
MOST_TARGETS = 10_000
SEED = 20_240_607


def source_key(source: Column) -> Column:
    """A source's name in one spelling: lower case, outer blanks gone, inner blanks and hyphens as underscores. Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""), r"[\s\x{00A0}-]+", "_")


def repetition_rates(tokens: dict[str, int], targets: list[tuple[str, float, int]], size: float | None = None) -> dict[str, float]:
    """Copies per record of each source. ``size`` is the wanted total; by default, and at most, the largest that keeps all shares.

    Sources with no tokens, no positive share or no allowed use get 0.
    """
    live = [(s, w, m) for s, w, m in targets if tokens.get(s, 0) > 0 and w and w > 0 and m and m > 0]
    if not live:
        return {s: 0.0 for s, _, _ in targets}
    weight = sum(w for _, w, _ in live)
    most = min(m * tokens[s] / (w / weight) for s, w, m in live)
    total = most if size is None else min(size, most)
    rates = {s: 0.0 for s, _, _ in targets}
    for s, w, m in live:
        rates[s] = min(float(m), w / weight * total / tokens[s])
    return rates


def copies(doc_id: Column, rate: Column) -> Column:
    """floor(rate), plus 1 if the document's hash falls below the fraction."""
    whole = F.floor(rate + F.lit(1e-9))
    chance = F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (whole + (chance < (rate - whole)).cast("int")).cast("int")


def sized_documents(spark: SparkSession, base: str) -> DataFrame:
    tune(spark)
    documents = read_table(spark, base, "documents").where(F.col("doc_id").isNotNull())
    sizes = documents.select("doc_id", source_key(F.col("source")).alias("source"), token_counter()("text").alias("n_tokens"))
    return once(spark, ("sizes", *fingerprint(spark, base, "documents")), lambda: stage(sizes, "p7-sizes"))


def _targets(spark: SparkSession, base: str) -> list[tuple[str, float, int]]:
    table = read_table(spark, base, "mix_targets").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    merged: dict[str, tuple] = {}
    for r in bounded_rows(table, MOST_TARGETS, "mix_targets"):
        share, repeats = merged.get(r["source"], (0.0, None))
        allowed = r["max_repeats"] if r["max_repeats"] is not None else 1
        merged[r["source"]] = (share + (r["target_share"] or 0.0), allowed if repeats is None else min(repeats, allowed))
    return [(s, w, m) for s, (w, m) in merged.items()]


def _rated(spark: SparkSession, sized: DataFrame, targets: list) -> DataFrame:
    """The target table with each source's tokens and rate; at most one row a target, so it is broadcast."""
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    sums = sized.join(F.broadcast(wanted), "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    have = {r["source"]: (r["tokens"] or 0, r["records"]) for r in sums.collect()}  # one row a target
    rates = repetition_rates({s: t for s, (t, _) in have.items()}, targets)
    rows = [(s, float(w), int(m), int(have.get(s, (0, 0))[0]), int(have.get(s, (0, 0))[1]), float(rates[s])) for s, w, m in targets]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens long, source_records long, rate double")


def _mixed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    sized, targets = sized_documents(spark, base), _targets(spark, base)
    rated = _rated(spark, sized, targets)
    picked = sized.join(F.broadcast(rated.select("source", "rate", "max_repeats")), "source").withColumn("copies", F.least(copies(F.col("doc_id"), F.col("rate")), F.col("max_repeats")))
    return picked.where("copies > 0"), rated


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    """One row for each use of a record: doc_id, source, copy_no from 1, n_tokens.

    Records of a null source or one without a target are in no mix; a null text has 0 tokens;
    rows that repeat a doc_id are drawn alike; an empty table gives no rows.
    """
    picked, _ = _mixed(spark, base)
    return picked.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    """For each target source: its target share, its tokens and records, the rate, the share it really has in the mix, and the standard error of that share.

    The one random copy of a document of n tokens has variance f(1 - f)n², f the fraction of
    the rate; ``share_error`` is the root of their sum over the source, as a share of the mix.
    """
    picked, rated = _mixed(spark, base)
    return _shares(picked, rated, _chance(spark, base, rated))


def _chance(spark: SparkSession, base: str, rated: DataFrame) -> DataFrame:
    """(source, variance) of the tokens that each source's random copies add."""
    sizes = sized_documents(spark, base).join(F.broadcast(rated.select("source", "rate")), "source")
    part = F.col("rate") - F.floor(F.col("rate") + F.lit(1e-9))
    return sizes.groupBy("source").agg(F.sum(part * (F.lit(1.0) - part) * F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("variance"))


def _shares(picked: DataFrame, rated: DataFrame, chance: DataFrame) -> DataFrame:
    used = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_records"), F.max("copies").alias("most_uses"))
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # over one row a target
    joined = rated.join(used, "source", "left").join(chance, "source", "left").withColumn("total", F.coalesce(total, F.lit(0)))
    mixed, whole = F.coalesce("mixed_tokens", F.lit(0)), F.greatest("total", F.lit(1))
    return joined.select(
        "source", "target_share", "max_repeats", "source_tokens", "source_records", F.round("rate", 6).alias("rate"), mixed.alias("mixed_tokens"),
        F.coalesce("mixed_records", F.lit(0)).alias("mixed_records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(mixed / whole, 6).alias("actual_share"),
        F.round(F.sqrt(F.greatest(F.coalesce("variance", F.lit(0.0)), F.lit(0.0))) / whole, 6).alias("share_error"),
    )


def p7_checks(spark: SparkSession, base: str) -> DataFrame:
    """For each target source what must hold of the mix whatever the tokens: its records, that none is used too often, and that its share is met.

    Shares are met within five standard errors, among the sources that have records.
    """
    shares = p7_shares(spark, base)
    live = F.sum(F.when(F.col("source_tokens") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # over one row a target
    wanted = F.when(F.col("source_tokens") > 0, F.col("target_share") / live).otherwise(F.lit(0.0))
    error = F.greatest(F.lit(5.0) * F.sqrt(F.sum(F.col("share_error") * F.col("share_error")).over(Window.partitionBy(F.lit(0)))), F.lit(1e-4))
    return shares.select("source", "source_records", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("actual_share") - wanted) <= error).alias("share_met"))
