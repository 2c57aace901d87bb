"""When a page has settled, from polled observations of its text length, changes and open requests.

An observation is (page_id, t_ms, text_length, mutated, in_flight); the first one of a page
is the check before waiting. Times count from the first observation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SettleOptions:
    """Limits of a wait; `for_mode` gives the usual ones."""

    max_wait_ms: int = 1200
    stability_ms: int = 300
    min_text_length: int = 200
    fast_path: int = 3000
    idle_ms: int = 500
    min_wait_ms: int = 0
    network_idle: bool = False
    stable_polls: int = 3

    @classmethod
    def for_mode(cls, wait_until: str, settle_ms: int, timeout_ms: int) -> SettleOptions:
        budget = min(settle_ms, max(0, timeout_ms - 2500))
        if wait_until == "network-idle-like":
            return cls(budget, 600, 500, min_wait_ms=1000, network_idle=True)
        return cls(budget)


def in_flight(events: DataFrame) -> DataFrame:
    """(page_id, t_ms, seq, in_flight) after each event (page_id, t_ms, seq, delta): 1 as a request starts, -1 as it ends.

    An end without a start leaves the count at 0: the running sum is lifted by how far it
    ever fell below. Events of a time go by ``seq``; rows without page or time are left out.
    """
    upto = Window.partitionBy("page_id").orderBy("t_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where(F.col("page_id").isNotNull() & F.col("t_ms").isNotNull()).withColumn("total", F.sum(F.coalesce("delta", F.lit(0))).over(upto))
    return rows.select("page_id", "t_ms", "seq", (F.col("total") - F.least(F.lit(0), F.min("total").over(upto))).cast("int").alias("in_flight"))


def settle(observations: DataFrame, options: SettleOptions) -> DataFrame:
    """(page_id, reason, waited_ms, text_length) of each page: precheck, stabilized or timeout.

    A page is stable when its length was the same at enough polls in a row, nothing changed
    for the stability time, it has enough text, no request was open for the idle time (in
    that mode), and the least wait is over. Null lengths count as 0, null flags as none.
    """
    polls = Window.partitionBy("page_id").orderBy("t_ms")
    upto = polls.rowsBetween(Window.unboundedPreceding, 0)
    rows = observations.where(F.col("page_id").isNotNull() & F.col("t_ms").isNotNull()).dropDuplicates(["page_id", "t_ms"])
    rows = rows.select("page_id", "t_ms", F.coalesce("text_length", F.lit(0)).alias("length"), F.coalesce("mutated", F.lit(False)).alias("mutated"), F.coalesce("in_flight", F.lit(0)).alias("in_flight"))
    rows = rows.withColumns({"poll": F.row_number().over(polls) - 1, "elapsed": F.col("t_ms") - F.first("t_ms").over(upto), "before": F.lag("length").over(polls)})
    rows = rows.withColumn("run", F.sum((F.col("length") != F.coalesce("before", F.col("length"))).cast("int")).over(upto))
    in_run = Window.partitionBy("page_id", "run").orderBy("t_ms")
    # The check before waiting only sets the first length; a changed length is the first of its run.
    streak = F.row_number().over(in_run) - F.when(F.col("run") == 0, 1).otherwise(0)
    changed = F.max(F.when(F.col("mutated"), F.col("elapsed"))).over(upto)
    busy = F.max(F.when(F.col("in_flight") > 0, F.col("elapsed"))).over(upto)
    rows = rows.withColumns({"streak": streak, "quiet": F.col("elapsed") - F.coalesce(changed, F.lit(0)), "idle": F.col("elapsed") - F.coalesce(busy, F.lit(0))})
    ready = (F.col("poll") > 0) & (F.col("streak") >= options.stable_polls) & (F.col("quiet") >= options.stability_ms) & (F.col("length") >= options.min_text_length) & (F.col("elapsed") >= options.min_wait_ms)
    if options.network_idle:
        ready = ready & (F.col("in_flight") == 0) & (F.col("idle") >= options.idle_ms)
    fast = (F.col("poll") == 0) & (F.col("length") >= options.fast_path)
    within = (F.col("poll") == 0) | (F.col("elapsed") <= options.max_wait_ms)
    kept = rows.where(within)
    end = F.struct("elapsed", "length")
    out = kept.groupBy("page_id").agg(F.min(F.when(fast, end)).alias("fast"), F.min(F.when(ready, end)).alias("ready"), F.max(end).alias("last"))
    reason = F.when(F.col("fast").isNotNull(), "precheck").when(F.col("ready").isNotNull(), "stabilized").otherwise("timeout")
    chosen = F.coalesce("fast", "ready", "last")
    return out.select("page_id", reason.alias("reason"), chosen["elapsed"].alias("waited_ms"), chosen["length"].alias("text_length"))
