"""Problem 6: filling fixed-capacity containers along a Hilbert curve through hashed document vectors.

Each text becomes a hashed bag of words, projected by random signs to `DIMS` dimensions;
the cell it falls in gets its place on a Hilbert curve. Documents are range-sorted by that
place, so a partition holds one stretch of the curve, and each stretch is packed on its
own: windows of neighbouring documents are fitted best-fit-decreasing into open containers,
of which a bounded number is carried on to the next window. A text is split only if it
alone exceeds the capacity: into full containers and one remainder, which is packed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.tables import bounded_rows, read_table, stage, tune
from pagewright.llm.tokens import DEFAULT_VOCABULARY, count_tokens

#: Dimensions of the projection and bits of each in the Hilbert key.
DIMS, BITS = 4, 12
#: Items fitted at a time, and containers kept open from one window to the next.
WINDOW, OPEN = 2048, 128
#: Items of a partition. A partition leaves at most `OPEN` containers that are not closed as full.
PARTITION_ITEMS = 20_000
#: Container sizes are a small fixed table.
MOST_SPECS = 1000

_WORDS = re.compile(r"\w{3,}")


def project(text: str | None) -> np.ndarray:
    """The hashed words of a text, each with random signs, summed and divided by the root of their number. Zeros for no words."""
    words = _WORDS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(DIMS)
    hashed = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
    mixed = (hashed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    signs = ((mixed[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return signs.sum(0) / np.sqrt(len(words))


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of rows of real coordinates, by transposing the axes (Skilling 2004).

    Coordinates are squashed to (0, 1) by a logistic curve first, so every real point has a cell.
    """
    cells = (1.0 / (1.0 + np.exp(-np.clip(points, -30, 30))) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
    x = cells.T.copy()
    n, m = len(x), 1 << (BITS - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


_SIZED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("curve", T.LongType())])


def sized_stage(vocabulary: str = DEFAULT_VOCABULARY):
    """Token count and place on the curve of each text."""

    def run(text: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else None for t in text]
        points = np.array([project(t) for t in texts]).reshape(-1, DIMS)
        return pd.DataFrame({"n_tokens": np.array([count_tokens(t, vocabulary) for t in texts], np.int64), "curve": hilbert_keys(points)})

    return F.pandas_udf(run, _SIZED).asNondeterministic()


class Packer:
    """Containers of one capacity, filled from a stream of (key, size) with size at most the capacity."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.free: list[tuple[int, int]] = []  # (room left, container), sorted
        self.fill: dict[int, int] = {}

    def pack(self, sizes: list[int]) -> list[tuple[int, int]]:
        """(container, offset) of each item of a window. Ties keep their order along the curve."""
        out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            size = sizes[k]
            at = bisect_left(self.free, (size, -1))
            if at < len(self.free):
                room, box = self.free.pop(at)
            else:
                room, box = self.capacity, self.next
                self.next += 1
                self.fill[box] = 0
            out[k] = (box, self.fill[box])
            self.fill[box] += size
            if room > size:
                insort(self.free, (room - size, box))
            else:
                del self.fill[box]
        while len(self.free) > OPEN:  # the fullest are closed
            del self.fill[self.free.pop(0)[1]]
        return out


_PACKED = "spec_id int, capacity_tokens int, container_id long, doc_id long, part_no int, start_token long, n_tokens long, token_offset long"


def _pack_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    packer, spec, serial = None, None, 0

    def emit(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal packer, spec, serial
        out = []
        for this, group in rows.groupby("spec_id", sort=False):
            if this != spec:
                packer = Packer(int(group["capacity_tokens"].iloc[0]), serial)
                spec = this
            boxes = packer.pack(group["n_tokens"].tolist())
            serial = packer.next
            base = int(group["part"].iloc[0]) << 32
            out.append(group.assign(container_id=[base + b for b, _ in boxes], token_offset=[o for _, o in boxes]))
        names = [c.split(" ")[0] for c in _PACKED.split(", ")]
        return pd.concat(out)[names]

    held: list[pd.DataFrame] = []
    count = 0
    for frame in frames:
        held.append(frame)
        count += len(frame)
        while count >= WINDOW:
            rows = pd.concat(held, ignore_index=True)
            yield emit(rows.iloc[:WINDOW])
            rest = rows.iloc[WINDOW:]
            held, count = [rest], len(rest)
    if count:
        yield emit(pd.concat(held, ignore_index=True))


def pack(items: DataFrame, specs: list, partitions: int) -> DataFrame:
    """Pack ``items`` (doc_id, n_tokens, curve) for each (spec_id, capacity_tokens) of ``specs``.

    Specs with a null or non-positive capacity hold nothing and are left out. An item of 0
    tokens takes no room but is placed.
    """
    valid = [(int(a), int(b)) for a, b in specs if a is not None and b is not None and b > 0]
    if not valid:
        return items.sparkSession.createDataFrame([], _PACKED)
    # A handful of capacities (checked), so each item is repeated once for each.
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("spec_id"), F.lit(b).alias("capacity_tokens")) for a, b in valid)))
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int"), F.lit(1))
    cut = (
        items.select("doc_id", "n_tokens", "curve", each.alias("spec"))
        .select("doc_id", "n_tokens", "curve", "spec.*")
        .withColumn("part_no", F.explode(F.sequence(F.lit(1), pieces)))
        .withColumn("start_token", (F.col("part_no") - 1).cast("long") * F.col("capacity_tokens"))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start_token"), F.col("capacity_tokens").cast("long")))
    )
    ranged = cut.repartitionByRange(partitions, "spec_id", "curve", "doc_id", "part_no").sortWithinPartitions("spec_id", "curve", "doc_id", "part_no")
    columns = ["spec_id", "capacity_tokens", "doc_id", "part_no", "start_token", "n_tokens"]
    return ranged.select(*columns, F.spark_partition_id().alias("part")).mapInPandas(_pack_partition, _PACKED)


def p6_pack(spark: SparkSession, base: str) -> DataFrame:
    """Each piece of each text in a container of each capacity, with its place in text and container.

    Null and empty texts are pieces of 0 tokens; rows without doc_id are left out; rows that
    repeat a doc_id are packed as they stand; an empty table gives no rows.
    """
    tune(spark)
    documents = read_table(spark, base, "documents").where(F.col("doc_id").isNotNull())
    items = stage(documents.select("doc_id", sized_stage()("text").alias("s")).select("doc_id", "s.n_tokens", "s.curve"), "p6-items")
    specs = [(r[0], r[1]) for r in bounded_rows(read_table(spark, base, "container_specs").select("spec_id", "capacity_tokens"), MOST_SPECS, "container_specs")]
    total = items.count() * max(1, len(specs))
    return pack(items, specs, max(1, total // PARTITION_ITEMS + 1))


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    """For each capacity: containers, tokens in them, share of their room that is filled, and texts that were split."""
    packed = p6_pack(spark, base)
    boxes = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.expr("int(part_no = 2)")).alias("split"))
    return boxes.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * F.col("capacity_tokens")), 6).alias("filled_share"), F.sum("split").alias("split_texts")
    )


def p6_checks(spark: SparkSession, base: str) -> DataFrame:
    """For each capacity what must hold of the packing whatever the tokens: texts placed, containers over capacity or with gaps, texts split without need, texts with a piece missing or out of place."""
    packed = p6_pack(spark, base)
    boxes = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("token_offset") + F.col("n_tokens")).alias("reach"))
    filled = boxes.groupBy("spec_id", "capacity_tokens").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_capacity"), F.count_if(F.col("tokens") != F.col("reach")).alias("with_gaps"))
    texts = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("part_no").alias("parts"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach"), F.first("capacity_tokens").alias("capacity"))
    split = (F.col("parts") > 1) & (F.col("tokens") * F.col("parts") <= F.col("capacity") * F.col("pieces"))
    whole = texts.groupBy("spec_id").agg(F.count("*").alias("texts"), F.count_if(split).alias("needless_splits"), F.count_if(F.col("tokens") * F.col("parts") != F.col("reach") * F.col("pieces")).alias("incomplete"))
    return filled.join(whole, "spec_id")
