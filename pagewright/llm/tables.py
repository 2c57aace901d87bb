"""Reading, staging and keys shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import ensure_checkpoint_dir
from pagewright.sources.tables import bounded_rows, read_table

#: Rows handed to Python at a time; pages and speeches are wide.
ARROW_ROWS = 512
#: The common words of all languages are a small fixed table.
MOST_COMMON_WORDS = 20_000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, as each row carries whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again: it is computed once and survives lost executors.

    The driver removes the table when its JVM ends; until then any query may read it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


#: What has been fitted or staged in this session, by what it was made from; the oldest is forgotten first.
_MADE: OrderedDict = OrderedDict()
MOST_MADE = 16


def fingerprint(spark: SparkSession, base: str, *names: str) -> tuple:
    """What tells the present state of tables apart: application, path, bytes, files, and time of the last change."""
    out: list = [spark.sparkContext.applicationId, base]
    for name in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        size = files.getContentSummary(where)
        out += [size.getLength(), size.getFileCount(), files.getFileStatus(where).getModificationTime()]
    return tuple(out)


def once(spark: SparkSession, key: tuple, make):
    """``make()``, or what it gave before for the same key."""
    if key not in _MADE:
        _MADE[key] = make()
        while len(_MADE) > MOST_MADE:
            _MADE.popitem(last=False)
    return _MADE[key]


def common_words(spark: SparkSession, base: str) -> dict[str, frozenset]:
    """The frequent words of each language; collected, as the table is small and fixed (checked)."""
    out: dict[str, set] = {}
    for row in bounded_rows(read_table(spark, base, "common_words").select("lang", "word"), MOST_COMMON_WORDS, "common_words"):
        if row["lang"] and row["word"]:
            out.setdefault(row["lang"].lower(), set()).add(row["word"].lower())
    return {k: frozenset(v) for k, v in out.items()}


def site_of(url: Column) -> Column:
    """The publisher of a page: the host in lower case without one leading www., m. or amp.; '' if there is no host."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^(?:www|m|amp)\.", "")


def bounded_sample(df: DataFrame, key: str, rows: int, most: dict[str, int]) -> DataFrame:
    """About ``rows`` rows, at most twice as many, chosen by a hash of ``key``, for fitting a model; ``nth`` is a row's place among all by that hash, roughly.

    Rows with a text longer than ``most`` gives for its column are left to the fitted model.
    """
    short = F.lit(True)
    for column, size in most.items():
        short = short & (F.length(F.coalesce(F.col(column), F.lit(""))) <= size)
    nth = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 40)) * (df.count() / float(1 << 40))
    return df.withColumn("nth", nth).where((F.col("nth") < rows) & short).limit(2 * rows)
