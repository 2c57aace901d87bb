"""Queries of problems 4 and 5: records to exclude, and how the residue classifier does on hosts it has not seen."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.linear import fit, score
from pagewright.llm.pages import read_sample, staged_facts, stretches_of
from pagewright.llm.tables import common_words, read_table


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """result_id of each record of residue. Null titles and texts have no windows; an empty table trains nothing and gives no rows."""
    return staged_facts(spark, base).where("residue").select("result_id").distinct()


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Stuffed records; a record of template residue is never one."""
    return staged_facts(spark, base).where("stuffed and not residue").select("result_id").distinct()


def _withheld(phrase: str) -> bool:
    """Half of the phrases, by their words; placeholders and filler have none."""
    return phrase not in ("", "hole", "filler") and zlib.crc32(phrase.encode("utf-8", "surrogatepass")) % 2 == 1


def validate(rows: list) -> list[tuple]:
    """(setting, hosts, true_hits, missed, false_hits, true_rest) over the titles and sentences of `SENTENCE_ROW` rows of hosts not trained on.

    The classifier decides at the threshold that is in use. In the second setting half of
    the phrases give no label in training, and only cases of those phrases are counted:
    what no pattern has labelled.
    """
    stretches = stretches_of(rows)
    labels = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r["labels"], np.int8) for r in rows)])
    held = np.repeat(np.array([zlib.crc32((r["site"] or "").encode()) % 5 == 0 for r in rows], bool), [len(r["phrases"]) for r in rows])
    unseen = np.array([_withheld(p) for r in rows for p in r["phrases"]], bool)
    hosts = len({r["site"] for r in rows if zlib.crc32((r["site"] or "").encode()) % 5 == 0})
    out = []
    for setting, hidden in (("unseen hosts", np.zeros(len(unseen), bool)), ("unseen hosts and phrases", unseen)):
        weights = fit(stretches, np.where(held | hidden, -1, labels), epochs=16)
        said = score(stretches, weights)[0] > 0
        counted = held & (labels >= 0) & (hidden | (labels == 0) | ~hidden.any())
        out.append((setting, hosts, *(int((counted & a & b).sum()) for a in (labels == 1, labels == 0) for b in (said, ~said))))
    return [(s, h, hit, missed, false, rest) for s, h, hit, missed, false, rest in out]


def p4_validation(spark: SparkSession, base: str) -> DataFrame:
    """How the residue classifier does on a fifth of the hosts, none of which it was trained on, and there on cases that no pattern has labelled."""
    words = common_words(spark, base)
    sample = read_sample(read_table(spark, base, "extraction_results").where(F.col("result_id").isNotNull()), frozenset(w for own in words.values() for w in own))
    return spark.createDataFrame(validate(sample.sentences), "setting string, hosts int, true_hits long, missed long, false_hits long, true_rest long")
