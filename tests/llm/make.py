"""Small tables with the columns of the test data, written to a folder; columns that are not given are null."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
DIAGNOSTICS = T.StructType([T.StructField("avg_sentence_length", _I), T.StructField("paragraphs", _I)])
TABLES = {
    "extraction_results": [("result_id", _L), *((n, _S) for n in ("url", "final_url", "output_format", "content_body", "cleaned_html", "text_content", "title", "byline", "author", "excerpt", "site_name", "lang"))],
    "audit_entries": [("audit_id", _L), ("url", _S), ("diagnostics", DIAGNOSTICS), ("audited_at", T.TimestampType())],
    "documents": [("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("speaker", _S)],
    "members": [("member_id", _L), ("full_name", _S)],
    "common_words": [("lang", _S), ("word", _S)],
    "container_specs": [("spec_id", _I), ("capacity_tokens", _I)],
    "mix_targets": [("source", _S), ("target_share", T.DoubleType()), ("max_repeats", _I)],
}
COMMON = {
    "en": "the of and to in a is that it was for on with as at by not be this are from or an have has had but they which we".split(),
    "de": "der die das und in zu den von mit ist im für auf nicht ein eine als auch es an aus er".split(),
}


def write(spark, folder, extra=None, **tables):
    """Write the named tables (lists of dicts); the small fixed tables get usual contents. ``extra`` adds columns to all."""
    given = {
        "common_words": [{"lang": k, "word": w} for k, words in COMMON.items() for w in words],
        "members": [{"member_id": 1, "full_name": "Ada Quill"}, {"member_id": 2, "full_name": "Bruno Marsh"}],
        "container_specs": [{"spec_id": 1, "capacity_tokens": 32}, {"spec_id": 2, "capacity_tokens": 100}],
        "mix_targets": [{"source": "a", "target_share": 0.5, "max_repeats": 1}, {"source": "b", "target_share": 0.5, "max_repeats": 4}],
        "audit_entries": [],
        "extraction_results": [],
        "documents": [],
    } | tables
    for name, rows in given.items():
        columns = TABLES[name] + [(c, _S) for c in (extra or [])]
        schema = T.StructType([T.StructField(c, t) for c, t in columns])
        spark.createDataFrame([tuple(r.get(c) for c, _ in columns) for r in rows], schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def now():
    return datetime.datetime(2024, 1, 1)
