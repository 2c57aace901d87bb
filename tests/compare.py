"""Comparing a Spark result with DuckDB rows, regardless of order."""

from __future__ import annotations

import datetime
import math


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr), sorted(names)


def same(df, connection, sql):
    got, names = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    wanted, other = table([c[0] for c in cursor.description], cursor.fetchall())
    assert names == other
    assert len(got) == len(wanted), (len(got), len(wanted))
    different = [(a, b) for a, b in zip(got, wanted) if a != b]
    assert not different, different[:3]


def views(base):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    from pathlib import Path

    for file in sorted(Path(base).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/*.parquet' if file.is_dir() else ''}')")
    return connection
