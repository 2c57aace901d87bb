"""Every core query that has SQL gives DuckDB's rows; every other one runs."""

import pytest
from compare import same, views

from pagewright.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, connection, name):
    same(catalog.queries()[name](spark, data), connection, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0


def test_entry(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
