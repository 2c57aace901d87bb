"""Every query of the package that has SQL gives DuckDB's rows."""

import pytest
from compare import same, views

from pagewright.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, connection, name):
    same(queries.queries()[name](spark, data), connection, SQL[name])
