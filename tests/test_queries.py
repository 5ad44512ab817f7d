"""Every query with SQL gives DuckDB's rows; every other one gives distinct rows with values."""

import pytest

from lumenforge.plans import catalogue
from tests.oracle import compare, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()



@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        rows = df.collect()
        assert rows
        assert all(any(v is not None for v in r) for r in rows) and len({tuple(map(repr, r)) for r in rows}) > len(rows) // 2
