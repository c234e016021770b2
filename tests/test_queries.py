"""Each query that has SQL against DuckDB on the smallest tables."""

import pytest

from framelake.jobs.queries import ORACLE_SQL, QUERIES

from .check import connect, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = connect(sf).sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
