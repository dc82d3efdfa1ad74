"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import pytest
from oracle import compare, connection

from parchment.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    make, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert make(spark, SMALL).count() >= 0
        return
    columns, got, names, expected = compare(spark, con, make, sql, SMALL)
    assert columns == names
    assert got == expected
