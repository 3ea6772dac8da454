"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    query = entry.queries()[name]
    if name in SQL:
        assert difference(spark, connection, query, SQL[name], SF_DIR) is None
    else:
        assert query(spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = {r["risk_flag"]: r["n"] for r in entry.entry(spark).collect()}
    assert rows == {"Low": 187, "Medium": 9, "High": 4}
