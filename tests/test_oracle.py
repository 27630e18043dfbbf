"""Every registered query against its SQL, at the smallest scale."""

import pytest
from compare import difference, duck
from conftest import SMALL

import __spark_entry__ as entry_point
from tunnelscope.catalog import queries as catalog

# Queries that may be absent have tests of their own.
QUERIES = {name: q for name, q in entry_point.queries().items() if name in catalog.REGISTRY}
SQL = {name: text for name, text in entry_point.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    assert difference(QUERIES[name](spark, SMALL), con, SQL[name]) is None


def test_comparison_sees_a_difference(spark, con):
    wrong = QUERIES["port_totals"](spark, SMALL).selectExpr("dev_port", "packets + 1 AS packets", "bytes")
    assert "differ" in difference(wrong, con, SQL["port_totals"])


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"window", "qfi", "score", "thr", "pred", "debounced"}
