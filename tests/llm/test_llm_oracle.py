"""Queries of the subpackage against their SQL."""

import pytest
from compare import difference, duck
from conftest import SMALL

import __spark_entry__ as entry_point
from tunnelscope.llm import oracle


@pytest.mark.parametrize("name", sorted(oracle.oracle()))
def test_query(name, spark):
    assert difference(entry_point.queries()[name](spark, SMALL), duck(SMALL), entry_point.oracle_sql()[name]) is None


def test_all_are_registered():
    names = entry_point.queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
