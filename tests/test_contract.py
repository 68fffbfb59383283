"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import difference, oracle_connection


@pytest.fixture(scope="module")
def connection(small):
    return oracle_connection(small)


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    result = contract.entry(spark)
    assert result.columns == ["label", "keys", "mean_y"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, small, connection, name):
    result = contract.queries()[name](spark, small)
    assert difference(result, connection, contract.oracle_sql()[name]) == ""
