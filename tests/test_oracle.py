"""Every registered query against its SQL twin."""

import pytest

from support import SF
from harness.compare import connect, difference
from harness.oracle import ORACLE
from harness.registry import QUERIES


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", QUERIES)
def test_same_result(spark, connection, key):
    assert difference(QUERIES[key](spark, SF), connection, ORACLE[key]) == ""


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() == 9
    assert QUERIES.keys() <= contract.queries().keys()
    assert QUERIES.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()
