import pytest

import __spark_entry__ as contract
from tests.conftest import TESTDATA
from tests.oracle import connect, differences

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(TESTDATA)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name](spark, TESTDATA), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TESTDATA).count() > 0
