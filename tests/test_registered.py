"""All registered queries against their reference SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
QUERIES = contract.queries()
ALL = sorted(QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark data not present")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ALL)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(duck, df, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_reference_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
