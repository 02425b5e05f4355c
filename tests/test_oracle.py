"""Every registered query against SQL on another engine, over whole tables."""

import pytest
from oracle_check import compare, connect

from ratewright.plans.oracle import ORACLE
from ratewright.plans.registered import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLE[name]) == ""
