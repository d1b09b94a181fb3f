"""Every registered query against its SQL twin (or, without one, that it gives rows)."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import compare, duck

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        problems = [p for p in compare(df, sql, con) if p != "no rows on either side"]
        assert problems == []
