"""Every registered query against its SQL, row order included where it matters."""

import pytest

from check_oracle import compare, connect, oracle_rows, spark_rows
from yardstats.plans.registry import load, runner

BASE = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    got = spark_rows(runner(name)(spark, BASE))
    assert q.sql, "no oracle"
    assert compare(got, oracle_rows(con, q.sql), q.ordered) == ""
