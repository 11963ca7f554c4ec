"""Every registered query against its SQL in DuckDB; those without SQL have to run."""

import os

import pytest

from brindle.plans import registry
from tests import oracle

oracle.SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        oracle.compare(spark, con, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, oracle.SF)
        assert df.columns and df.collect() is not None
