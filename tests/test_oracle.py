"""Every registered query: against its SQL, or that it gives rows."""

import os

import pytest
from compare import difference, duck

from gridcast.queries import ORACLE, QUERIES
from gridcast.session import release

SF = os.environ.get("GRIDCAST_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, con, ORACLE[name]) is None
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
    release(spark)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
