"""Every registered query with SQL agrees with DuckDB on the smallest tables; the others run."""

import os

import oracle
import pytest

from tidewell.plans.registry import QUERIES, SQL, flagship

SF = os.environ.get("TIDEWELL_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
