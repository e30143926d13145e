"""Every registered query against its SQL counterpart on the small test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tablewright.catalog import REGISTRY
from tests.compare import connect, differences

FOLDER = os.environ.get("TABLEWRIGHT_TEST_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_flagship(spark):
    assert entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(queries())
    assert set(REGISTRY) <= set(oracle_sql())


# Python in the row path, and joins that pair every row with every row.
UNWANTED = (
    "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin",
)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, key):
    result = queries()[key](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert [node for node in UNWANTED if node in plan] == []
    assert differences(result, duck, oracle_sql()[key]) == []
