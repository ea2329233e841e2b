"""Every registered query against its oracle on the smallest tables."""

import pytest

from evidencelake.plans.registry import Tables, load_all
from tests.oracle import compare, connect

ROOT = "/root/testdata/sf0.001"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    df = q.build(Tables(spark, ROOT))
    # pairing every row with every row would not survive growth of the tables
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # every query has an oracle and, even on the smallest tables, rows
    assert compare(df, con, q.sql) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(REGISTRY) <= set(entry.oracle_sql())
