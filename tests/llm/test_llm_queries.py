"""The registered queries against their SQL, on the smallest given tables, on odd rows and on empty tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from evidencelake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import MAKERS
from tests.oracle import compare, connect

ROOT = "/root/testdata/sf0.001"


def connect_to(root):
    con = duckdb.connect()
    for name in MAKERS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_given_tables(spark, name):
    assert compare(QUERIES[name](spark, ROOT), connect(ROOT), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(spark, messy, name):
    assert compare(QUERIES[name](spark, messy), connect_to(messy), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, hollow, name):
    rows = QUERIES[name](spark, hollow).count()
    assert rows == (1 if name.startswith("op10_") else 0)


@pytest.mark.parametrize("name", ["op2_mix", "op5_url_verdicts", "op9_site_lines", "op10_prefix_targets"])
def test_native(spark, messy, name):
    plan = QUERIES[name](spark, messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
