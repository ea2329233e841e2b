"""How often a plan reads its input and shuffles, with adaptive planning off and reused exchanges counted once."""

import re

import pytest

from evidencelake.plans.registry import Tables, load_all


@pytest.mark.parametrize("name,scans,shuffles", [
    ("upper_median_by_flag", 1, 4), ("interpolated_p95", 1, 4), ("latency_distribution", 1, 4), ("window_statistics", 2, 6), ("dense_hourly_p95", 3, 9), ("named_metrics", 2, 6),
])
def test_scans_and_shuffles(spark, name, scans, shuffles):
    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = load_all()[name].build(t)._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if "ReusedExchange" not in x]
        assert sum("FileScan" in x for x in lines) <= scans and sum(bool(re.search(r"[-:] Exchange ", x)) for x in lines) <= shuffles, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
