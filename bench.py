"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and run to completion over the whole tables twice: ``cold`` holds the first run, which also pays
for code generation, ``queries`` the second. ``value`` is the sum of ``queries``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from evidencelake.plans.registry import Tables, load_all
from evidencelake.session import local_session

HEADLINE = (
    "rate_by_segment rate_wilson funnel_set funnel_daily_users hygiene_report checkout_conversion monthly_rate_trend upper_median_by_flag "
    "interpolated_p95 discount_by_code repeatability digest_wide digest_extremes digest_many_results precision_rows headline_choice sanity_gate "
    "cross_check figure_resolution uncited_numbers uncited_in_documents confidence_scores named_metrics unstated_assumptions field_profile type_advice "
    "latest_version version_stamp changelog_entries window_statistics dense_hourly_p95 run_history_from_events phase_durations conversation_list related_answers"
).split()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    registry, tables = load_all(), Tables(spark, root)
    tables.nation.count()
    cold, warm = {}, {}
    for name in wanted:
        for target in (cold, warm):
            started = time.perf_counter()
            registry[name].build(tables).write.format("noop").mode("overwrite").save()
            target[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
