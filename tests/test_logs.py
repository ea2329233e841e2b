"""Query log, changelog, runs, phases and conversations on the recorded cases."""

import json

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import changelog, conversations, joins, knowledge, metrics, querylog, runs, topk
from evidencelake.sources import versions

NOW = 1785598200  # 15:30 of some day
HOUR = NOW // 3600 * 3600
H = "hour_ts long, p95_ms double, queries long, top_kind string, top_rows long, top_log_comment string"


def series(spark, rows):
    return [r.asDict() for r in querylog.latency_series(spark.createDataFrame(rows, H), F.lit(NOW)).orderBy("hour_ts").collect()]


def raw(back, p95, queries=10, kind="Select", rows=0, comment=""):
    return (HOUR - back * 3600, float(p95), queries, kind, rows, comment)


def test_dense_series(spark):
    out = series(spark, [raw(2, 144, 338), raw(48, 999)])
    assert [r["hour_ts"] for r in out] == [HOUR - i * 3600 for i in range(23, -1, -1)]
    assert (out[21]["p95_ms"], out[21]["queries"], out[22]["p95_ms"]) == (144, 338, 0)
    assert len(series(spark, [])) == 24


@pytest.mark.parametrize("rows,spikes", [
    ([raw(i, 140) for i in range(24)], []),
    ([raw(i, 140) for i in range(24) if i != 5] + [raw(5, 4106, 40, "Insert", 412900, json.dumps({"app": "evidencelake", "agent": "instrumentation"}))], ["instrumentation insert (412,900 rows)"]),
    ([raw(i, 2) for i in range(24) if i != 3] + [raw(3, 8)], []),
    ([raw(0, 500, 3)], []),
    ([raw(0, 100), raw(1, 100), raw(2, 400, kind="")], ["query"]),
    # two busy hours: the upper of the two is the median
    ([raw(0, 100), raw(1, 150)], []),
])
def test_spikes(spark, rows, spikes):
    assert [r["spike_cause"] for r in series(spark, rows) if r["is_spike"]] == spikes


def test_attribution(spark):
    rows = ['{"app":"evidencelake","agent":"observe","run":"r1","step":"s"}', '{"app":"other","agent":"x"}', "not json", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "c string").select(querylog.attribution(F.col("c"), "evidencelake").alias("a"))
    assert [tuple(r.a) for r in df.collect()] == [("observe", "r1", "s")] + [(None, None, None)] * 4


STATEMENTS = {
    "ALTER TABLE t MODIFY TTL ts + INTERVAL 30 DAY": None, "alter table a.b add column c String": None, "ALTER TABLE t MODIFY COLUMN c LowCardinality(String)": None,
    "CREATE MATERIALIZED VIEW IF NOT EXISTS mv AS SELECT 1": None, "OPTIMIZE TABLE t FINAL;": None,
    "DROP TABLE t": "form not permitted", "ALTER TABLE t DELETE WHERE 1": "form not permitted", "INSERT INTO t VALUES (1)": "form not permitted",
    "OPTIMIZE TABLE t; DROP TABLE t": "several statements", "  ;; ": "empty", "": "empty",
    "CREATE MATERIALIZED VIEW v AS SELECT 1 FROM x -- truncate y": "forbidden keyword",
}


def test_statement_audit(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "statement string")
    assert {r.statement: r.problem for r in querylog.audit_statements(df).collect()} == STATEMENTS


def test_query_shapes(spark):
    from evidencelake.functions.text import query_shape, truncate

    df = spark.createDataFrame([("SELECT\n  a  FROM t1 WHERE x = 5 AND y IN (1, 2, 3) AND z = 'it''s'",)], "q string")
    assert df.select(query_shape(F.col("q"))).first()[0] == "SELECT a FROM t1 WHERE x = ? AND y IN (?..) AND z = ?"
    long = spark.createDataFrame([("x" * 500,)], "q string").select(truncate(F.col("q"))).first()[0]
    assert len(long) == 241 and long.endswith("…")


@pytest.mark.parametrize("step,phase", [
    ("context_load", "Reading the knowledge store"), ("plan_attempt_1", "Planning the analysis"), ("sql_attempt_2", "Querying the tables"), ("digest_t1", "Analysing every row of the results"),
    ("verify", "Validating the results"), ("confidence", "Reviewing the answer"), ("analytics", ""), ("something_else", "Working"),
])
def test_answer_phases(spark, step, phase):
    assert spark.range(1).select(runs.phase_of(F.lit(step))).first()[0] == phase


def test_run_phases(spark):
    steps = ["profile", "dry_run_1", "update_approval_attempt_2", "optimization_execution_attempt_1", "instrumentation", "unknown"]
    df = spark.createDataFrame([(s,) for s in steps], "s string").select(runs.phase_of(F.col("s"), runs.RUN_PHASES, ""))
    assert [r[0] for r in df.collect()] == ["Profiling the events", "Validating the schema", "Waiting for your approval", "Applying the change", "", ""]


@pytest.mark.parametrize("ordinal,label", [(0, "v1.0"), (3, "v1.3"), (9, "v1.9"), (10, "v2.0"), (21, "v3.1")])
def test_version_labels(spark, ordinal, label):
    assert spark.range(1).select(changelog.version_label(F.lit(ordinal))).first()[0] == label


@pytest.mark.parametrize("path,spec", [("/x/specs/02_group_family", "02_group_family"), ("/x/uploads/03_status_sharing_msagtujv", "03_status_sharing"), ("/x/specs/05_instant_forex/", "05_instant_forex")])
def test_spec_names(spark, path, spec):
    assert spark.range(1).select(changelog.spec_from_dir(F.lit(path))).first()[0] == spec


LOG = "run_id string, spec string, seq int, ts string, type string, name string, payload string"
STORE = "run_id string, source_spec string, entity string, version int, updated_at string, definition_md string"


def run_rows(spark, spec=""):
    tables = {"tables": [{"name": "group_started", "rowsLoaded": 1200}, {"name": "traveller_added", "rowsLoaded": 3400}]}
    rows = [
        ("2026-08-01 14:00:13.801", "step_start", "instrumentation", {"input": {"specDir": "/x/specs/02_group_family"}}),
        ("2026-08-01 14:00:13.800", "status", "running", {"traceUrl": "https://trace/abc"}),
        ("2026-08-01 14:01:59.746", "status", "running", {}),
        ("2026-08-01 14:01:59.746", "approval_result", "ddl", {"approved": True, "identity": "reviewer@team"}),
        ("2026-08-01 14:04:52.730", "status", "succeeded", tables),
    ]
    df = spark.createDataFrame([("run_a", spec, i, ts, t, n, json.dumps(p)) for i, (ts, t, n, p) in enumerate(rows)], LOG)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def store_rows(spark):
    rows = [("seed", "base_context.md", "overview:business", 1, "2026-08-01 09:46:12.574", ""), ("data_audit", "data_audit", "entity:application", 2, "2026-08-01 10:20:52.098", ""),
            ("data_audit", "data_audit", "convention:sessionization", 1, "2026-08-01 10:20:52.098", "")]
    return spark.createDataFrame(rows, STORE).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_run_facts(spark):
    r = changelog.run_facts(run_rows(spark)).first()
    assert (r.trace_url, r.identity, r.spec) == ("https://trace/abc", "reviewer@team", "02_group_family")
    assert changelog.run_facts(run_rows(spark, "04_recovery")).first().spec == "04_recovery"


def test_changelog(spark):
    entries = changelog.changelog(store_rows(spark), run_rows(spark)).collect()
    assert [e.title for e in entries] == ["group_started + 1 more created", "context v1.1", "context v1.0"]
    table, audit, seed = entries
    assert table.description.endswith("approved by reviewer@team · 4,600 events in 2 tables")
    assert (audit.warn, seed.warn, audit.run_id, table.spec) == (True, False, None, "02_group_family")
    assert audit.description == "+1 entry added · 1 definition replaced · entity:application, convention:sessionization"
    unfinished = run_rows(spark).filter("name != 'succeeded'")
    assert changelog.changelog(store_rows(spark).limit(0), unfinished).count() == 0


def test_store_versions(spark):
    proposed = spark.createDataFrame([("entity:application", "d", "n"), ("metric:new", "d", "n")], "entity string, definition_md string, change_note string")
    rows = versions.append_versions(store_rows(spark), proposed, F.current_timestamp(), "spec", "run").collect()
    assert {r.entry_id for r in rows} == {"entity:application:v3", "metric:new:v1"}
    latest = topk.latest_version(store_rows(spark)).count()
    assert latest == 3


def test_stamp_changes_with_any_version(spark):
    s = store_rows(spark)
    stamp = lambda df: knowledge.version_stamp(df).first()["stamp"]
    assert stamp(s) == stamp(s.orderBy("entity")) != stamp(s.withColumn("version", F.col("version") + (F.col("run_id") == "seed").cast("int")))


def test_protected_sources(spark):
    df = spark.createDataFrame([(s,) for s in ("base_context.md", "data_audit_2", "data_auditor", "spec_1")], "source_spec string")
    assert sorted(r[0] for r in knowledge.removable_sources(df).collect()) == ["data_auditor", "spec_1"]


def test_phantom_refs(spark):
    s = spark.createDataFrame([("ghost",), ("ghost",), ("t",), ("",), (None,)], "target_table string")
    known = spark.createDataFrame([("t",)], "table string")
    assert [r.phantom for r in joins.phantom_refs(s, "target_table", known, "table").collect()] == ["ghost"]


def test_attempts_pair_in_order(spark):
    rows = [("r", "", i, f"2026-01-0{d} 00:00:0{s}", t, "profile", "{}") for i, (d, s, t) in enumerate([(1, 0, "step_start"), (1, 2, "step_start"), (1, 3, "step_error"), (2, 7, "step_end"), (3, 8, "step_start")])]
    df = spark.createDataFrame(rows, LOG).withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.attempt, r.status, r.elapsed_ms) for r in runs.step_attempts(df).orderBy("attempt").collect()]
    assert got == [(1, "error", 3000), (2, "done", 86405000), (3, "running", None)]


def test_funnel_and_repeatability(spark):
    a = spark.createDataFrame([("u1", None, 0), ("u2", None, 0), ("u3", "d", 0), ("u4", None, None)], "user_id string, duplicate_id string, is_back_filled int")
    b = spark.createDataFrame([("u1",), ("u1",), ("u9",)], "user_id string")
    rows = metrics.funnel(metrics.stage_flags({"a": a, "b": b}, "user_id"), ["a", "b"]).orderBy("stage_index").collect()
    # the duplicate and the row with an unknown backfill flag are not counted
    assert [(r.keys_n, r.next_n) for r in rows] == [(2, 2), (2, None)]


def test_related_answers_skip_only_their_own_text(spark):
    cache = [(i, "c", q, i) for i, q in enumerate(["about checkout", "recheckouting", "about checkout", "same checkout?", "same checkout?", "same checkout?", "same checkout?", "other"])]
    asked = spark.createDataFrame([("q1", "c", "same checkout?"), ("q2", "c", "nothing here"), ("q3", "d", "same checkout?")], "question_id string, conv_id string, question string")
    got = conversations.related_answers(asked, spark.createDataFrame(cache, "answer_id int, conv_id string, question string, created_at int")).collect()
    assert sorted((r.question_id, r.answer_id) for r in got) == [("q1", 0), ("q1", 1), ("q1", 2)]


def test_newest_groups_are_whole(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 5), ("c", 7), ("c", 2)], "g string, t int")
    kept = topk.newest_groups(df, "g", "t", 2)
    assert sorted((r.g, r.t, r.truncated) for r in kept.collect()) == [("a", 1, True), ("a", 9, True), ("c", 2, True), ("c", 7, True)]
    assert {r.truncated for r in topk.newest_groups(df, "g", "t", 3).collect()} == {False}
