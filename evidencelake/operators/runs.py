"""Run history and step timing from append-only run events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.operators.quantiles import ordered_position

# Step name patterns and their reader-facing phases; the first match wins, "" is plumbing.
ANSWER_PHASES = (
    (r"^analytics$", ""),
    (r"^cache_lookup$", ""),
    (r"^context_load$", "Reading the knowledge store"),
    (r"^pre_plan_lookup$", "Reading the knowledge store"),
    (r"^plan", "Planning the analysis"),
    (r"^(task_|sql_attempt)", "Querying the tables"),
    (r"^digest_", "Analysing every row of the results"),
    (r"^(sanity_gate|precision|verify)$", "Validating the results"),
    (r"^(context_lookup|related_insights)$", "Looking for known issues"),
    (r"^narrate", "Writing the insight"),
    (r"^(quality_gate|confidence)", "Reviewing the answer"),
)
RUN_PHASES = (
    (r"^profile$", "Profiling the events"),
    (r"^(context_load|schema_reconciliation)$", "Reading the knowledge store"),
    (r"^(ddl_generation_attempt|schema_design_attempt|schema_design)", "Designing the schema"),
    (r"^dry_run", "Validating the schema"),
    (r"^(approval_attempt|update_approval_attempt|optimization_approval_attempt)", "Waiting for your approval"),
    (r"^ddl_execution_attempt", "Creating tables and loading data"),
    (r"^(context_update|update_generation_attempt)", "Updating the knowledge store"),
    (r"^optimization_generation_attempt", "Drafting the change"),
    (r"^optimization_execution_attempt", "Applying the change"),
    (r"^(instrumentation|optimization)$", ""),
)
RUNS_LISTED = 200


def phase_of(step: Column, rules: Sequence[tuple[str, str]] = ANSWER_PHASES, otherwise: str = "Working") -> Column:
    """Phase of a step name; run logs use :data:`RUN_PHASES` with ``otherwise=""``."""
    out = F.when(step.rlike(rules[0][0]), rules[0][1])
    for pattern, label in rules[1:]:
        out = out.when(step.rlike(pattern), label)
    return out.otherwise(otherwise)


def run_history(summary: DataFrame, n: int = RUNS_LISTED) -> DataFrame:
    """One row per run from upserted summary rows, newest start first."""
    fields = ["spec", "started", "status", "events", "duration_ms"]
    latest = summary.groupBy("run_id").agg(
        F.max(F.struct("finished", *[c for c in fields])).alias("r")
    )
    return latest.select("run_id", "r.*").orderBy(F.col("started").desc(), "run_id").limit(n)


def run_history_from_events(runs_log: DataFrame) -> DataFrame:
    """The same, rebuilt from events: first and last time, last status, event count, elapsed milliseconds."""
    is_status = F.col("type") == "status"
    return runs_log.groupBy("run_id").agg(
        F.min("spec").alias("spec"),
        F.min("ts").alias("started"),
        F.max("ts").alias("finished"),
        F.max_by("name", F.when(is_status, F.col("seq") + 1).otherwise(-1)).alias("last_status"),
        F.count(F.lit(1)).alias("events_n"),
    ).withColumn("duration_ms", F.expr("timestampdiff(MILLISECOND, started, finished)"))


def step_attempts(runs_log: DataFrame) -> DataFrame:
    """The k-th start of a step in a run paired with its k-th end (or error); an open attempt has no end."""
    step = ["run_id", "name"]

    def numbered(events: DataFrame) -> DataFrame:
        # numbered by minute, so one step's endless log is not sorted by one task
        return ordered_position(events, step, [F.col("ts"), F.col("seq")], F.date_trunc("minute", "ts"), "_i").withColumn(
            "attempt", F.col("_i") + 1
        )

    starts = (
        numbered(runs_log.filter(F.col("type") == "step_start"))
        .select(*step, "attempt", F.col("ts").alias("started_at"))
    )
    ends = (
        numbered(runs_log.filter(F.col("type").isin("step_end", "step_error")))
        .select(*step, "attempt", F.col("ts").alias("ended_at"), F.when(F.col("type") == "step_end", "done").otherwise("error").alias("status"))
    )
    elapsed = F.expr("timestampdiff(MILLISECOND, started_at, ended_at)")
    return (
        starts.join(ends, [*step, "attempt"], "left")
        .fillna({"status": "running"})
        .withColumn("elapsed_ms", elapsed)
    )


def phase_durations(runs_log: DataFrame, rules: Sequence[tuple[str, str]] = RUN_PHASES, otherwise: str = "") -> DataFrame:
    """Wall time per run and phase, summed over every attempt; plumbing has no phase."""
    return (
        step_attempts(runs_log)
        .withColumn("phase", phase_of(F.col("name"), rules, otherwise))
        .filter(F.col("phase") != "")
        .groupBy("run_id", "phase")
        .agg(F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("elapsed_ms"), F.count(F.lit(1)).alias("attempts_n"))
    )
