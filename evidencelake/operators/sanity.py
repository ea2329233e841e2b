"""What cannot be reported is dropped, what looks wrong is flagged and counted once.

Results come as cells: ``(answer_id, task_id, row_id, column, value_num, value_str)``, where a NULL cell has both
values NULL and a text cell only ``value_str``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.names import BASE_NAME, COUNT_NAME, PERCENT_NAME
from evidencelake.operators.digest import IMPOSSIBLE_RATE, SMALL_SAMPLE


def number_text(value: Column) -> Column:
    """A double without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def is_evidence(value_num: Column, value_str: Column) -> Column:
    """Anything other than a zero, a NULL or an empty text."""
    return F.when(value_num.isNotNull(), value_num != 0).otherwise(value_str.isNotNull() & (value_str != ""))


def has_evidence(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Per answer, whether its results hold anything to talk about; no rows at all is no evidence."""
    found = results.groupBy("answer_id").agg(
        F.max(is_evidence(F.col("value_num"), F.col("value_str"))).alias("has_evidence")
    )
    return answers.select("answer_id").join(found, "answer_id", "left").fillna({"has_evidence": False})


def sanity_flags(results: DataFrame, digested: DataFrame | None = None, digest_flags: DataFrame | None = None) -> DataFrame:
    """Distinct ``(answer_id, task_id, kind, flag)`` rows.

    ``digested(answer_id, task_id, column)`` names the columns a digest already answered for: the row check skips
    exactly those, and ``digest_flags(answer_id, task_id, kind, flag)`` speak for them.
    """
    task = ["answer_id", "task_id"]
    cells = results if digested is None else results.join(digested, [*task, "column"], "left_anti")
    value = F.col("value_num")
    impossible = cells.filter(F.col("column").rlike(PERCENT_NAME) & (value > IMPOSSIBLE_RATE)).select(
        *task, F.lit("impossible").alias("kind"),
        F.concat(F.col("column"), F.lit("="), number_text(value), F.lit(" exceeds 100%")).alias("flag"),
    )
    # an absent sample reads as zero, a text never reads as small
    small = F.when(value.isNotNull(), value < SMALL_SAMPLE).otherwise(F.col("value_str").isNull())
    samples = (
        cells.filter(F.col("column").rlike(COUNT_NAME) | F.col("column").rlike(BASE_NAME))
        .groupBy(*task)
        .agg(F.min(small).alias("_small"))
        .filter("_small")
        .select(*task, F.lit("small_sample").alias("kind"), F.lit("no sample reaches 50: weak evidence").alias("flag"))
    )
    flags = impossible.unionByName(samples)
    if digest_flags is not None:
        flags = flags.unionByName(digest_flags.select(*task, "kind", "flag"))
    return flags.distinct()


def sanity_gate(
    tasks: DataFrame, results: DataFrame, digested: DataFrame | None = None, digest_flags: DataFrame | None = None
) -> DataFrame:
    """Every planned task with its fate: ``dropped`` and why, or kept with its flag counts.

    ``tasks(answer_id, task_id)``. A result whose first row carries a ``blocked`` column declares itself not
    computable. A dropped task is not flagged.
    """
    task = ["answer_id", "task_id"]
    # the first row alone decides; its cells are bounded by the width of a result
    first = results.groupBy(*task).agg(F.min("row_id").alias("row_id"))
    heads = results.join(first, [*task, "row_id"]).groupBy(*task).agg(
        F.max(F.col("column") == "blocked").alias("_blocked"),
        F.max(F.when(F.col("column") == "reason", F.coalesce("value_str", number_text(F.col("value_num"))))).alias("_reason"),
    )
    flags = (
        sanity_flags(results, digested, digest_flags)
        .groupBy(*task)
        .agg(
            F.count_if(F.col("kind") == "impossible").alias("impossible_n"),
            F.count_if(F.col("kind") == "small_sample").alias("small_sample_n"),
        )
    )
    reason = F.when(F.col("_blocked").isNull(), "empty result set").when(
        F.col("_blocked"),
        F.concat(F.lit("not computable: "), F.coalesce("_reason", F.lit("not computable from the available columns"))),
    )
    fate = tasks.select(*task).join(heads, task, "left").join(flags, task, "left").withColumn("drop_reason", reason)
    kept = F.col("drop_reason").isNull()
    return fate.select(
        *task,
        (~kept).alias("dropped"),
        "drop_reason",
        *[F.when(kept, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("impossible_n", "small_sample_n")],
    )


def sanity_counts(gate: DataFrame) -> DataFrame:
    """Per answer: impossible values, small-sample flags, dropped and planned tasks."""
    return gate.groupBy("answer_id").agg(
        F.sum("impossible_n").alias("impossible_flags"),
        F.sum("small_sample_n").alias("small_sample_flags"),
        F.count_if("dropped").alias("dropped_tasks"),
        F.count(F.lit(1)).alias("planned_tasks"),
    )
