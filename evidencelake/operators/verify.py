"""Cross-checking figures against an independently computed result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.names import COUNT_NAME, MAGNITUDE_NAME, RATE_NAME
from evidencelake.functions.stats import agrees, relative_delta
from evidencelake.operators.joins import first_per_key


def verify(df: DataFrame, other: DataFrame, keys: Sequence[str], value: str, other_value: str | None = None) -> DataFrame:
    """Each figure beside its independent recomputation: relative delta and verdict."""
    keys = list(keys)
    a = df.select(*keys, F.col(value).cast("double").alias("value"))
    b = other.select(*keys, F.col(other_value or value).cast("double").alias("verified_value"))
    joined = a.join(b, keys, "full_outer")
    v, w = F.col("value"), F.col("verified_value")
    verdict = (
        F.when(v.isNull() | w.isNull(), "inconclusive").when(agrees(v, w), "agreed").otherwise("disagreed")
    )
    return joined.select(*keys, "value", "verified_value", relative_delta(v, w).alias("relative_delta"), verdict.alias("verdict"))


def single_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The one figure an independent query produced; rows that differ name none.

    Every row is compared with the first (lowest ``position``), within the agreement tolerance.
    """
    keys = list(keys)
    first = first_per_key(df, keys, [F.col("position")]).select(*keys, F.col(value).cast("double").alias("_first"))
    per_key = (
        df.join(first, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows_n"),
            F.max("_first").alias("_first"),
            F.bool_and(F.coalesce(agrees(F.col(value), F.col("_first")), F.lit(False))).alias("_same"),
        )
    )
    known = (F.col("rows_n") == 1) | F.col("_same")
    return per_key.select(
        *keys, "rows_n", F.when(known, F.col("_first")).alias("verified_value"), (~known).alias("inconclusive")
    )


def value_kind(value: Column) -> Column:
    return F.when((value >= 0) & (value <= 1.0001), "rate").otherwise("magnitude")


def figure_kind(column: Column, value: Column) -> Column:
    """A figure's kind by its name first, and by its value only when the name says nothing."""
    return (
        F.when(column.rlike(RATE_NAME), "rate")
        .when(column.rlike(COUNT_NAME) | column.rlike(MAGNITUDE_NAME), "magnitude")
        .otherwise(value_kind(value))
    )


def resolve_figure(figures: DataFrame, checks: DataFrame) -> DataFrame:
    """Which reported figure an independent check reproduced, for many checks at once.

    ``figures(check_id, origin, row_id, column, value)``: ``origin`` is ``digest`` or ``rows``; values that are
    not numbers are absent or NULL. ``checks(check_id, expected, verified_value, rows_n)``, with ``rows_n`` the rows
    of the result.

    In order: the named column in the digest; the named column in the rows when all rows agree; the only
    column of the same kind whose value agrees; the only figure of a one-row result; else unresolved.
    """
    f = figures.filter(F.col("value").isNotNull())
    c = checks.select("check_id", "expected", F.col("verified_value").cast("double").alias("verified_value"), "rows_n")
    j = f.join(c, "check_id")
    named = F.col("column") == F.col("expected")
    in_rows = F.col("origin") == "rows"

    # the first row's value of the named column, against which the other rows must agree
    first_named = first_per_key(j.filter(named & in_rows), ["check_id"], [F.col("row_id")]).select(
        "check_id", F.col("value").alias("_first")
    )
    by_name = (
        j.filter(named)
        .join(first_named, "check_id", "left")
        .groupBy("check_id")
        .agg(
            F.max(F.when(F.col("origin") == "digest", F.col("value"))).alias("_digest"),
            F.max("_first").alias("_first"),
            F.bool_and(F.when(in_rows, agrees(F.col("value"), F.col("_first")))).alias("_same"),
        )
    )

    # a column matches by its first agreeing occurrence: digest before rows, rows in order
    candidates = j.filter(
        F.col("verified_value").isNotNull()
        & (figure_kind(F.col("column"), F.col("value")) == value_kind(F.col("verified_value")))
        & agrees(F.col("value"), F.col("verified_value"))
    )
    order = F.struct(F.when(in_rows, 1).otherwise(0), F.col("row_id"))
    by_value = (
        candidates.groupBy("check_id", "column")
        .agg(F.min_by("value", order).alias("_v"))
        .groupBy("check_id")
        .agg(F.count(F.lit(1)).alias("_matches"), F.min("column").alias("_mc"), F.min("_v").alias("_mv"))
    )

    shape = (
        f.filter(in_rows)
        .groupBy("check_id")
        .agg(
            F.count(F.lit(1)).alias("_figures"),
            F.min("column").alias("_oc"),
            F.min("value").alias("_ov"),
        )
    )
    all_ = c.join(by_name, "check_id", "left").join(by_value, "check_id", "left").join(shape, "check_id", "left")
    has_name = F.coalesce(F.col("expected"), F.lit("")) != ""
    digest_hit = has_name & F.col("_digest").isNotNull()
    rows_hit = has_name & F.col("_first").isNotNull() & F.col("_same")
    value_hit = F.col("_matches") == 1
    ambiguous = F.col("_matches") > 1
    only = (F.col("_figures") == 1) & (F.col("rows_n") == 1)

    def choose(by_digest: Column, by_rows: Column, by_val: Column, by_only: Column) -> Column:
        return (
            F.when(digest_hit, by_digest)
            .when(rows_hit, by_rows)
            .when(value_hit, by_val)
            .when(ambiguous, F.lit(None))
            .when(only, by_only)
        )

    return all_.select(
        "check_id",
        choose(F.col("expected"), F.col("expected"), F.col("_mc"), F.col("_oc")).alias("resolved_column"),
        choose(F.col("_digest"), F.col("_first"), F.col("_mv"), F.col("_ov")).alias("resolved_value"),
        choose(F.lit("name"), F.lit("name"), F.lit("value"), F.lit("value")).alias("matched_by"),
    )


def task_to_verify(columns: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per answer, the task most likely to carry the headline: most rate columns, then most rows, then first.

    ``columns(answer_id, task_id, column)`` and ``tasks(answer_id, task_id, position, total_rows)``.
    """
    rate_columns = columns.groupBy("answer_id", "task_id").agg(
        F.count_if(F.col("column").rlike(RATE_NAME)).alias("rate_columns")
    )
    w = Window.partitionBy("answer_id").orderBy(
        F.col("rate_columns").desc(), F.col("total_rows").desc(), F.col("position")
    )
    return (
        tasks.filter("total_rows > 0")
        .join(rate_columns, ["answer_id", "task_id"], "left")
        .fillna({"rate_columns": 0})
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn")
    )
