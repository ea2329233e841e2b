"""Deterministic limits: every cut is taken under a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators.joins import first_per_key

EXTREME_ROWS = 5
DISPLAY_ROWS = 1000
RECENT_TURNS = 12
FULL_TURNS = 4


def latest_version(df: DataFrame, key: str = "entity", version: str = "version", ties: Sequence[str] = ()) -> DataFrame:
    """The highest version of every entity."""
    return first_per_key(df, [key], [F.col(version).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]])


def first_per_grouping(df: DataFrame, grouping: str, order: Sequence[Column], n: int) -> DataFrame:
    """Cap each grouping set separately, so a large one cannot crowd out the totals row."""
    return first_per_key(df, [grouping], order, n)


def _total_order(metric: str, tie_breakers: Sequence[str], descending: bool) -> list[Column]:
    lead = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return [lead, *[F.col(c).asc_nulls_last() for c in tie_breakers if c != metric]]


def extremes(df: DataFrame, metric: str, tie_breakers: Sequence[str], rows: int = EXTREME_ROWS) -> DataFrame:
    """The best and the worst whole rows, labelled ``top`` / ``bottom`` with their position."""
    parts = []
    for end, descending in (("top", True), ("bottom", False)):
        order = _total_order(metric, tie_breakers, descending)
        cut = df.orderBy(*order).limit(rows)
        # at most `rows` rows reach this window
        parts.append(cut.withColumn("end", F.lit(end)).withColumn("position", F.row_number().over(Window.orderBy(*order))))
    return parts[0].unionByName(parts[1])


def extremes_by(
    df: DataFrame, keys: Sequence[str], metric: str, tie_breakers: Sequence[str], rows: int = EXTREME_ROWS
) -> DataFrame:
    """:func:`extremes` for many results at once."""
    parts = []
    for end, descending in (("top", True), ("bottom", False)):
        w = Window.partitionBy(*keys).orderBy(*_total_order(metric, tie_breakers, descending))
        parts.append(
            df.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= rows)
            .withColumn("end", F.lit(end))
        )
    return parts[0].unionByName(parts[1])


def display_cap(df: DataFrame, rows: int = DISPLAY_ROWS) -> DataFrame:
    """The first rows under ORDER BY ALL; for showing, never for analysing."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]).limit(rows)


def most_recent(df: DataFrame, ts: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MED", 1).otherwise(2)


def newest_groups(df: DataFrame, group: str, ts: str, n: int) -> DataFrame:
    """Whole groups with the latest activity: a group is kept entire or not at all.

    Adds ``truncated``, true when older groups fell outside the cap.
    """
    last = df.groupBy(group).agg(F.max(ts).alias("_last"))
    # one row more than the cap tells whether anything was cut
    ranked = last.orderBy(F.col("_last").desc_nulls_last(), F.col(group).asc_nulls_last()).limit(n + 1)
    w = Window.orderBy(F.col("_last").desc_nulls_last(), F.col(group).asc_nulls_last())
    kept = (
        ranked.withColumn("_rn", F.row_number().over(w))
        .withColumn("truncated", F.max("_rn").over(Window.partitionBy()) > n)
        .filter(F.col("_rn") <= n)
        .select(F.col(group).alias("_g"), "truncated")
    )
    return df.join(kept, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def history_window(df: DataFrame, conversation: str, seq: str, last: int = RECENT_TURNS, full: int = FULL_TURNS) -> DataFrame:
    """The newest turns of every conversation: ``full`` in detail, the older ones compressed."""
    w = Window.partitionBy(conversation).orderBy(F.col(seq).desc_nulls_last())
    return (
        df.withColumn("recency", F.row_number().over(w))
        .filter(F.col("recency") <= last)
        .withColumn("detail", F.when(F.col("recency") <= full, "full").otherwise("compressed"))
    )
