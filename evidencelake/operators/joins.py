"""Joins that state their grain: one row per key on the side that must not fan out.

No side is broadcast by hint. AQE measures the shuffled side and switches to a broadcast below the session's
threshold; above it, a key holding a large share of the rows is split by the skew-join rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each group before the shuffle, so a hot key costs n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to the first match per key: rows of ``left`` never multiply."""
    return left.join(first_per_key(right, on, order), list(on), "left")


def join_aggregates(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_aggs: Sequence[Column],
    right_aggs: Sequence[Column],
    how: str = "inner",
) -> DataFrame:
    """Reduce each side to one row per key, then join: no fan-out whatever the key counts."""
    on = list(on)
    return left.groupBy(*on).agg(*left_aggs).join(right.groupBy(*on).agg(*right_aggs), on, how)


def having_match(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def left_with_defaults(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join whose misses read as the stated defaults rather than NULL."""
    return left.join(right, list(on), "left").fillna(dict(defaults))


def reconcile(documented: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Keys on only one side, with the side that has them."""
    d = documented.select(key).distinct().withColumn("_d", F.lit(True))
    v = live.select(key).distinct().withColumn("_l", F.lit(True))
    return (
        d.join(v, key, "full_outer")
        .filter(F.col("_d").isNull() | F.col("_l").isNull())
        .select(
            key,
            F.when(F.col("_l").isNull(), "documented_not_live").otherwise("live_not_documented").alias("status"),
        )
    )


def phantom_refs(df: DataFrame, target: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct non-empty references that name nothing known."""
    refs = df.filter(F.col(target).isNotNull() & (F.col(target).cast("string") != "")).select(F.col(target).alias("phantom")).distinct()
    return refs.join(known.select(F.col(known_key).alias("phantom")).distinct(), "phantom", "left_anti")


def membership_flag(df: DataFrame, key: str, members: DataFrame, member_key: str, flag: str) -> DataFrame:
    """Every row of ``df`` with whether its key is among the members."""
    m = members.select(F.col(member_key).alias("_m")).filter(F.col("_m").isNotNull()).distinct()
    return df.join(m, F.col(key) == F.col("_m"), "left").withColumn(flag, F.col("_m").isNotNull()).drop("_m")


def dense_hours(df: DataFrame, hour_ts: str, now_ts: Column, hours: int = 24, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join hourly rows onto a spine of ``hours`` slots ending at the current hour (epoch seconds)."""
    current = (F.floor(now_ts / 3600) * 3600).cast("long")
    spine = df.sparkSession.range(1).select(
        F.explode(F.sequence(current - (hours - 1) * 3600, current, F.lit(3600).cast("long"))).alias(hour_ts)
    )
    dense = spine.join(df, hour_ts, "left")
    return dense.fillna(dict(fill)) if fill else dense


def one_row(*frames: DataFrame) -> DataFrame:
    """Put several one-row aggregates side by side without a cross join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
