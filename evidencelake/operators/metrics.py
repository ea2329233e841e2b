"""Declared rates and set-membership funnels.

A :class:`RateSpec` names what is counted over what; every result carries both counts beside the rate.
Keys are reduced to one row with boolean flags before anything is counted, so several rates over one table
cost one scan and one shuffle and no distinct aggregate is expanded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.stats import ratio
from evidencelake.operators.hygiene import clean
from evidencelake.operators.joins import one_row


@dataclass(frozen=True)
class RateSpec:
    """``numerator`` and ``denominator`` are stage names; the result is ``<name>_rate`` of ``<name>_n``."""

    name: str
    numerator: str
    denominator: str


def stage_flags(
    stages: Mapping[str, DataFrame], key: str, by: Sequence[str] = (), hygiene: bool = True
) -> DataFrame:
    """One row per (segment, key) with a boolean per stage.

    Each stage table is read once, projected to its keys; the flags are OR-ed map-side before the shuffle.
    """
    parts = []
    for name, df in stages.items():
        rows = clean(df) if hygiene else df
        flags = [F.lit(other == name).alias(other) for other in stages]
        parts.append(rows.filter(F.col(key).isNotNull()).select(*by, key, *flags))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*by, key).agg(*[F.max(s).alias(s) for s in stages])


def key_flags(df: DataFrame, key: str, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per (segment, key) with whether any of its rows meets each condition."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(*by, key)
        .agg(*[F.max(F.coalesce(c, F.lit(False))).alias(s) for s, c in conditions.items()])
    )


def _stage(name: str) -> Column:
    """A stage column, or the conjunction of several joined by ``&``."""
    condition = F.lit(True)
    for part in name.split("&"):
        condition = condition & F.col(part.strip())
    return condition


def rates(flags: DataFrame, specs: Sequence[RateSpec], by: Sequence[str] = ()) -> DataFrame:
    """All declared rates of a flag table in one aggregate: numerator count, denominator count, rate."""
    aggs = []
    for s in specs:
        aggs.append(F.count_if(_stage(s.numerator)).alias(f"{s.name}_hits"))
        aggs.append(F.count_if(_stage(s.denominator)).alias(f"{s.name}_n"))
    out = flags.groupBy(*by).agg(*aggs)
    for s in specs:
        out = out.withColumn(f"{s.name}_rate", ratio(F.col(f"{s.name}_hits"), F.col(f"{s.name}_n")))
    return out


def row_rates(df: DataFrame, conditions: Mapping[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Rates over rows rather than keys: ``name -> (numerator, denominator)`` conditions."""
    aggs = []
    for name, (num, den) in conditions.items():
        aggs += [F.count_if(num & den).alias(f"{name}_hits"), F.count_if(den).alias(f"{name}_n")]
    out = df.groupBy(*by).agg(*aggs)
    for name in conditions:
        out = out.withColumn(f"{name}_rate", ratio(F.col(f"{name}_hits"), F.col(f"{name}_n")))
    return out


def funnel(flags: DataFrame, stages: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Set-membership funnel in long form: keys per stage, step-through and drop-off to the next.

    Event times are not reliably ordered, so a key reaches a stage by having an event there, no more.
    """
    wide = flags.groupBy(*by).agg(*[F.count_if(F.col(s)).alias(s) for s in stages])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_index"),
                F.lit(s).alias("stage"),
                F.col(s).alias("keys_n"),
                (F.col(stages[i + 1]) if i + 1 < len(stages) else F.lit(None).cast("long")).alias("next_n"),
            )
            for i, s in enumerate(stages)
        ]
    )
    long = wide.select(*by, F.inline(rows))
    step = ratio(F.col("next_n"), F.col("keys_n"))
    return long.withColumn("step_through_rate", step).withColumn("drop_off_rate", 1 - step)


def largest_drop(funnel_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The stage losing the largest share; the earliest wins a tie."""
    w = Window.partitionBy(*by).orderBy(F.col("drop_off_rate").desc_nulls_last(), F.col("stage_index"))
    return (
        funnel_rows.filter(F.col("drop_off_rate").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn")
    )


def monthly_rate(df: DataFrame, ts: str, hit: Column, population: Column, by: Sequence[str] = ()) -> DataFrame:
    """A rate per calendar month and segment."""
    month = F.date_format(F.col(ts), "yyyy-MM").alias("month")
    return row_rates(df.withColumn("month", month), {"month": (hit, population)}, ["month", *by])


def compare(df: DataFrame, dim: str, a: str, b: str, hits: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Segment ``a`` against ``b``: both rates with their samples, gap in points, lift as a ratio."""
    sums = df.groupBy(*by).agg(
        *[
            F.sum(F.when(F.col(dim) == side, F.col(col))).alias(f"{label}_{name}")
            for label, side in (("a", a), ("b", b))
            for name, col in (("hits", hits), ("n", n))
        ]
    )
    ra, rb = ratio(F.col("a_hits"), F.col("a_n")), ratio(F.col("b_hits"), F.col("b_n"))
    return sums.select(
        "*", ra.alias("a_rate"), rb.alias("b_rate"), ((ra - rb) * 100).alias("gap_pp"), F.try_divide(ra, rb).alias("lift")
    )


def best_and_worst(df: DataFrame, dim: str, rate: str) -> DataFrame:
    """The best and worst segment of a rate; equal rates resolve to the first segment by name."""
    known = df.filter(F.col(rate).isNotNull())
    best = known.orderBy(F.col(rate).desc(), F.col(dim)).limit(1).select(F.lit("best").alias("which"), "*")
    worst = known.orderBy(F.col(rate).asc(), F.col(dim)).limit(1).select(F.lit("worst").alias("which"), "*")
    return best.unionByName(worst)


def session_audit(starts: DataFrame, downstream: DataFrame, session: str) -> DataFrame:
    """Is every start its own session, and does every downstream session appear among the starts?"""
    per_session = starts.groupBy(session).agg(F.count(F.lit(1)).alias("_rows"))
    started = per_session.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("start_rows"),
        F.count(F.col(session)).alias("start_sessions"),
    )
    later = downstream.filter(F.col(session).isNotNull()).select(session).distinct()
    marked = later.join(per_session.select(F.col(session).alias("_s")), F.col(session) == F.col("_s"), "left")
    contained = marked.agg(
        F.count(F.lit(1)).alias("downstream_sessions"), F.count_if(F.col("_s").isNull()).alias("orphan_sessions")
    )
    return one_row(started, contained).withColumn("unique_starts", F.col("start_rows") == F.col("start_sessions"))


def ordering_audit(up: DataFrame, down: DataFrame, key: str, up_ts: str, down_ts: str) -> DataFrame:
    """Share of keys whose first downstream event precedes their first upstream event."""
    u = up.groupBy(key).agg(F.min(up_ts).alias("_u"))
    d = down.groupBy(key).agg(F.min(down_ts).alias("_d"))
    counted = u.join(d, key).agg(
        F.count(F.lit(1)).alias("keys_n"), F.count_if(F.col("_d") < F.col("_u")).alias("out_of_order_n")
    )
    return counted.withColumn("out_of_order_rate", ratio(F.col("out_of_order_n"), F.col("keys_n")))


def dangling_refs(df: DataFrame, ref: str, key: str) -> DataFrame:
    """References (with multiplicity) that resolve to no row of the same table."""
    refs = df.filter(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("_ref")).agg(F.count(F.lit(1)).alias("_c"))
    ids = df.select(F.col(key).alias("_id")).distinct()
    return refs.join(ids, F.col("_ref") == F.col("_id"), "left").agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("reference_rows"),
        F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_c"))), F.lit(0)).alias("dangling_rows"),
    )


def revenue_per_conversion(df: DataFrame, amount: str, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum, mean and conversions per unit, on exact decimals."""
    out = df.groupBy(*by, unit).agg(
        F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("revenue_sum"),
        F.count(F.col(amount)).alias("conversions_n"),
    )
    return out.withColumn("revenue_per_conversion", ratio(F.col("revenue_sum"), F.col("conversions_n")))


def share_of_total(df: DataFrame, value: str, share: str = "share_pct", by: Sequence[str] = ()) -> DataFrame:
    """Each row's percentage of the total, one decimal; ``df`` is an aggregate, its total a small second pass."""
    if not by:
        total = df.agg(F.sum(value)).scalar()
        return df.withColumn(share, _share(F.col(value), total))
    totals = df.groupBy(*[F.col(k).alias(f"_t_{k}") for k in by]).agg(F.sum(value).alias("_total"))
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return (
        df.join(totals, on).withColumn(share, _share(F.col(value), F.col("_total"))).drop("_total", *[f"_t_{k}" for k in by])
    )


def _share(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(ratio(value, total) * 1000 + 0.5) / 10).otherwise(0.0)


def repeatability(runs: DataFrame, question: str, wall: str, error: str, digests: Sequence[str]) -> DataFrame:
    """Per question: runs, median wall time over all runs, distinct digests among the good runs, failures."""
    from evidencelake.operators.quantiles import exact_quantiles, with_quantiles

    ok = F.col(error).isNull() | (F.col(error) == "")
    base = runs.groupBy(question).agg(
        F.count(F.lit(1)).alias("runs_n"), F.count_if(~ok).alias("failures_n")
    )
    medians = exact_quantiles(runs, [question], wall, {"median_wall": ("interpolated", 0.5)})
    out = with_quantiles(base, medians, [question])
    for d in digests:
        distinct = (
            runs.filter(ok).select(question, d).distinct().groupBy(question).agg(F.count(d).alias(f"{d}_distinct"))
        )
        out = out.join(distinct, question, "left").fillna({f"{d}_distinct": 0})
    return out
