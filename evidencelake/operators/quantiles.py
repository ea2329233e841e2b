"""Exact quantiles whose memory does not grow with the largest group.

``percentile`` and ``percentile_disc`` keep a map of every distinct value of a group in one task. Here the
values are counted first (map-side combined) and folded to buckets that preserve their order and are the same for
every group, so nothing has to be known of a group beforehand; the bucket that holds a wanted rank follows from the
counts alone, and only its values are sorted. The input is read once: both passes are over the same counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each e-fold of the values, and where the scale turns linear: at 64 bits a group has a few million buckets at most.
STEPS, SMALLEST = 1 << 16, 1e-12


def order_bucket(value: Column) -> Column:
    """A bucket number that never decreases as the value grows: logarithmic, about 1.5e-5 of the value wide, so whole numbers below some ten thousands are alone in theirs."""
    v = value.cast("double")
    place = F.signum(v) * F.log1p(F.abs(v) / SMALLEST) * STEPS
    return F.when(F.isnan(v), 1 << 40).otherwise(F.floor(F.least(F.greatest(place, F.lit(-1e9)), F.lit(1e9)))).cast("long")


MERGES = {"sum": F.sum, "max": F.max, "min": F.min}


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, tuple[str, float]],
    weight: str | None = None,
    also: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per key with ``n`` and the wanted quantiles of a numeric column.

    ``wanted`` maps an output name to ``("upper", q)`` - the element at 0-based position ``floor(q * n)``,
    so the upper middle at ``q = 0.5`` - or ``("interpolated", q)`` - linear between the neighbours of
    ``q * (n - 1)``. NULL values are ignored; a group without values yields no row. ``weight`` names a column that
    says how many rows a row stands for. ``also`` maps further output names to ``("sum" | "max" | "min", column)``, taken over the
    same rows on the way.
    """
    keys, also = list(keys), dict(also or {})
    ranks: dict[str, Column] = {}
    fractions: dict[str, Column] = {}
    n = F.col("_n")
    for name, (kind, q) in wanted.items():
        if kind == "upper":
            ranks[f"{name}__lo"] = F.least(F.floor(n * q).cast("long") + 1, n)
        elif kind == "interpolated":
            position = (n - 1) * F.lit(float(q))
            ranks[f"{name}__lo"] = F.floor(position).cast("long") + 1
            ranks[f"{name}__hi"] = F.ceil(position).cast("long") + 1
            fractions[name] = position - F.floor(position)
        else:
            raise ValueError(f"unknown quantile kind {kind!r}")

    merged = lambda: [MERGES[how](f"_also_{name}").alias(f"_also_{name}") for name, (how, _) in also.items()]
    counts = (
        df.filter(F.col(value).isNotNull())
        .select(
            *keys, F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"),
            *[F.col(c).alias(f"_also_{name}") for name, (_, c) in also.items()],
        )
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_c"), *merged())
        .withColumn("_b", order_bucket(F.col("_v")))
    )
    group = Window.partitionBy(*[F.col(k) for k in keys])
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, so these windows are bounded by the number of buckets
    buckets = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"), *merged())
        .withColumn("_n", F.sum("_bc").over(group))
        .withColumn("_off", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
        .withColumns({f"_all_{name}": MERGES[how](f"_also_{name}").over(group) for name, (how, _) in also.items()})
    )
    low, high = F.col("_off"), F.col("_off") + F.col("_bc")
    hit = F.lit(False)
    for r in ranks.values():
        hit = hit | ((r > low) & (r <= high))
    kept = [f"_all_{name}" for name in also]
    # what lies between the hit buckets: a running sum over their values alone is short of a value's rank by it
    hits = (
        buckets.filter(hit)
        .withColumn("_skipped", F.col("_off") - F.coalesce(F.sum("_bc").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_hb"), "_n", "_skipped", *kept)
    )
    # null-safe, though no bucket is null: an equality would filter one side only, and the counts would be made twice
    on = F.col("_b").eqNullSafe(F.col("_hb"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    running = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.select(*keys, "_v", "_c", "_b").join(hits, on)
        .withColumn("_to", F.col("_skipped") + F.sum("_c").over(running))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    picks = [
        F.max(F.when((r > F.col("_from")) & (r <= F.col("_to")), F.col("_v"))).alias(name)
        for name, r in ranks.items()
    ]
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks, *[F.max(c).alias(c) for c in kept])
    columns = []
    for name, (kind, _) in wanted.items():
        lo = F.col(f"{name}__lo")
        if kind == "upper":
            columns.append(lo.alias(name))
        else:
            lo, hi = lo.cast("double"), F.col(f"{name}__hi").cast("double")
            columns.append((lo + (hi - lo) * fractions[name]).alias(name))
    return out.select(*keys, F.col("_n").alias("n"), *columns, *[F.col(f"_all_{name}").alias(name) for name in also])


def with_quantiles(stats: DataFrame, quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach :func:`exact_quantiles` output to an aggregate on the same keys."""
    renamed = quantiles.drop("n")
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_q_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_q_{k}"))
    return stats.join(renamed, on, "left").drop(*[f"_q_{k}" for k in keys])


def ordered_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str
) -> DataFrame:
    """0-based position of every row within its group, without one task sorting a large group.

    ``bucket`` must not decrease along ``order`` (the minute of the leading timestamp, say): rows are numbered inside
    their bucket and shifted by the sizes of the buckets before it. With no keys the whole frame is one group.
    """
    keys = list(keys)
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bc"))
    # one row per bucket, so this window is bounded by the number of buckets
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_off"),
    )
    on = F.col("_b").eqNullSafe(F.col("_ob"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        rows.join(offsets, on)
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_b", "_ob", "_off", *[f"_k_{k}" for k in keys])
    )
