"""Row hygiene: duplicate copies, backfilled rows, messy dimensions, unit-safe money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.stats import ratio
from evidencelake.functions.text import nullish

# The device types that together form the web cohort.
WEB_DEVICES = ("web-user-b2c", "Desktop")


def not_duplicate(c: Column) -> Column:
    """A non-null duplicate id marks the row itself as the copy; the id resolves to nothing, so never join on it."""
    return c.isNull()


def not_backfilled(c: Column) -> Column:
    """``!= 1`` under three-valued logic: a NULL flag is dropped too."""
    return c != 1


def clean(df: DataFrame, duplicate: str = "duplicate_id", backfill: str = "is_back_filled") -> DataFrame:
    """Apply each filter only where its column exists."""
    if duplicate in df.columns:
        df = df.filter(not_duplicate(F.col(duplicate)))
    if backfill in df.columns:
        df = df.filter(not_backfilled(F.col(backfill)))
    return df


def os_bucket(os: Column) -> Column:
    return F.when(nullish(os), "unknown").otherwise(os)


def device_cohort(device_type: Column) -> Column:
    return F.when(device_type.isin(*WEB_DEVICES), "web").otherwise(device_type)


def acquisition(gclid: Column, fbclid: Column) -> Column:
    return F.when(~nullish(gclid), "paid_search").when(~nullish(fbclid), "paid_social").otherwise("organic")


def eta_hours(bucket: Column) -> Column:
    """``'3-5 days'`` or ``'24 hours'`` as ``struct<min_hours, max_hours>``."""
    first = F.regexp_extract(bucket, r"^\s*(\d+)", 1).try_cast("int")
    last = F.regexp_extract(bucket, r"-\s*(\d+)", 1).try_cast("int")
    unit = F.when(bucket.rlike(r"(?i)day"), 24).when(bucket.rlike(r"(?i)hour"), 1)
    return F.struct((first * unit).alias("min_hours"), (F.coalesce(last, first) * unit).alias("max_hours"))


def hygiene_report(
    df: DataFrame, by: Sequence[str] = (), duplicate: str = "duplicate_id", backfill: str = "is_back_filled"
) -> DataFrame:
    """Raw and clean row counts and what each filter removes, from one scan."""
    dup, back = F.col(duplicate), F.col(backfill)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(not_duplicate(dup) & not_backfilled(back)).alias("clean_rows"),
        F.count_if(~not_duplicate(dup)).alias("duplicate_rows"),
        F.count_if(back == 1).alias("backfill_rows"),
    )
    raw = F.col("raw_rows")
    return counted.select(
        "*",
        F.round(ratio((F.col("clean_rows") - raw) * 100, raw), 2).alias("delta_pct"),
        F.round(ratio(F.col("duplicate_rows") * 100, raw), 2).alias("duplicate_pct"),
        F.round(ratio(F.col("backfill_rows") * 100, raw), 2).alias("backfill_pct"),
    )


def within(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Explicit reporting window ``[start, end)``; no window is ever implied."""
    # plain texts take the column's own timestamp type, which keeps the bound pushed into the scan
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def sum_money(df: DataFrame, amount: str, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals per unit; a total across units is not expressible. Summed as decimals, so order cannot matter."""
    return df.groupBy(*by, unit).agg(
        F.sum(F.col(amount).cast("decimal(18,2)")).alias(f"{amount}_sum"),
        F.count(F.col(amount)).alias(f"{amount}_n"),
    )
