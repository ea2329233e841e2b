"""Typed event tables: planned from a profile, written partitioned and sorted, checked after the load."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.session import materialise

# How long each kind of table is kept.
RETENTION = {"events": "interval 1 year", "runs_log": "interval 90 days", "answers": "interval 30 days"}


def typed_columns(columns: Sequence[tuple[str, str]]) -> list[Column]:
    """Columns of a flattened event cast to their planned types; a value that does not fit is NULL.

    ``columns`` are ``(field, spark type)`` pairs; arrays and objects land in string columns as JSON.
    """
    out = []
    for name, spark_type in columns:
        v = F.element_at("fields", F.lit(name))
        text = F.try_variant_get(v, "$", "string")
        value = text if spark_type == "string" else text.try_cast(spark_type)
        if spark_type in ("tinyint", "smallint", "int", "bigint"):
            # 1e3 reads as a double: take the number, then its integer type; a fraction does not fit
            number = F.try_variant_get(v, "$", "double")
            value = F.when(number == F.floor(number), number.try_cast(spark_type))
        out.append(value.alias(name))
    return out


def load_events(events: DataFrame, event: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The typed rows of one event type."""
    return events.filter(F.col("event") == event).select(*typed_columns(columns))


MONTH = "month"


def _laid_out(df: DataFrame, sort_keys: Sequence[str], ts: str | None, ranges: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` with its month, dealt by ranges of (month, sort keys) and sorted, and the partition columns.

    Files of a month thus hold ranges of the sort keys that do not overlap, so that a lookup reads one of them; a hot month
    is several ranges. Rows without a timestamp are a month of their own. Without ``ranges`` their number follows the data's size.
    """
    partition = []
    if ts and ts in df.columns:
        df, partition = df.withColumn(MONTH, F.date_format(ts, "yyyyMM")), [MONTH]
    if sort_keys:
        count = [ranges] if ranges else []
        df = df.repartitionByRange(*count, *partition, *sort_keys).sortWithinPartitions(*partition, *sort_keys)
    return df, partition


def write_event_table(
    df: DataFrame, path: str, sort_keys: Sequence[str] = (), ts: str | None = "timestamp", bloom: Sequence[str] = (),
    ranges: int | None = None,
) -> None:
    """Overwrite a table: one partition per month, sorted by ranges so min/max statistics prune.

    Overwriting makes a retried load idempotent. Runs a job.
    """
    laid_out, partition = _laid_out(df, sort_keys, ts, ranges)
    writer = laid_out.write.mode("overwrite").option("compression", "zstd")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def save_event_table(df: DataFrame, name: str, sort_keys: Sequence[str] = (), ts: str = "timestamp", ranges: int | None = None) -> None:
    """The same as a table of the catalog, whose months :func:`expire_months` can drop. Runs a job."""
    laid_out, partition = _laid_out(df, sort_keys, ts, ranges)
    laid_out.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition).saveAsTable(name)


def file_ranges(table: DataFrame, keys: Sequence[str], partition: str = MONTH) -> DataFrame:
    """Per file of a written table: its partition, rows and least and greatest sort key, from the key columns alone."""
    key = F.struct(*keys)
    return table.groupBy(partition, F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows_n"), F.min(key).alias("low"), F.max(key).alias("high")
    )


def layout_check(files: DataFrame, partition: str = MONTH) -> DataFrame:
    """Per partition of :func:`file_ranges`: files, rows, key range, and how many files begin before an earlier one ends."""
    earlier = Window.partitionBy(partition).orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)
    marked = files.withColumn("overlaps", F.coalesce(F.col("low") <= F.max("high").over(earlier), F.lit(False)))
    return marked.groupBy(partition).agg(
        F.count(F.lit(1)).alias("files_n"), F.sum("rows_n").alias("rows_n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count_if("overlaps").alias("overlapping_n"),
    )


def stage_by_event(events: DataFrame, path: str) -> None:
    """Split a mixed capture by discriminator in one pass, so each typed load reads its own partition only.

    ``events`` carry ``event`` and the raw ``value`` line. Runs a job.
    """
    events.select("event", "value").write.mode("overwrite").partitionBy("event").parquet(path)


def split_by_event(events: DataFrame) -> DataFrame:
    """Rows per event type of a mixed capture."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("rows_n"))


def verify_counts(source: DataFrame, loaded: DataFrame, event: str = "event") -> DataFrame:
    """Source against table rows per event, with the verdict; an event on one side only is a mismatch."""
    s = source.groupBy(event).agg(F.count(F.lit(1)).alias("source_rows"))
    t = loaded.groupBy(event).agg(F.count(F.lit(1)).alias("table_rows"))
    return s.join(t, event, "full_outer").fillna({"source_rows": 0, "table_rows": 0}).withColumn(
        "matches", F.col("source_rows") == F.col("table_rows")
    )


def expire(df: DataFrame, ts: str, interval: str, now: Column | None = None) -> DataFrame:
    """Rows still within their retention."""
    return df.filter(F.col(ts) >= (now if now is not None else F.current_timestamp()) - F.expr(interval))


def expire_months(spark: SparkSession, name: str, ts: str, keep_from: str, sort_keys: Sequence[str] = ()) -> dict[str, list[str]]:
    """Free what is older than ``keep_from`` (a timestamp literal) in a table of :func:`save_event_table`.

    Months before it are dropped from the catalog with their files; of its own month only, the rows to keep are written anew by an
    overwrite of that partition; later months keep their files. Rows without a timestamp stay. Run again, it finds nothing to do. The rows to
    keep are written to the shared folder first, as a table cannot be overwritten while it is read. Returns the months dropped and rewritten.
    """
    bound = F.lit(keep_from).cast("timestamp")
    boundary = spark.range(1).select(F.date_format(bound, "yyyyMM")).first()[0]
    # one entry for each month of the table
    months = sorted(p[0].split("=", 1)[1] for p in spark.sql(f"SHOW PARTITIONS {name}").collect())
    old, rewritten = [m for m in months if m.isdigit() and m < boundary], []
    if boundary in months:
        own = spark.table(name).filter(F.col(MONTH) == boundary)
        count = own.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col(ts) >= bound).alias("kept")).first()
        if not count.kept:
            old.append(boundary)
        elif count.kept < count.all:
            kept = materialise(own.filter(F.col(ts) >= bound), "kept")
            if sort_keys:
                kept = kept.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
            columns = ", ".join(f"`{c}`" for c in kept.columns if c != MONTH)
            spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({MONTH} = '{boundary}') SELECT {columns} FROM {{kept}}", kept=kept)
            rewritten.append(boundary)
    if old:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION ({MONTH} = '{m}')" for m in old))
    return {"dropped": old, "rewritten": rewritten}


def document_table(spark: SparkSession, name: str, comment: str, columns: Mapping[str, str]) -> list[str]:
    """Write table and column comments; columns the table does not have are skipped. Returns those documented."""
    quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {name} IS '{quoted}'")
    live = spark.table(name).columns
    done = [c for c in columns if c in live]
    for column in done:
        text = columns[column].replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{column}` COMMENT '{text}'")
    return done


def schema_lines(columns: DataFrame) -> DataFrame:
    """One line per table naming its columns and types: ``columns(table, position, name, type)``."""
    lines = columns.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "name", "type").alias("c")))).alias("l")
    )
    return lines.select("table", F.concat(F.lit("- "), "table", F.lit(": "), F.array_join(F.col("l.c"), ", ")).alias("line"))
