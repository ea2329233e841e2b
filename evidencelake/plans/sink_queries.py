"""Tables and streams that are written to the shared folder and read back: intake, hourly counts, monthly tables, retention, run log.

Each query writes to a path of its own and returns what a reader then finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.plans.log_queries import LOG, query_log
from evidencelake.plans.registry import Tables, query
from evidencelake.plans.source_queries import LINES, TYPED, raw_lines
from evidencelake.plans.store_queries import RUNS, runs_log
from evidencelake.session import fresh_path
from evidencelake.sources import tables, versions
from evidencelake.streaming import intake


@query("STR1 SRC2 SRC3 SRC4 SRC6 SRC7", f"""
WITH {LINES}, taken AS (SELECT CAST(CASE WHEN event_id % 5 < 3 THEN 1 ELSE 2 END AS INTEGER) AS start, CASE WHEN bad THEN 'unknown_event' ELSE event END AS event, bad AS malformed, value FROM base WHERE NOT blank)
SELECT start, event, malformed, count(*) AS rows_n, count(*) FILTER (WHERE event = 'purchase') AS typed_n, round(coalesce(sum(value) FILTER (WHERE event = 'purchase'), 0), 2) AS typed_amount FROM taken GROUP BY 1, 2, 3""")
def streamed_intake(t: Tables) -> DataFrame:
    """A capture in five files taken in by a stream that is started three times on one checkpoint: with three files, with two more, with nothing new.

    Rows per start and event as staged, malformed lines in quarantine, and the rows and amounts of the typed purchase table.
    """
    root = fresh_path(t.spark, "intake")
    lines = raw_lines(t).select("value", "file")
    last = []
    for files in (("file_0", "file_1", "file_2"), ("file_3", "file_4"), ()):
        if files:
            lines.filter(F.col("file").isin(*files)).write.mode("append").partitionBy("file").text(f"{root}/in")
        intake.stream_events(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", "keep", {"purchase": TYPED}).awaitTermination()
        last.append(intake.staged_lines(t.spark, f"{root}/out").agg(F.max("batch")).first()[0])
    # a start that took nothing in has no batches
    start = F.when(F.col("batch") <= last[0], 1).when(F.col("batch") <= last[1], 2).otherwise(3).alias("start")
    staged = intake.staged_lines(t.spark, f"{root}/out").groupBy(start, "event", "malformed").agg(F.count(F.lit(1)).alias("rows_n"))
    typed = intake.typed_rows(t.spark, f"{root}/out", "purchase").groupBy(start, F.lit("purchase").alias("event"), F.lit(False).alias("malformed")).agg(
        F.count("id").alias("typed_n"), F.sum("amount").cast("double").alias("typed_amount")
    )
    return staged.join(typed, ["start", "event", "malformed"], "left").fillna({"typed_n": 0, "typed_amount": 0.0})


LATE, SPLIT = "6 hours", "2024-01-15"


@query("STR2", f"""
WITH {LOG}, sent AS (SELECT event_time, ms, query_id % 10 = 3 AND event_time < TIMESTAMP '{SPLIT}' AS held, event_time < TIMESTAMP '{SPLIT}' AS early, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS done FROM log),
first_mark AS (SELECT max(event_time) - INTERVAL 6 HOURS AS m FROM sent WHERE early AND NOT held),
last_mark AS (SELECT max(event_time) - INTERVAL 6 HOURS AS m FROM sent),
counted AS (SELECT * FROM sent, first_mark WHERE (early AND NOT held) OR done > m)
SELECT CAST(epoch(done - INTERVAL 1 HOUR) AS BIGINT) AS hour_ts, count(*) AS queries, max(ms) AS max_ms FROM counted WHERE done <= (SELECT m FROM last_mark) GROUP BY done""")
def hourly_stream(t: Tables) -> DataFrame:
    """Hours of the log as a stream gives them out that is started twice: the second part brings every tenth query of the first one late.

    Late queries of hours less than six hours behind count, others do not; the last six hours are not complete yet.
    """
    root = fresh_path(t.spark, "hours")
    log = query_log(t).select(F.col("event_time").cast("timestamp").alias("event_time"), "query_duration_ms", "query_id")
    early = F.col("event_time") < F.lit(SPLIT).cast("timestamp")
    held = early & (F.col("query_id") % 10 == 3)
    for part in (early & ~held, ~early | held):
        log.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(log.schema).parquet(f"{root}/in")
        intake.sink_hourly_counts(stream, f"{root}/out", f"{root}/checkpoint", LATE).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("hour_ts", "queries", "max_ms")


KEYS = ("o_custkey", "o_orderkey")


@query("SRC8", """
SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS rows_n, min(o_custkey) AS low_custkey, max(o_custkey) AS high_custkey, CAST(0 AS BIGINT) AS overlapping_n, CAST(1 AS BIGINT) AS lookup_files_n, true AS sorted FROM orders GROUP BY 1""")
def monthly_table(t: Tables) -> DataFrame:
    """Orders written by month in ranges of customer and order; per month the rows and keys of its files, from the files.

    No file begins before an earlier one of its month ends, so a month and a customer lead to one file (more only for a customer at a file's edge); rows are sorted inside.
    """
    path = fresh_path(t.spark, "monthly")
    tables.write_event_table(t.orders, path, KEYS, "o_orderdate", bloom=["o_orderkey"], ranges=120)
    written = t.spark.read.parquet(path).withColumn(tables.MONTH, F.col(tables.MONTH).cast("string"))
    files = tables.file_ranges(written, KEYS)
    checked = tables.layout_check(files)
    least = checked.select(tables.MONTH, F.col("low").alias("least"))
    lookups = files.join(least, tables.MONTH).filter(F.col("least").between(F.col("low"), F.col("high"))).groupBy(tables.MONTH).agg(F.count(F.lit(1)).alias("lookup_files_n"))
    order = F.array_sort(F.collect_list(F.struct("place", "key")))
    row = F.struct(F.col("_metadata.row_index").alias("place"), F.struct(*KEYS).alias("key"))
    steps = written.select(tables.MONTH, F.col("_metadata.file_path").alias("file"), row.alias("r"), (F.col("_metadata.row_index") / 1000).cast("long").alias("stretch"))
    # stretches of a thousand rows of a file, each looked at on its own
    runs = steps.groupBy(tables.MONTH, "file", "stretch").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    sorted_ = runs.groupBy(tables.MONTH).agg(F.every(F.transform("rs", lambda r: r["key"]) == F.array_sort(F.transform("rs", lambda r: r["key"]))).alias("sorted"))
    return checked.join(lookups, tables.MONTH).join(sorted_, tables.MONTH).select(
        tables.MONTH, "rows_n", F.col("low.o_custkey").alias("low_custkey"), F.col("high.o_custkey").alias("high_custkey"), "overlapping_n", "lookup_files_n", "sorted"
    )


@query("SRC9", """
WITH bound AS (SELECT max(o_orderdate) - INTERVAL 1 YEAR - INTERVAL 10 DAYS AS keep_from FROM orders),
months AS (SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) FILTER (o_orderdate >= keep_from) AS rows_n, count(*) FILTER (o_orderdate >= keep_from) = count(*) AS files_kept FROM orders, bound GROUP BY 1)
SELECT month, rows_n, files_kept FROM months WHERE rows_n > 0""")
def retention_rewrite(t: Tables) -> DataFrame:
    """Orders kept for a year and ten days: older months dropped, the boundary month written anew, later months with the very files that they had."""
    spark, database = t.spark, "retained_" + fresh_path(t.spark, "r")[-32:]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(spark, 'retained')}'")
    name = f"{database}.orders_by_month"
    tables.save_event_table(t.orders, name, KEYS, "o_orderdate", ranges=120)
    files = lambda: spark.table(name).groupBy(tables.MONTH, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written")).agg(F.count(F.lit(1)).alias("rows_n"))
    before = tables.materialise(files().drop("rows_n"), "files").withColumn("kept", F.lit(True))
    keep_from = t.orders.select(F.date_format(F.max("o_orderdate") - F.expr(tables.RETENTION["events"]) - F.expr("interval 10 days"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    tables.expire_months(spark, name, "o_orderdate", keep_from, KEYS)
    after = files().join(before, [tables.MONTH, "file", "written"], "left")
    return after.groupBy(tables.MONTH).agg(F.sum("rows_n").alias("rows_n"), F.every(F.coalesce("kept", F.lit(False))).alias("files_kept"))


@query("SRC13", f"""
WITH {RUNS} SELECT run_id, seq, type, name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_time, strftime(ts, '%Y-%m-%d') AS day FROM runs""")
def run_event_log(t: Tables) -> DataFrame:
    """The run log as three appends left it, the second of them sent twice and the last with the first's events again."""
    path, log = fresh_path(t.spark, "runs"), runs_log(t)
    part = lambda *n: log.filter((F.col("seq") % 3).isin(*n))
    for batch in (part(0), part(1), part(1), part(0, 2)):
        versions.append_run_events(batch, path)
    return versions.read_run_events(t.spark, path).select(
        "run_id", "seq", "type", "name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time"), F.col("day").cast("string").alias("day")
    )
