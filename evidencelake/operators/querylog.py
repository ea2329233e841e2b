"""Operational analytics over a query log.

``log(type, event_time, query_id, query_duration_ms, read_rows, written_rows, query_kind, query, databases, tables,
log_comment)``. What was not measured is NULL with a flag, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.stats import ratio
from evidencelake.functions.text import query_shape
from evidencelake.operators.joins import dense_hours
from evidencelake.operators.knowledge import INTERNAL_TABLES, origin
from evidencelake.operators.metrics import share_of_total
from evidencelake.operators.quantiles import exact_quantiles
from evidencelake.operators.topk import severity_rank
from evidencelake.session import materialise

# Fixed values.
WINDOW_HOURS, READS_HOURS = 24, 720
SPIKE_FACTOR, SPIKE_FLOOR_MS = 2, 100
COST_SHAPES, SLOWEST, RECENT, MAX_SUGGESTIONS = 8, 5, 20, 20
ALLOWED_STATEMENTS = (
    r"^alter\s+table\s+[\w.`\"]+\s+modify\s+ttl\s+",
    r"^alter\s+table\s+[\w.`\"]+\s+add\s+column\s+",
    r"^alter\s+table\s+[\w.`\"]+\s+modify\s+column\s+",
    r"^create\s+materialized\s+view\s+(if\s+not\s+exists\s+)?[\w.`\"]+",
    r"^optimize\s+table\s+[\w.`\"]+",
)
FORBIDDEN_WORDS = r"\b(drop|truncate|rename|attach|detach|delete\s+where|insert\s+into|grant|revoke|system\s+)\b"


def whole_ms(ms: Column) -> Column:
    """Whole milliseconds, halves to the even one; interpolation noise is cut first."""
    return F.bround(F.round(ms, 6), 0)


def attribution(comment: Column, app: str) -> Column:
    """``struct<agent, run, step>`` from our own JSON comments; anything else is unattributed."""
    parsed = F.from_json(comment, "struct<app:string,agent:string,run:string,step:string>")
    ours = parsed["app"] == app
    return F.struct(*[F.when(ours, parsed[f]).alias(f) for f in ("agent", "run", "step")])


def in_scope(log: DataFrame, database: str, now: Column, hours: int = WINDOW_HOURS, observer: str = "observe") -> DataFrame:
    """Finished queries of the window that touched our database and were not the observer's own."""
    agent = F.coalesce(F.get_json_object("log_comment", "$.agent"), F.lit(""))
    return log.filter(
        (F.col("type") == "QueryFinish")
        & (F.col("event_time") >= now - F.make_dt_interval(hours=F.lit(hours)))
        & F.array_contains("databases", database)
        & (agent != observer)
    )


def window_stats(log: DataFrame) -> DataFrame:
    """Totals, hours and query shapes from one scan, told apart by ``grouping``; a query without a duration is not counted.

    The log is first folded to (hour, shape, duration), and the fold is written to the shared folder: the three groupings, their exact p95 and
    their other figures come from it, so no text is parsed twice, and a shape holding a third of the log is ranked by many tasks. Runs a job.
    """
    touched = F.greatest("read_rows", "written_rows")
    base = log.select(
        F.unix_timestamp(F.date_trunc("hour", "event_time")).alias("hour_ts"),
        query_shape(F.col("query")).alias("shape"),
        F.col("query_duration_ms").alias("ms"), "read_rows", touched.alias("touched"),
        F.struct(
            F.col("query_duration_ms"), F.col("event_time"), F.col("query_id"), F.col("query_kind"), touched.alias("touched"), F.col("log_comment")
        ).alias("slowest"),
    )
    folded = base.groupBy("hour_ts", "shape", "ms").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("read_rows").alias("rows_read"), F.max("touched").alias("max_rows"), F.max("slowest").alias("slowest"),
    )
    folded = materialise(folded, "log")
    no_hour, no_shape = F.lit(None).cast("long").alias("hour_ts"), F.lit(None).cast("string").alias("shape")
    groupings = F.array(
        F.struct(F.lit("total").alias("grouping"), no_hour, no_shape),
        F.struct(F.lit("hour").alias("grouping"), F.col("hour_ts"), no_shape),
        F.struct(F.lit("shape").alias("grouping"), no_hour, F.col("shape")),
    )
    measures = ["queries", "rows_read", "max_rows", "slowest"]
    stats = exact_quantiles(
        folded.select("ms", *measures, F.inline(groupings)), ["grouping", "hour_ts", "shape"], "ms", {"p95": ("interpolated", 0.95)}, "queries",
        {"rows_read": ("sum", "rows_read"), "max_rows": ("max", "max_rows"), "slowest": ("max", "slowest")},
    )
    return stats.select(
        "grouping", "hour_ts", "shape", F.col("n").alias("queries"), whole_ms(F.col("p95")).alias("p95_ms"), "rows_read",
        F.col("slowest.query_duration_ms").alias("max_ms"), "max_rows", F.col("slowest.query_kind").alias("top_kind"),
        F.col("slowest.touched").alias("top_rows"), F.col("slowest.log_comment").alias("top_log_comment"),
    )


def capped_window(stats: DataFrame, shapes: int = SLOWEST, hours: int = WINDOW_HOURS) -> DataFrame:
    """Window statistics with each grouping capped on its own: only ever shapes are cut, the fastest first."""
    from evidencelake.operators.topk import first_per_grouping

    order = [F.col("max_ms").desc(), F.col("hour_ts").asc_nulls_last(), F.col("shape").asc_nulls_last()]
    return first_per_grouping(stats, "grouping", order, max(shapes, hours + 2))


def spike_cause(kind: Column, rows: Column, agent: Column) -> Column:
    who = F.coalesce(F.concat(agent, F.lit(" ")), F.lit(""))
    what = F.when(F.coalesce(kind, F.lit("")) != "", F.lower(kind)).otherwise("query")
    size = F.when(rows > 0, F.concat(F.lit(" ("), F.format_number(rows, 0), F.lit(" rows)"))).otherwise("")
    return F.trim(F.concat(who, what, size))


def latency_series(hours: DataFrame, now_ts: Column, slots: int = WINDOW_HOURS, app: str = "evidencelake") -> DataFrame:
    """Dense hourly series with spikes: p95 at least twice the upper median of the busy hours, and 100ms.

    ``hours`` are the ``hour`` rows of :func:`window_stats`; ``slots`` rows come out, so the median is over a
    bounded set.
    """
    dense = dense_hours(
        hours.select("hour_ts", "p95_ms", "queries", "top_kind", "top_rows", "top_log_comment"),
        "hour_ts", now_ts, slots, {"p95_ms": 0, "queries": 0},
    )
    busy = F.when(F.col("queries") > 0, F.col("p95_ms"))
    everything = Window.partitionBy()
    values = F.array_sort(F.collect_list(busy).over(everything))
    median = F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))
    threshold = F.greatest(median * SPIKE_FACTOR, F.lit(float(SPIKE_FLOOR_MS)))
    marked = dense.withColumn("_m", median).withColumn(
        "is_spike", (F.col("_m") > 0) & (F.col("queries") > 0) & (F.col("p95_ms") >= threshold)
    )
    cause = spike_cause(F.col("top_kind"), F.col("top_rows"), attribution(F.col("top_log_comment"), app)["agent"])
    return marked.select(
        "hour_ts", "p95_ms", "queries", "is_spike", F.when(F.col("is_spike"), cause).alias("spike_cause")
    )


def slowest_shapes(stats: DataFrame, n: int = SLOWEST) -> DataFrame:
    return stats.filter("grouping = 'shape'").orderBy(F.col("max_ms").desc(), "shape").limit(n)


def costliest_shapes(log: DataFrame, n: int = COST_SHAPES) -> DataFrame:
    """Shapes by runs times mean duration."""
    grouped = log.groupBy(query_shape(F.col("query")).alias("shape")).agg(
        F.count(F.lit(1)).alias("runs"), F.max("query_duration_ms").alias("max_ms"),
        F.sum("query_duration_ms").alias("_ms"), F.sum("read_rows").alias("rows_read"),
    )
    costed = grouped.withColumn("avg_ms", whole_ms(ratio(F.col("_ms"), F.col("runs"))))
    return (
        costed.orderBy((F.col("runs") * F.col("avg_ms")).desc(), "shape").limit(n)
        .select("shape", "runs", "max_ms", "avg_ms", "rows_read")
    )


def recent_queries(log: DataFrame, n: int = RECENT) -> DataFrame:
    return log.orderBy(F.col("event_time").desc(), F.col("query_id")).limit(n)


def strip_database(qualified: Column, database: str) -> Column:
    prefix = F.lit(f"{database}.")
    return F.when(F.startswith(qualified, prefix), F.substring(qualified, len(database) + 2, 1 << 20)).otherwise(qualified)


def reads_per_table(log: DataFrame, database: str, now: Column) -> DataFrame:
    """Reads in the last 24 hours and 30 days, from one scan of the longer window."""
    recent = F.col("event_time") >= now - F.make_dt_interval(hours=F.lit(WINDOW_HOURS))
    return (
        in_scope(log, database, now, READS_HOURS)
        .select(F.explode("tables").alias("qualified"), recent.alias("recent"))
        .groupBy(strip_database(F.col("qualified"), database).alias("table"))
        .agg(F.count_if("recent").alias("reads_24h"), F.count(F.lit(1)).alias("reads_30d"))
    )


def table_storage(files: DataFrame, base_tables: DataFrame | None = None) -> DataFrame:
    """Per table: bytes, rows, files, origin. ``files(table, path, bytes, rows)`` has one row per data file."""
    per_table = files.groupBy("table").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files")
    )
    if base_tables is None:
        return per_table.withColumn("origin", origin(F.col("table"), F.lit(False)))
    base = base_tables.select(F.col("table").alias("_b")).distinct()
    joined = per_table.join(base, F.col("table") == F.col("_b"), "left")
    return joined.withColumn("origin", origin(F.col("table"), F.col("_b").isNotNull())).drop("_b")


def data_files(df: DataFrame, table: str) -> DataFrame:
    """``(table, path, bytes, rows)`` per file of a file-backed DataFrame."""
    return (
        df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(table).alias("table"), "path", "bytes", "rows")
    )


def table_counts(origins: DataFrame) -> DataFrame:
    """Live, base and agent tables; internal ones are not shown."""
    visible = origins.filter(~F.col("table").isin(*INTERNAL_TABLES) & ~F.startswith("table", F.lit(".inner")))
    return visible.agg(
        F.count(F.lit(1)).alias("tables_live"),
        F.count_if(F.col("origin") == "base").alias("base_tables"),
        F.count_if(F.col("origin") != "base").alias("agent_tables"),
    )


def with_total(storage: DataFrame) -> DataFrame:
    """Storage per table and one row over all, without a table or an origin."""
    whole = storage.agg(*[F.sum(c).alias(c) for c in ("bytes", "rows", "files")])
    return storage.unionByName(whole, allowMissingColumns=True)


def oldest_data(tables: DataFrame, now: Column) -> DataFrame:
    """``(table, oldest, age_days)`` from ``(table, ts)`` rows: how far back each table's data goes."""
    oldest = tables.groupBy("table").agg(F.min("ts").alias("oldest"))
    return oldest.withColumn("age_days", F.datediff(now, F.col("oldest")))


def advisor_evidence(storage: DataFrame, reads: DataFrame, measure: str = "bytes") -> DataFrame:
    """Storage with each table's share of the measure and how often it was read."""
    shared = share_of_total(storage, measure)
    return shared.join(reads, "table", "left").fillna({"reads_24h": 0, "reads_30d": 0})


def latest_suggestions(suggestions: DataFrame, n: int = MAX_SUGGESTIONS) -> DataFrame:
    """The newest scan's suggestions by severity; a tie in scan time resolves to the greatest scan id."""
    newest = suggestions.agg(F.max(F.struct("scanned_at", "scan_id")).alias("m")).select(F.col("m.scan_id").alias("scan_id"))
    return (
        suggestions.join(newest, "scan_id", "left_semi")
        .orderBy(severity_rank(F.col("severity")), "id")
        .limit(n)
    )


def audit_statements(df: DataFrame, statement: str = "statement") -> DataFrame:
    """Flag logged statements that are empty, several at once, of no permitted form, or use a forbidden keyword."""
    sql = F.trim(F.regexp_replace(F.trim(F.col(statement)), r";+\s*$", ""))
    allowed = F.lit(False)
    for form in ALLOWED_STATEMENTS:
        allowed = allowed | sql.rlike(f"(?i){form}")
    problem = (
        F.when(sql == "", "empty")
        .when(F.contains(sql, F.lit(";")), "several statements")
        .when(~allowed, "form not permitted")
        .when(sql.rlike(f"(?i){FORBIDDEN_WORDS}"), "forbidden keyword")
    )
    return df.withColumn("problem", problem).withColumn("safe", F.col("problem").isNull())
