"""Query log, run and conversation analytics over logs derived from ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.text import query_shape, truncate
from evidencelake.operators import conversations, querylog, runs
from evidencelake.operators.knowledge import origin
from evidencelake.plans.registry import Tables, query
from evidencelake.plans.store_queries import RUNS, runs_log

APP = "evidencelake"

LOG = """
log AS (SELECT CASE WHEN event_type = 'error' THEN 'ExceptionWhileProcessing' ELSE 'QueryFinish' END AS type, ts AS event_time, event_id AS query_id, CAST(floor(value * 10) AS BIGINT) AS ms,
 event_id % 1000 AS read_rows, event_id % 1700 AS written_rows, event_type AS query_kind, 'SELECT  ' || repeat('a_long_column_name, ', 20) || '* FROM t_' || (event_id % 7) || ' WHERE user_id = ' || user_id || ' AND s = ''' || event_type || ''' AND k IN (1, 2, ' || (event_id % 50) || ')' AS query,
 CASE WHEN event_id % 11 = 0 THEN ['other'] ELSE ['db', 'other'] END AS databases, ['db.t_' || (event_id % 7), 'other.z'] AS tables,
 '{"app":"' || CASE WHEN event_id % 5 = 0 THEN 'foreign' ELSE 'evidencelake' END || '","agent":"' || CASE WHEN event_id % 13 = 0 THEN 'observe' ELSE 'analytics' END || '","run":"r' || user_id || '"}' AS log_comment FROM events),
mx AS (SELECT max(ts) AS now FROM events),
scoped AS (SELECT * FROM log, mx WHERE type = 'QueryFinish' AND event_time >= now - INTERVAL 24 HOURS AND list_contains(databases, 'db') AND json_extract_string(log_comment, '$.agent') != 'observe'),
scoped_all AS (SELECT * FROM log, mx WHERE type = 'QueryFinish' AND event_time >= now - INTERVAL 720 HOURS AND list_contains(databases, 'db') AND json_extract_string(log_comment, '$.agent') != 'observe')
"""
SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '''(?:[^''\\]|\\.|'''')*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g'), '\?(?:\s*,\s*\?)+', '?..', 'g'), '\s+', ' ', 'g')"


def query_log(t: Tables) -> DataFrame:
    i, k, s = F.col("event_id"), F.col("event_type"), (lambda c: c.cast("string"))
    sql = F.concat(
        F.lit("SELECT  " + "a_long_column_name, " * 20 + "* FROM t_"), s(i % 7), F.lit(" WHERE user_id = "), s(F.col("user_id")), F.lit(" AND s = '"), k, F.lit("' AND k IN (1, 2, "), s(i % 50), F.lit(")")
    )
    comment = F.concat(
        F.lit('{"app":"'), F.when(i % 5 == 0, "foreign").otherwise(APP), F.lit('","agent":"'), F.when(i % 13 == 0, "observe").otherwise("analytics"),
        F.lit('","run":"r'), s(F.col("user_id")), F.lit('"}'),
    )
    return t.events.select(
        F.when(k == "error", "ExceptionWhileProcessing").otherwise("QueryFinish").alias("type"), F.col("ts").alias("event_time"), i.alias("query_id"),
        F.floor(F.col("value") * 10).alias("query_duration_ms"), (i % 1000).alias("read_rows"), (i % 1700).alias("written_rows"), k.alias("query_kind"),
        sql.alias("query"), F.when(i % 11 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("db"), F.lit("other"))).alias("databases"),
        F.array(F.concat(F.lit("db.t_"), s(i % 7)), F.lit("other.z")).alias("tables"), comment.alias("log_comment"),
    )


def now(t: Tables) -> Column:
    """The log's own last instant, as a scalar subquery."""
    return t.events.agg(F.max("ts")).scalar()


def day_log(t: Tables) -> DataFrame:
    return querylog.in_scope(query_log(t), "db", now(t))


@query("QRY1 HYG13", f"WITH {LOG} SELECT query_kind, count(*) AS queries_n FROM scoped GROUP BY 1")
def scoped_queries(t: Tables) -> DataFrame:
    """Queries of the window that count."""
    return day_log(t).groupBy("query_kind").agg(F.count(F.lit(1)).alias("queries_n"))


WINDOW_SQL = f"""
{LOG}, w AS (SELECT *, CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS h, {SHAPE} AS shape FROM scoped_all),
g AS (SELECT CASE WHEN grouping(h) = 1 AND grouping(shape) = 1 THEN 'total' WHEN grouping(h) = 0 THEN 'hour' ELSE 'shape' END AS grouping, h AS hour_ts, shape, count(*) AS queries,
  round_even(round(quantile_cont(ms, 0.95), 6), 0) AS p95_ms, CAST(sum(read_rows) AS BIGINT) AS rows_read, max(ms) AS max_ms, max(greatest(read_rows, written_rows)) AS max_rows,
  arg_max(query_kind, (ms, event_time, query_id)) AS top_kind, arg_max(greatest(read_rows, written_rows), (ms, event_time, query_id)) AS top_rows FROM w GROUP BY GROUPING SETS ((), (h), (shape)))
"""


@query("QRY2 AGG12 AGG6 AGG7", f"WITH {WINDOW_SQL} SELECT grouping, hour_ts, shape, queries, p95_ms, rows_read, max_ms, max_rows, top_kind, top_rows FROM g")
def window_statistics(t: Tables) -> DataFrame:
    """Totals, hours and shapes of thirty days from one scan."""
    scoped = querylog.in_scope(query_log(t), "db", now(t), querylog.READS_HOURS)
    return querylog.window_stats(scoped).drop("top_log_comment")


@query("QRY2 TOP2", f"""
WITH {WINDOW_SQL} SELECT grouping, hour_ts, shape, queries, max_ms FROM g QUALIFY row_number() OVER (PARTITION BY grouping ORDER BY max_ms DESC, hour_ts NULLS LAST, shape NULLS LAST) <= 26""")
def window_capped(t: Tables) -> DataFrame:
    """The same with each grouping capped on its own."""
    scoped = querylog.in_scope(query_log(t), "db", now(t), querylog.READS_HOURS)
    return querylog.capped_window(querylog.window_stats(scoped)).select("grouping", "hour_ts", "shape", "queries", "max_ms")


@query("QRY3", f"WITH {LOG} SELECT {SHAPE} AS shape, count(*) AS runs FROM log GROUP BY 1")
def query_shapes(t: Tables) -> DataFrame:
    """Queries folded to their shapes."""
    return query_log(t).groupBy(query_shape(F.col("query")).alias("shape")).agg(F.count(F.lit(1)).alias("runs"))


@query("QRY3", r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS f FROM conversations) SELECT conv_id, turn, CASE WHEN length(f) > 240 THEN substr(f, 1, 240) || '…' ELSE f END AS shown FROM c""")
def truncated_texts(t: Tables) -> DataFrame:
    """Collapsed texts, cut for display with an ellipsis."""
    return t.conversations.select("conv_id", "turn", truncate(F.col("text")).alias("shown"))


@query("QRY4", f"""
WITH {LOG}, p AS (SELECT CASE WHEN json_extract_string(log_comment, '$.app') = 'evidencelake' THEN json_extract_string(log_comment, '$.agent') END AS agent, CASE WHEN json_extract_string(log_comment, '$.app') = 'evidencelake' THEN json_extract_string(log_comment, '$.run') END AS run FROM log)
SELECT agent, run, count(*) AS queries_n FROM p GROUP BY 1, 2""")
def attribution(t: Tables) -> DataFrame:
    """Who ran what, by our own comments; foreign ones are unattributed."""
    a = query_log(t).select(querylog.attribution(F.col("log_comment"), APP).alias("a"))
    return a.groupBy(F.col("a.agent").alias("agent"), F.col("a.run").alias("run")).agg(F.count(F.lit(1)).alias("queries_n"))


SERIES_SQL = f"""
{LOG}, hr AS (SELECT CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS h, count(*) AS q, round_even(round(quantile_cont(ms, 0.95), 6), 0) AS p, arg_max(query_kind, (ms, event_time, query_id)) AS k,
  arg_max(greatest(read_rows, written_rows), (ms, event_time, query_id)) AS r, arg_max(log_comment, (ms, event_time, query_id)) AS lc FROM scoped_all GROUP BY 1),
sp AS (SELECT unnest(range(CAST(epoch(date_trunc('hour', now)) AS BIGINT) - 719 * 3600, CAST(epoch(date_trunc('hour', now)) AS BIGINT) + 1, 3600)) AS hour_ts FROM mx),
ds AS (SELECT hour_ts, coalesce(p, 0) AS p95_ms, coalesce(q, 0) AS queries, k, r, lc FROM sp LEFT JOIN hr ON h = hour_ts),
md AS (SELECT list_sort(list(p95_ms) FILTER (WHERE queries > 0))[count(*) FILTER (WHERE queries > 0) // 2 + 1] AS m FROM ds)
"""


@query("QRY5 JON8", f"WITH {SERIES_SQL} SELECT hour_ts, p95_ms, queries, m > 0 AND queries > 0 AND p95_ms >= greatest(m * 2, 100) AS is_spike FROM ds, md")
def dense_hourly_p95(t: Tables) -> DataFrame:
    """Hourly p95 with no hour missing, spikes marked."""
    return series(t).select("hour_ts", "p95_ms", "queries", "is_spike")


def series(t: Tables) -> DataFrame:
    scoped = querylog.in_scope(query_log(t), "db", now(t), querylog.READS_HOURS)
    hours = querylog.window_stats(scoped).filter("grouping = 'hour'")
    return querylog.latency_series(hours, F.unix_timestamp(now(t)), querylog.READS_HOURS, APP)


@query("QRY5", f"""
WITH {SERIES_SQL} SELECT hour_ts, CASE WHEN json_extract_string(lc, '$.app') = 'evidencelake' THEN json_extract_string(lc, '$.agent') || ' ' ELSE '' END || lower(k) || CASE WHEN r > 0 THEN ' (' || format('{{:,}}', r) || ' rows)' ELSE '' END AS spike_cause
FROM ds, md WHERE m > 0 AND queries > 0 AND p95_ms >= greatest(m * 2, 100)""")
def latency_spikes(t: Tables) -> DataFrame:
    """The spikes with their cause."""
    return series(t).filter("is_spike").select("hour_ts", "spike_cause")


@query("QRY6 TOP6", f"WITH {WINDOW_SQL} SELECT shape, queries, max_ms FROM g WHERE grouping = 'shape' ORDER BY max_ms DESC, shape LIMIT 5")
def slowest_shapes(t: Tables) -> DataFrame:
    """The five slowest query shapes."""
    scoped = querylog.in_scope(query_log(t), "db", now(t), querylog.READS_HOURS)
    return querylog.slowest_shapes(querylog.window_stats(scoped)).select("shape", "queries", "max_ms")


@query("QRY6 TOP6", f"WITH {LOG} SELECT query_id, query_kind FROM scoped ORDER BY event_time DESC, query_id LIMIT 20")
def recent_queries(t: Tables) -> DataFrame:
    """The twenty most recent queries."""
    return querylog.recent_queries(day_log(t)).select("query_id", "query_kind")


@query("TOP5 QRY10", f"""
WITH {LOG}, s AS (SELECT {SHAPE} AS shape, count(*) AS runs, max(ms) AS max_ms, round_even(round(CAST(sum(ms) AS DOUBLE) / count(*), 6), 0) AS avg_ms, CAST(sum(read_rows) AS BIGINT) AS rows_read FROM scoped_all GROUP BY 1)
SELECT shape, runs, max_ms, avg_ms, rows_read FROM s ORDER BY runs * avg_ms DESC, shape LIMIT 8""")
def costliest_shapes(t: Tables) -> DataFrame:
    """The eight shapes that cost most in total."""
    return querylog.costliest_shapes(querylog.in_scope(query_log(t), "db", now(t), querylog.READS_HOURS))


@query("QRY9", f"""
WITH {LOG}, e AS (SELECT unnest(tables) AS q, event_time, now FROM scoped_all)
SELECT CASE WHEN starts_with(q, 'db.') THEN substr(q, 4) ELSE q END AS "table", CAST(count(*) FILTER (WHERE event_time >= now - INTERVAL 24 HOURS) AS BIGINT) AS reads_24h, count(*) AS reads_30d FROM e GROUP BY 1""")
def reads_per_table(t: Tables) -> DataFrame:
    """Reads per table over a day and a month."""
    return querylog.reads_per_table(query_log(t), "db", now(t))


def storage(t: Tables) -> DataFrame:
    """Real storage of the driver tables, from file metadata."""
    names = ("orders", "lineitem", "customer", "events", "documents", "conversations")
    files = [querylog.data_files(getattr(t, n), n) for n in names]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    base = t.region.filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "orders").otherwise("lineitem").alias("table"))
    return querylog.table_storage(out, base)


STORAGE_SQL = """
st AS (SELECT 'orders' AS t, count(*) AS rows, 'base' AS o FROM orders UNION ALL SELECT 'lineitem', count(*), 'base' FROM lineitem UNION ALL SELECT 'customer', count(*), 'agent' FROM customer
 UNION ALL SELECT 'events', count(*), 'agent' FROM events UNION ALL SELECT 'documents', count(*), 'agent' FROM documents UNION ALL SELECT 'conversations', count(*), 'internal' FROM conversations)
"""


@query("QRY7", f"""
WITH {STORAGE_SQL}, e AS (SELECT t AS "table", rows, o AS origin FROM st UNION ALL SELECT NULL, sum(rows)::BIGINT, NULL FROM st) SELECT *, true AS has_bytes FROM e""")
def table_storage(t: Tables) -> DataFrame:
    """Rows per table and over all (no table name), each with bytes in files."""
    return querylog.with_total(storage(t)).select("table", "rows", "origin", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("has_bytes"))


@query("QRY8", """
WITH v AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN '.inner.' || p_partkey ELSE 'part_' || p_partkey END AS tbl, p_size <= 20 AS base FROM part)
SELECT count(*) AS tables_live, count(*) FILTER (base) AS base_tables, count(*) FILTER (NOT base) AS agent_tables FROM v WHERE NOT starts_with(tbl, '.inner')""")
def table_counts(t: Tables) -> DataFrame:
    """Live, base and agent tables of a catalog with a table per part; internal ones are not counted."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 50 == 0, ".inner.").otherwise("part_"), k.cast("string"))
    return querylog.table_counts(t.part.select(name.alias("table"), F.when(F.col("p_size") <= 20, "base").otherwise("agent").alias("origin")))


@query("QRY10 AGG15", f"""
WITH {STORAGE_SQL}, {LOG}, r AS (SELECT ['orders', 'events', 'customer'][query_id % 3 + 1] AS t, count(*) FILTER (event_time >= now - INTERVAL 24 HOURS) AS r24, count(*) AS r30 FROM scoped_all GROUP BY 1)
SELECT st.t AS "table", st.rows, st.o AS origin, floor(st.rows::DOUBLE / (SELECT sum(rows) FROM st) * 1000 + 0.5) / 10 AS share_pct, coalesce(r24, 0) AS reads_24h, coalesce(r30, 0) AS reads_30d FROM st LEFT JOIN r ON r.t = st.t""")
def advisor_evidence(t: Tables) -> DataFrame:
    """Each table's share of the rows beside how often it was read; file sizes are known to Spark only."""
    reads = querylog.reads_per_table(query_log(t).withColumn("tables", F.array(F.concat(F.lit("db."), F.element_at(F.array(F.lit("orders"), F.lit("events"), F.lit("customer")), (F.col("query_id") % 3 + 1).cast("int"))))), "db", now(t))
    return querylog.advisor_evidence(storage(t).drop("bytes", "files"), reads, "rows")


@query("QRY10", """
WITH d AS (SELECT 'orders' AS t, min(o_orderdate)::TIMESTAMP AS oldest FROM orders UNION ALL SELECT 'lineitem', min(l_shipdate)::TIMESTAMP FROM lineitem UNION ALL SELECT 'events', min(ts) FROM events)
SELECT t AS "table", strftime(oldest, '%Y-%m-%d') AS oldest_day, date_diff('day', oldest::DATE, (SELECT max(ts)::DATE FROM events))::INTEGER AS age_days FROM d""")
def data_age(t: Tables) -> DataFrame:
    """How far back each table's data goes, seen from the newest event."""
    stamps = [df.select(F.lit(n).alias("table"), F.col(c).cast("timestamp_ntz").alias("ts")) for n, df, c in (("orders", t.orders, "o_orderdate"), ("lineitem", t.lineitem, "l_shipdate"), ("events", t.events, "ts"))]
    aged = querylog.oldest_data(stamps[0].unionByName(stamps[1]).unionByName(stamps[2]), now(t))
    return aged.select("table", F.date_format("oldest", "yyyy-MM-dd").alias("oldest_day"), "age_days")


@query("QRY11 TOP7 JON4", """
WITH s AS (SELECT user_id AS scan_id, event_id AS id, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'MED' ELSE 'LOW' END AS severity, date_trunc('hour', ts) AS scanned_at FROM events),
m AS (SELECT scan_id FROM s ORDER BY scanned_at DESC, scan_id DESC LIMIT 1)
SELECT id, severity FROM s WHERE scan_id = (SELECT scan_id FROM m) ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MED' THEN 1 ELSE 2 END, id LIMIT 20""")
def latest_suggestions(t: Tables) -> DataFrame:
    """The newest scan's suggestions by severity."""
    k = F.col("event_type")
    s = t.events.select(
        F.col("user_id").alias("scan_id"), F.col("event_id").alias("id"), F.when(k == "error", "HIGH").when(k == "click", "MED").otherwise("LOW").alias("severity"),
        F.date_trunc("hour", "ts").alias("scanned_at"),
    )
    return querylog.latest_suggestions(s).select("id", "severity")


@query("QRY12", """
WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ALTER TABLE t_' || user_id || ' MODIFY TTL ts + INTERVAL 1 DAY;' WHEN 1 THEN 'DROP TABLE t' WHEN 2 THEN 'OPTIMIZE TABLE a; DROP TABLE b' WHEN 3 THEN '  ; ' WHEN 4 THEN 'CREATE MATERIALIZED VIEW v AS SELECT 1 FROM system parts' ELSE 'optimize table t' || user_id END AS q, event_id % 6 AS m FROM events)
SELECT event_id, CASE m WHEN 1 THEN 'form not permitted' WHEN 2 THEN 'several statements' WHEN 3 THEN 'empty' WHEN 4 THEN 'forbidden keyword' END AS problem, m IN (0, 5) AS safe FROM s""")
def statement_audit(t: Tables) -> DataFrame:
    """Logged statements that are not of a permitted form."""
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 6
    q = (
        F.when(m == 0, F.concat(F.lit("ALTER TABLE t_"), u, F.lit(" MODIFY TTL ts + INTERVAL 1 DAY;"))).when(m == 1, "DROP TABLE t")
        .when(m == 2, "OPTIMIZE TABLE a; DROP TABLE b").when(m == 3, "  ; ").when(m == 4, "CREATE MATERIALIZED VIEW v AS SELECT 1 FROM system parts")
        .otherwise(F.concat(F.lit("optimize table t"), u))
    )
    return querylog.audit_statements(t.events.select("event_id", q.alias("statement"))).select("event_id", "problem", "safe")


@query("RUN1 SRC11", """
WITH u AS (SELECT user_id % 300 AS run_id, event_id AS finished, 's' || (event_id % 5) AS spec, event_id * 3 % 1000 AS started, event_type AS status FROM events),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY finished DESC) = 1) SELECT run_id, finished, spec, started, status FROM l ORDER BY started DESC, run_id LIMIT 200""")
def run_history(t: Tables) -> DataFrame:
    """Run history from upserted summaries."""
    i = F.col("event_id")
    s = t.events.select(
        (F.col("user_id") % 300).alias("run_id"), i.alias("finished"), F.concat(F.lit("s"), (i % 5).cast("string")).alias("spec"), (i * 3 % 1000).alias("started"),
        F.col("event_type").alias("status"), F.lit(1).alias("events"), F.lit(1).alias("duration_ms"),
    )
    return runs.run_history(s).select("run_id", "finished", "spec", "started", "status")


@query("RUN2 AGG9 AGG10", f"""
WITH {RUNS} SELECT run_id, min(spec) AS spec, count(*) AS events_n, arg_max(name, seq) FILTER (WHERE type = 'status') AS last_status, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms FROM runs GROUP BY 1
HAVING count(*) FILTER (WHERE type = 'status') > 0""")
def run_history_from_events(t: Tables) -> DataFrame:
    """Run history rebuilt from events."""
    log = runs_log(t)
    with_status = log.filter(F.col("type") == "status").select("run_id").distinct()
    h = runs.run_history_from_events(log.join(with_status, "run_id", "left_semi"))
    return h.select("run_id", "spec", "events_n", "last_status", "duration_ms")


PHASE = "CASE WHEN name = 'profile' THEN 'Profiling the events' WHEN name = 'context_load' THEN 'Reading the knowledge store' WHEN starts_with(name, 'dry_run') THEN 'Validating the schema' WHEN starts_with(name, 'ddl_execution_attempt') THEN 'Creating tables and loading data' ELSE '' END"


@query("RUN3", f"WITH {RUNS} SELECT {PHASE} AS phase, count(*) AS events_n FROM runs GROUP BY 1")
def step_phases(t: Tables) -> DataFrame:
    """Events per reader-facing phase."""
    log = runs_log(t).withColumn("phase", runs.phase_of(F.col("name"), runs.RUN_PHASES, ""))
    return log.groupBy("phase").agg(F.count(F.lit(1)).alias("events_n"))


@query("RUN4", f"""
WITH {RUNS}, s AS (SELECT run_id, name, ts, row_number() OVER (PARTITION BY run_id, name ORDER BY ts, seq) AS i FROM runs WHERE type = 'step_start'), e AS (SELECT run_id, name, ts, row_number() OVER (PARTITION BY run_id, name ORDER BY ts, seq) AS i FROM runs WHERE type IN ('step_end', 'step_error')),
j AS (SELECT s.run_id, {PHASE.replace('name', 's.name')} AS phase, CAST((epoch_us(e.ts) - epoch_us(s.ts)) AS BIGINT) AS us FROM s LEFT JOIN e USING (run_id, name, i))
SELECT run_id, phase, CAST(coalesce(sum(CASE WHEN us >= 0 THEN floor(us / 1000) ELSE ceil(us / 1000) END), 0) AS BIGINT) AS elapsed_ms, count(*) AS attempts_n FROM j WHERE phase != '' GROUP BY 1, 2""")
def phase_durations(t: Tables) -> DataFrame:
    """Wall time per run and phase, k-th start paired with k-th end."""
    return runs.phase_durations(runs_log(t))


CONV = """
conv AS (SELECT conv_id, turn AS updated_at, text AS title, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS starred, CASE WHEN conv_id % 9 = 0 AND turn > 1 THEN 1 ELSE 0 END AS deleted FROM conversations),
lst AS (SELECT * FROM conv QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY updated_at DESC, title DESC) = 1)
"""


@query("CNV1 JON7 AGG9", f"""
WITH {CONV}, r AS (SELECT * FROM lst WHERE deleted = 0 ORDER BY updated_at DESC, conv_id LIMIT 100), s AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) FILTER (WHERE role = 'user') AS p FROM conversations GROUP BY 1)
SELECT conv_id, title, CAST(starred AS INTEGER) AS starred, updated_at, coalesce(n, 0) AS messages, coalesce(p, '') AS preview FROM r LEFT JOIN s USING (conv_id)""")
def conversation_list(t: Tables) -> DataFrame:
    """The newest live conversations with counts and previews."""
    c, k = t.conversations, F.col("conv_id")
    upserts = c.select(
        "conv_id", F.col("turn").alias("updated_at"), F.col("text").alias("title"), F.when(k % 5 == 0, 1).otherwise(0).alias("starred"),
        F.when((k % 9 == 0) & (F.col("turn") > 1), 1).otherwise(0).alias("deleted"),
    )
    messages = c.select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("question"))
    return conversations.conversation_list(upserts, messages)


@query("CNV2", """SELECT turn AS seq, role, length(text) AS chars FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)""")
def conversation_turns(t: Tables) -> DataFrame:
    """One conversation in order."""
    messages = t.conversations.withColumnRenamed("turn", "seq")
    newest = t.conversations.agg(F.max("conv_id")).scalar()
    return conversations.turns(messages, newest).select("seq", "role", F.length("text").cast("long").alias("chars"))


@query("CNV3 HYG11", r"""
WITH q AS (SELECT conv_id, turn AS question_id, text, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3) AS terms FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn AS answer_id, text FROM conversations WHERE role != 'user' OR turn % 2 = 0),
m AS (SELECT q.conv_id, question_id, answer_id FROM q JOIN c ON q.conv_id = c.conv_id AND c.text != q.text AND len(list_filter(terms, lambda w: contains(lower(c.text), w))) > 0)
SELECT conv_id, question_id, answer_id FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, question_id ORDER BY answer_id DESC) <= 3""")
def related_answers(t: Tables) -> DataFrame:
    """Earlier texts of the same conversation that share a term, newest three."""
    c = t.conversations
    key = F.struct("conv_id", F.col("turn"))
    asked = c.filter("role = 'user'").select(key.alias("question_id"), "conv_id", F.col("text").alias("question"))
    stored = c.filter("role != 'user' OR turn % 2 = 0").select(F.col("turn").alias("answer_id"), "conv_id", F.col("text").alias("question"), F.col("turn").alias("created_at"))
    r = conversations.related_answers(asked, stored)
    return r.select("conv_id", F.col("question_id.turn").alias("question_id"), "answer_id")


@query("CNV4 TOP9", """
SELECT conv_id, turn AS seq, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4 THEN 'full' ELSE 'compressed' END AS detail
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12""")
def history_window(t: Tables) -> DataFrame:
    """The turns a next question would see."""
    return conversations.history(t.conversations.withColumnRenamed("turn", "seq")).select("conv_id", "seq", "recency", "detail")


@query("CNV4", f"WITH {LOG} SELECT query_id, lower(regexp_extract(query, 'FROM\\s+([a-z_0-9]+)', 1)) AS tables FROM log")
def mentioned_tables(t: Tables) -> DataFrame:
    """Tables each logged query mentions."""
    return query_log(t).select("query_id", F.array_join(conversations.mentioned_tables(F.col("query")), ",").alias("tables"))


@query("RUN2", f"WITH {RUNS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, type, count(*) AS events_n FROM runs GROUP BY 1, 2")
def run_events_by_day(t: Tables) -> DataFrame:
    """Run events as the log partitions them, per day and type."""
    log = runs_log(t)
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "type").agg(F.count(F.lit(1)).alias("events_n"))


@query("QRY2", f"WITH {LOG} SELECT CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_ts, count(*) AS queries, max(ms) AS max_ms FROM log GROUP BY 1")
def hourly_log_counts(t: Tables) -> DataFrame:
    """The batch form of the streaming hourly counts: the same plan reads a static log."""
    from evidencelake.streaming.intake import hourly_counts

    return hourly_counts(query_log(t).withColumn("event_time", F.col("event_time").cast("timestamp")))


@query("QRY8 KNO7", """SELECT source AS "table", CASE WHEN source IN ('src1', 'src2') THEN 'base' ELSE 'agent' END AS origin, count(*) AS docs_n FROM documents GROUP BY 1""")
def origin_by_name(t: Tables) -> DataFrame:
    """Origin of each source when two are known to be base."""
    s = F.col("source")
    return t.documents.groupBy(s.alias("table"), origin(s, s.isin("src1", "src2")).alias("origin")).agg(F.count(F.lit(1)).alias("docs_n"))
