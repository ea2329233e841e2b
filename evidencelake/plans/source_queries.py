"""Event intake and profiling. Raw lines are built from the driver tables: one JSON object per event or order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators import profiling
from evidencelake.plans.registry import Tables, query
from evidencelake.session import fresh_path
from evidencelake.sources import ndjson, tables


def raw_lines(t: Tables) -> DataFrame:
    """Text lines as a capture would hold them: nested values, blanks, malformed lines, missing discriminators."""
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    event = F.when(i % 40 == 0, "").otherwise(F.concat(F.lit('"event":"'), F.col("event_type"), F.lit('",')))
    body = F.concat(
        F.lit("{"), event, F.lit('"id":"'), F.md5(s(i)), F.lit('","timestamp":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit('","user_id":"u'), s(F.col("user_id")), F.lit('","amount":'), s(F.col("value")), F.lit(',"ok":'),
        F.when(i % 2 == 0, "true").otherwise("false"), F.lit(',"os":'), F.when(i % 3 == 0, "null").when(i % 3 == 1, '""').otherwise('"iOS"'),
        F.lit(',"device_type":"'), F.when(i % 4 == 0, "web").otherwise("ios"), F.lit('","payment":{"amount":'), s(i % 300), F.lit(',"currency":"INR"},"payment_amount":'),
        s(i % 7), F.lit("}"),
    )
    value = F.when(i % 101 == 0, "   ").when(i % 103 == 0, F.concat(F.lit("{broken "), s(i))).otherwise(body)
    # a small file makes few tasks, and a line costs far more than the row it is made of
    events = t.events.repartition("event_id", "ts")
    return events.select(F.concat(F.lit("file_"), s(i % 5)).alias("file"), value.alias("value"), "event_id")


LINES = """
base AS (SELECT *, event_id % 101 = 0 AS blank, event_id % 101 != 0 AND event_id % 103 = 0 AS bad, CASE WHEN event_id % 40 = 0 THEN 'unknown_event' ELSE event_type END AS event FROM events),
good AS (SELECT * FROM base WHERE NOT blank AND NOT bad)
"""


def good_events(t: Tables) -> DataFrame:
    return ndjson.flatten_events(ndjson.parse_lines(raw_lines(t), "skip"))


@query("SRC1 SRC4", f"WITH {LINES} SELECT event, count(*) AS rows_n FROM good GROUP BY 1")
def lenient_intake(t: Tables) -> DataFrame:
    """Rows per event type with blank and malformed lines skipped."""
    return tables.split_by_event(ndjson.parse_lines(raw_lines(t), "skip"))


@query("SRC2 SRC4", f"WITH {LINES} SELECT event, count(*) AS rows_n FROM good GROUP BY 1")
def strict_intake(t: Tables) -> DataFrame:
    """The same through the failing mode, over the lines that are well formed."""
    lines = raw_lines(t).filter(~F.startswith("value", F.lit("{broken")))
    return tables.split_by_event(ndjson.parse_lines(lines, "fail"))


@query("SRC3", f"""
WITH {LINES}
SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS id, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS ok, CAST(event_id % 300 AS VARCHAR) AS payment_amount,
 'INR' AS payment_currency, CAST(event_id % 7 AS VARCHAR) AS payment_amount__2, CAST(9 AS INTEGER) AS fields_n FROM good""")
def flattened_fields(t: Tables) -> DataFrame:
    """One level flattened, booleans as 0/1, a name collision suffixed."""
    f = lambda name: F.try_variant_get(F.element_at("fields", F.lit(name)), "$", "string").alias(name)
    e = good_events(t)
    return e.select("event_id", f("id"), f("ok"), f("payment_amount"), f("payment_currency"), f("payment_amount__2"), (F.size("fields") - 1).alias("fields_n"))


@query("SRC5", f"""
WITH {LINES} SELECT 'file_' || (event_id % 5) AS file, count(*) AS events_n, count(DISTINCT CASE WHEN NOT bad THEN CASE WHEN event_id % 40 = 0 THEN '' ELSE event_type END END) AS event_types_n
FROM base WHERE NOT blank GROUP BY 1""")
def source_facts(t: Tables) -> DataFrame:
    """Rows and event types per file; bad lines are rows but no type."""
    return ndjson.source_facts(ndjson.parse_lines(raw_lines(t), "keep"))


TYPED = [("id", "string"), ("timestamp", "timestamp"), ("amount", "decimal(18,2)"), ("ok", "smallint"), ("payment_amount", "int"), ("os", "string")]


@query("SRC6", f"""
WITH {LINES} SELECT md5(CAST(event_id AS VARCHAR)) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_time, round(value, 2) AS amount, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS ok,
 CAST(event_id % 300 AS INTEGER) AS payment_amount, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'iOS' END AS os FROM good WHERE event = 'purchase'""")
def typed_load(t: Tables) -> DataFrame:
    """Typed rows of one event type."""
    rows = tables.load_events(good_events(t), "purchase", TYPED)
    return rows.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at_time"), F.col("amount").cast("double").alias("amount"), "ok", "payment_amount", "os")


@query("SRC7", f"""
WITH {LINES}, s AS (SELECT event, count(*) AS a FROM good GROUP BY 1), l AS (SELECT event, count(*) AS b FROM good WHERE event != 'view' AND value > 1 GROUP BY 1)
SELECT coalesce(s.event, l.event) AS event, coalesce(a, 0) AS source_rows, coalesce(b, 0) AS table_rows, coalesce(a, 0) = coalesce(b, 0) AS matches FROM s FULL JOIN l ON s.event = l.event""")
def count_verification(t: Tables) -> DataFrame:
    """Source against loaded rows per event, one event missing and one short."""
    e = ndjson.parse_lines(raw_lines(t), "skip")
    amount = F.try_variant_get(F.element_at("record", F.lit("amount")), "$", "double")
    return tables.verify_counts(e, e.filter((F.col("event") != "view") & (amount > 1)))


@query("SRC9", """SELECT event_type, count(*) AS rows_n FROM events WHERE ts >= TIMESTAMP '2024-04-15' - INTERVAL 90 DAYS GROUP BY 1""")
def retention(t: Tables) -> DataFrame:
    """Rows still within the run log's retention at a given time."""
    kept = tables.expire(t.events, "ts", tables.RETENTION["runs_log"], F.lit("2024-04-15").cast("timestamp_ntz"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_n"))


PROFILE_SQL = f"""
{LINES},
cells AS (SELECT event, 'id' AS field, 'string' AS ty, md5(CAST(event_id AS VARCHAR)) AS v, NULL::DOUBLE AS num FROM good
 UNION ALL SELECT event, 'timestamp', 'timestamp', strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL FROM good
 UNION ALL SELECT event, 'user_id', 'string', 'u' || user_id, NULL FROM good
 UNION ALL SELECT event, 'amount', 'number', regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''), value FROM good
 UNION ALL SELECT event, 'ok', 'number', CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END FROM good
 UNION ALL SELECT event, 'os', 'string', CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'iOS' END, NULL FROM good
 UNION ALL SELECT event, 'device_type', 'string', CASE WHEN event_id % 4 = 0 THEN 'web' ELSE 'ios' END, NULL FROM good
 UNION ALL SELECT event, 'payment_amount', 'number', CAST(event_id % 300 AS VARCHAR), event_id % 300 FROM good
 UNION ALL SELECT event, 'payment_currency', 'string', 'INR', NULL FROM good
 UNION ALL SELECT event, 'payment_amount__2', 'number', CAST(event_id % 7 AS VARCHAR), event_id % 7 FROM good),
prof AS (SELECT event, field, CASE WHEN count(*) FILTER (WHERE v != '') = 0 THEN 'string' ELSE any_value(ty) END AS inferred_type,
 floor(CAST(count(*) FILTER (WHERE v IS NULL OR v = '') AS DOUBLE) / count(*) * 1000 + 0.5) / 1000 AS null_rate,
 count(DISTINCT coalesce(v, '__null__')) AS distinct_n, count(*) FILTER (WHERE v != '') AS present_n, count(*) FILTER (WHERE v != '' AND num != floor(num)) AS fraction_n,
 count(*) FILTER (WHERE regexp_matches(v, '^[0-9a-f]{{32}}$')) AS hex_n, count(*) AS rows_n,
 max(length(v)) FILTER (WHERE v != '') AS longest, min(num) AS lo, max(num) AS hi FROM cells GROUP BY 1, 2)
"""


@query("PRO1 PRO2 PRO3 PRO4 PRO6 PRO7 PRO8", f"""
WITH {PROFILE_SQL} SELECT event, field, inferred_type, null_rate, CAST(distinct_n AS BIGINT) AS distinct_n, present_n, fraction_n, hex_n, rows_n,
 CAST(CASE WHEN inferred_type IN ('string', 'timestamp') THEN coalesce(longest, 0) END AS INTEGER) AS max_length, lo AS min_value, hi AS max_value FROM prof""")
def field_profile(t: Tables) -> DataFrame:
    """The whole profile of every event type."""
    return profiling.profile_events(good_events(t)).drop("samples", "position")


@query("PRO8 PRO5", f"""
WITH {PROFILE_SQL}, d AS (SELECT DISTINCT event, field, v FROM cells WHERE v != ''),
least AS (SELECT event, field, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event, field ORDER BY v) <= 5) GROUP BY 1, 2)
SELECT event, field, inferred_type, null_rate, CAST(distinct_n AS BIGINT) AS distinct_n, present_n, fraction_n, hex_n, rows_n, coalesce(samples, '') AS samples,
 CAST(CASE WHEN inferred_type IN ('string', 'timestamp') THEN coalesce(longest, 0) END AS INTEGER) AS max_length, lo AS min_value, hi AS max_value FROM prof LEFT JOIN least USING (event, field)""")
def incremental_profile(t: Tables) -> DataFrame:
    """The profile of five files from the states of each: three saved together, two that came later saved alone, the last of them twice."""
    folder, events = fresh_path(t.spark, "profile"), good_events(t)
    for files in (("file_0", "file_1", "file_2"), ("file_3",), ("file_4",), ("file_4",)):
        profiling.save_profile_states(events.filter(F.col("file").isin(*files)), folder)
    p = profiling.read_profile(t.spark, folder).drop("position")
    return p.withColumn("samples", F.array_join("samples", "|"))


@query("PRO5", f"""
WITH {PROFILE_SQL}, d AS (SELECT DISTINCT event, field, v FROM cells WHERE v != '')
SELECT event, field, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event, field ORDER BY v) <= 5) GROUP BY 1, 2""")
def sample_values(t: Tables) -> DataFrame:
    """The five smallest different values of every field."""
    p = profiling.profile_events(good_events(t)).filter(F.size("samples") > 0)
    return p.select("event", "field", F.array_join("samples", "|").alias("samples"))


@query("PRO8", """
WITH good AS (SELECT *, 'file_' || (event_id % 5) AS file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events WHERE event_id % 101 != 0 AND event_id % 103 != 0),
v AS (SELECT file, unnest([
  {'f': 'event', 'ty': 'string', 'v': CASE WHEN event_id % 40 = 0 THEN NULL ELSE event_type END, 'here': event_id % 40 != 0}, {'f': 'id', 'ty': 'string', 'v': md5(event_id::VARCHAR), 'here': true},
  {'f': 'timestamp', 'ty': 'timestamp', 'v': moment, 'here': true}, {'f': 'user_id', 'ty': 'string', 'v': 'u' || user_id, 'here': true}, {'f': 'amount', 'ty': 'number', 'v': value::VARCHAR, 'here': true},
  {'f': 'ok', 'ty': 'boolean', 'v': (event_id % 2 = 0)::VARCHAR, 'here': true}, {'f': 'os', 'ty': 'string', 'v': CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'iOS' END, 'here': true},
  {'f': 'device_type', 'ty': 'string', 'v': CASE WHEN event_id % 4 = 0 THEN 'web' ELSE 'ios' END, 'here': true}, {'f': 'payment', 'ty': 'json', 'v': (event_id % 300)::VARCHAR, 'here': true},
  {'f': 'payment_amount', 'ty': 'number', 'v': (event_id % 7)::VARCHAR, 'here': true}]) AS c FROM good),
n AS (SELECT file, count(*) AS rows_n FROM good GROUP BY 1)
SELECT file, c.f AS field, n.rows_n, count(DISTINCT coalesce(c.v, '__null__')) AS distinct_n, any_value(c.ty) AS inferred_type FROM v JOIN n USING (file) WHERE c.here GROUP BY file, c.f, n.rows_n""")
def raw_profile_by_file(t: Tables) -> DataFrame:
    """Profile per file before flattening, where booleans are still booleans."""
    p = profiling.profile_events(ndjson.parse_lines(raw_lines(t), "skip"), by="file", fields="record")
    return p.select("file", "field", "rows_n", "distinct_n", "inferred_type")


@query("PRO9", f"""
WITH {PROFILE_SQL} SELECT event, field FROM prof WHERE field NOT IN ('id', 'timestamp', 'user_id', 'os', 'device_type')""")
def new_fields(t: Tables) -> DataFrame:
    """Fields the envelope does not know."""
    return profiling.new_fields(profiling.profile_events(good_events(t)))


@query("PRO10", f"""
WITH {PROFILE_SQL}
SELECT event, field, CASE WHEN field = 'timestamp' THEN 'DateTime64(3)' WHEN field IN ('amount', 'payment_amount', 'payment_amount__2') THEN 'Decimal64(2)' WHEN field = 'ok' THEN 'UInt8' WHEN field = 'id' THEN 'FixedString(32)'
  WHEN field = 'user_id' THEN 'String' WHEN null_rate > 0 THEN 'LowCardinality(String) DEFAULT ''''' ELSE 'LowCardinality(String)' END AS source_type,
 CASE WHEN field = 'timestamp' THEN 'timestamp' WHEN field IN ('amount', 'payment_amount', 'payment_amount__2') THEN 'decimal(18,2)' WHEN field = 'ok' THEN 'smallint' ELSE 'string' END AS spark_type FROM prof""")
def type_advice(t: Tables) -> DataFrame:
    """The narrowest type of every field."""
    p = profiling.recommend_types(profiling.profile_events(good_events(t)))
    return p.select("event", "field", "source_type", "spark_type")


@query("PRO11", f"""
WITH {PROFILE_SQL} SELECT event, 'device_type,user_id,timestamp' AS order_by, 'month(timestamp)' AS partition_by,
 'device_type (' || distinct_n || ' values) comes first to skip data; user_id joins and is never empty; timestamp narrows time ranges' AS reason FROM prof WHERE field = 'device_type'""")
def layout_advice(t: Tables) -> DataFrame:
    """Sort key and partitioning of every event table."""
    p = profiling.recommend_layout(profiling.profile_events(good_events(t)))
    return p.withColumn("order_by", F.array_join("order_by", ","))


@query("PRO12", f"""
WITH {PROFILE_SQL} SELECT event, field, CASE field WHEN 'timestamp' THEN 'when it happened, to the millisecond' WHEN 'id' THEN 'an identifier, nearly unique' WHEN 'user_id' THEN 'an identifier, nearly unique'
 WHEN 'os' THEN distinct_n || ' different values; ' || printf('%.1f', null_rate * 100) || '% are empty: count them as ''unknown'''
 WHEN 'payment_currency' THEN distinct_n || ' different values; amounts of different currencies do not add up' WHEN 'device_type' THEN distinct_n || ' different values'
 ELSE 'range ' || regexp_replace(CAST(lo AS VARCHAR), '\\.0$', '') || '–' || regexp_replace(CAST(hi AS VARCHAR), '\\.0$', '') END AS note FROM prof""")
def column_notes(t: Tables) -> DataFrame:
    """What a reader must know about each column."""
    return profiling.column_notes(profiling.recommend_types(profiling.profile_events(good_events(t))))


@query("PRO12", f"""
WITH {LINES}, e AS (SELECT DISTINCT event FROM good)
SELECT event, unnest(['blanks occur in os: report them as ''unknown'', they are no group of their own', 'without duplicate_id and is_back_filled there is nothing for the hygiene rules to filter',
 'without app_session_id it has no sessions: use the join key', 'amounts come in several currencies: group by currency first']) AS gotcha FROM e""")
def table_gotchas(t: Tables) -> DataFrame:
    """What to beware of in each event table."""
    return profiling.table_gotchas(profiling.recommend_types(profiling.profile_events(good_events(t))))


@query("PRO13", f"""
WITH {PROFILE_SQL}, d AS (SELECT DISTINCT event_type AS event, unnest(['id', 'timestamp', 'ghost']) AS field FROM events)
SELECT event, field, 'missing' AS status FROM prof p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.event = p.event AND d.field = p.field)
UNION ALL SELECT event, field, 'invented' FROM d WHERE NOT EXISTS (SELECT 1 FROM prof p WHERE d.event = p.event AND d.field = p.field)""")
def schema_coverage(t: Tables) -> DataFrame:
    """Measured fields a table lacks and declared ones never measured."""
    declared = t.events.select(F.col("event_type").alias("event")).distinct().withColumn("field", F.explode(F.array(*[F.lit(x) for x in ("id", "timestamp", "ghost")])))
    return profiling.schema_coverage(profiling.profile_events(good_events(t)), declared)


@query("PRO14", """
WITH v AS (SELECT event_type, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) * 97 + 256 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events),
m AS (SELECT event_type, CASE WHEN min(k) < 0 OR max(k) >= 4294967296 THEN 'bigint' WHEN max(k) < 256 THEN 'smallint' WHEN max(k) < 65536 THEN 'int' ELSE 'bigint' END AS ty FROM v GROUP BY 1)
SELECT 'k' AS field, count(DISTINCT ty) AS types_n, string_agg(DISTINCT ty, ',' ORDER BY ty) AS types FROM m HAVING count(DISTINCT ty) > 1""")
def type_conflicts(t: Tables) -> DataFrame:
    """A field that gets two types in different events: clicks carry it a thousandfold."""
    k = F.get_json_object("props", "$.k").cast("int")
    scaled = F.when(F.col("event_type") == "click", k * 97 + 256).otherwise(k)
    line = F.concat(F.lit('{"event":"'), "event_type", F.lit('","k":'), scaled.cast("string"), F.lit(',"j":"x"}'))
    typed = profiling.recommend_types(profiling.profile_events(ndjson.flatten_events(ndjson.parse_lines(t.events.select(line.alias("value"))))))
    return profiling.type_conflicts(typed).withColumn("types", F.array_join("types", ","))
