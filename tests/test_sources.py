"""Intake, profiling, typed tables, documentation and streaming on small files."""

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import profiling
from evidencelake.plans.registry import Tables
from evidencelake.plans.source_queries import good_events
from evidencelake.sources import ndjson, tables, versions
from evidencelake.streaming.intake import sink_hourly_counts, staged_lines, stream_events, typed_rows

FIXTURE = """{"event":"otp_entered","id":"0123456789abcdef0123456789abcdef","timestamp":"2026-01-02T03:04:05.678Z","otp_success":true,"payment":{"amount":1502.5,"currency":"INR"},"os":""}
{"event":"otp_entered","id":"fedcba9876543210fedcba9876543210","timestamp":"2026-01-03 03:04","otp_success":false,"payment_amount":7,"payment":{"amount":1e3},"os":null}
{"event":"coupon_entered","coupon_code":"A","tags":["x","y"]}
{"note":"no discriminator"}

{malformed
"""


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    folder = tmp_path_factory.mktemp("capture")
    (folder / "events.ndjson").write_text(FIXTURE)
    return str(folder)


@pytest.fixture(scope="module")
def events(spark, capture):
    return ndjson.flatten_events(ndjson.read_ndjson(spark, capture))


def text_of(fields, name):
    return F.try_variant_get(F.element_at(fields, F.lit(name)), "$", "string")


def test_lenient_and_strict(spark, capture):
    assert ndjson.read_ndjson(spark, capture).count() == 4
    with pytest.raises(Exception, match="malformed line"):
        ndjson.read_ndjson(spark, capture, "fail").collect()
    facts = ndjson.source_facts(ndjson.read_ndjson(spark, capture, "keep")).first()
    assert (facts.events_n, facts.event_types_n) == (5, 3)


@pytest.mark.parametrize("line", ['{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "{'a':1}", '{"a":NaN}', '{"a":1', "[1]", "5", '{"a":01}'])
def test_malformed_lines(spark, line):
    assert ndjson.parse_lines(spark.createDataFrame([(line,)], "value string")).count() == 0


def test_repeated_key_takes_its_last_value(spark):
    df = ndjson.flatten_events(ndjson.parse_lines(spark.createDataFrame([('{"a":1,"b":2,"a":3}',)], "value string")))
    assert df.select(F.map_keys("fields"), text_of("fields", "a")).first()[:] == (["a", "b"], "3")


def test_flatten(events):
    rows = {r.id: r for r in events.select(
        text_of("fields", "id").alias("id"), F.map_keys("fields").alias("names"), text_of("fields", "payment_amount").alias("a"),
        text_of("fields", "payment_amount__2").alias("a2"), text_of("fields", "otp_success").alias("ok"), "event").collect()}
    first, second = rows["0123456789abcdef" * 2], rows["fedcba9876543210" * 2]
    assert (first.a, first.a2, first.ok) == ("1502.5", None, "1")
    assert (second.a, second.a2, second.ok) == ("7", "1000.0", "0")
    assert second.names == ["id", "timestamp", "otp_success", "payment_amount", "payment_amount__2", "os"]
    assert {r.event for r in events.select("event").distinct().collect()} == {"otp_entered", "coupon_entered", "unknown_event"}


@pytest.mark.parametrize("line,names", [
    ('{"a_b":1,"a_b__2":2,"a":{"b":3}}', ["a_b", "a_b__2", "a_b__3"]), ('{"a":{"b":{"c":1}},"l":[{"x":1}]}', ["a_b", "l"]), ('{"a":{},"x":1}', ["x"]), ('{"x":{"y":1},"x_y":2}', ["x_y", "x_y__2"]),
])
def test_name_collisions(spark, line, names):
    df = ndjson.flatten_events(ndjson.parse_lines(spark.createDataFrame([(line,)], "value string")))
    assert df.select(F.map_keys("fields")).first()[0] == names


def test_a_name_taken_several_times_is_counted(spark, tmp_path):
    """Without written ``__`` names the number is how often the name came before; the line is made once and spread over tasks before it is parsed."""
    line = '{"a":{"b_c":1},"x":0,"a_b":{"c":2},"a_b_c":3,"x_y":4,"x_":5}'
    df = ndjson.flatten_events(ndjson.parse_lines(spark.createDataFrame([(line,)], "value string")))
    assert df.select(F.map_keys("fields")).first()[0] == ["a_b_c", "x", "a_b_c__2", "a_b_c__3", "x_y", "x_"]
    rows = spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2026-01-01 10:00:00' AS ts, id AS user_id, 'view' AS event_type, 1.5D AS value FROM range(1, 4)")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    events = good_events(Tables(spark, str(tmp_path)))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert events.count() == 3 and plan.count("date_format(") == 1 and "RepartitionByExpression" in plan


def test_profile(events):
    p = {(r.event, r.field): r for r in profiling.profile_events(events).collect()}
    os = p["otp_entered", "os"]
    assert (os.null_rate, os.distinct_n, os.inferred_type, os.samples) == (1.0, 2, "string", [])
    assert p["otp_entered", "otp_success"].inferred_type == "number"
    assert p["otp_entered", "timestamp"].inferred_type == "timestamp"
    assert p["coupon_entered", "tags"].inferred_type == "json" and p["coupon_entered", "tags"].rows_n == 1
    amount = p["otp_entered", "payment_amount"]
    assert (amount.min_value, amount.max_value, amount.samples) == (7.0, 1502.5, ["1502.5", "7"])
    assert p["otp_entered", "payment_amount__2"].samples == ["1000"]


def test_raw_profile_keeps_booleans(spark, capture):
    p = profiling.profile_events(ndjson.read_ndjson(spark, capture), fields="record")
    assert p.filter("field = 'otp_success'").first().inferred_type == "boolean"


def test_empty_records_are_counted(spark):
    df = ndjson.flatten_events(ndjson.parse_lines(spark.createDataFrame([('{"event":"e"}',), ('{"event":"e","a":""}',)], "value string")))
    assert [(r.field, r.rows_n, r.null_rate) for r in profiling.profile_events(df).collect()] == [("a", 2, 0.5)]


def test_distinct_values_are_all_counted(spark):
    lines = spark.range(5200).select(F.concat(F.lit('{"event":"e","k":'), "id", F.lit(',"j":'), F.col("id") % 4999, F.lit("}")).alias("value"))
    p = {r.field: r.distinct_n for r in profiling.profile_events(ndjson.flatten_events(ndjson.parse_lines(lines))).collect()}
    assert p == {"k": 5200, "j": 4999}


def test_states_merge_to_the_whole_profile(spark, tmp_path):
    """Values in several files, a file with nothing but blanks, empty records, null and repeated files, fractions and long texts in one file only."""
    rows = [("a", '{"event":"e","n":1,"s":"x","m":null}'), ("a", '{"event":"e","n":1.5,"s":"%s"}' % ("y" * 300)), ("b", '{"event":"e","n":1,"s":"x"}'), ("b", '{"event":"f"}'), ("b", '{"event":"f"}'),
            ("c", '{"event":"e","n":null,"s":""}'), ("c", '{"event":"e","t":"2026-01-01 10:00:00","n":7}'), ("d", '{"event":"f","ok":true,"l":[1],"s":"2"}'), ("d", '{"event":"f","s":2}'), (None, '{"event":"f","s":"z"}'),
            *(("b", '{"event":"g","k":%d}' % i) for i in range(9)), *(("d", '{"event":"g","k":%d}' % i) for i in range(5, 20))]
    events = ndjson.flatten_events(ndjson.parse_lines(spark.createDataFrame(rows, "file string, value string")))
    whole = {(r.event, r.field): r for r in profiling.profile_events(events).collect()}
    folder, at = str(tmp_path / "states"), F.col("file")
    parts = (at.isin("a", "b"), at == "c", at == "c", at == "d", at.isNull(), at == "none")
    written = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "states").rglob("*.parquet")}
    for part in parts:
        before = written()
        profiling.save_profile_states(events.filter(part), folder)
        # only the own files are written
        assert not before or {f for f in before if "file=a" in str(f) or "file=b" in str(f)} <= {f for f, m in written().items() if before.get(f) == m}
    merged = {(r.event, r.field): r for r in profiling.read_profile(spark, folder).collect()}
    assert merged == whole and whole["g", "k"].distinct_n == 20 and whole["e", "n"].samples == ["1", "1.5", "7"]


TYPES = "event string, field string, position int, inferred_type string, null_rate double, distinct_n long, present_n long, fraction_n long, hex_n long, rows_n long, samples array<string>, max_length int, min_value double, max_value double"


def typed(spark, rows):
    return profiling.recommend_types(spark.createDataFrame(rows, TYPES))


@pytest.mark.parametrize("row,want", [
    (("flag", "boolean", 0.0, 2, ["true"], None, None, None), ("UInt8", "smallint")),
    (("attempts", "number", 0.0, 3, ["1"], None, 1.0, 3.0), ("UInt8", "smallint")),
    (("latency", "number", 0.0, 40, ["607"], None, 607.0, 3999.0), ("UInt16", "int")),
    (("latency", "number", 0.0, 51, ["607"], None, 607.0, 3999.0), ("UInt16", "int")),
    (("big", "number", 0.0, 3, ["70000"], None, 0.0, 70000.0), ("UInt32", "bigint")),
    (("delta", "number", 0.0, 3, ["-1"], None, -1.0, 3.0), ("Int64", "bigint")),
    (("fx", "number", 0.0, 3, ["1.5"], None, 0.0, 3.0), ("Float64", "double")),
    (("cart_value", "number", 0.0, 3, ["1"], None, 0.0, 3.0), ("Decimal64(2)", "decimal(18,2)")),
    (("id", "string", 0.0, 9000, ["0123456789abcdef" * 2], 32, None, None), ("FixedString(32)", "string")),
    (("user_id", "string", 0.1, 9000, ["u"], 28, None, None), ("String DEFAULT ''", "string")),
    (("os", "string", 0.1, 5, ["iOS"], 8, None, None), ("LowCardinality(String) DEFAULT ''", "string")),
    (("free", "string", 0.0, 1000, ["x"], 8, None, None), ("String", "string")),
    (("tags", "json", 0.0, 2, ["[]"], None, None, None), ("String", "string")),
    (("at", "timestamp", 0.0, 2, ["2026"], 20, None, None), ("DateTime64(3)", "timestamp")),
])
def test_type_advice(spark, row, want):
    field, kind, null_rate, distinct, samples, length, low, high = row
    counts = (9000, 9000 * ("." in samples[0]), 9000 * (len(samples[0]) == 32))
    r = typed(spark, [("e", field, 0, kind, null_rate, distinct, *counts, 10000, samples, length, low, high)]).first()
    assert (r.source_type, r.spark_type) == want


def test_one_fraction_among_many_values(spark):
    """A fraction far from the smallest values decides the type, and no load drops it."""
    numbers = [*range(1, 30), 2.5, 7.25]
    lines = spark.createDataFrame([(f'{{"event":"e","n":{x},"h":"{"a" * 32 if i else "b" * 31 + "x"}"}}',) for i, x in enumerate(numbers)], "value string")
    events = ndjson.flatten_events(ndjson.parse_lines(lines))
    advice = {r.field: r.spark_type for r in profiling.recommend_types(profiling.profile_events(events)).collect()}
    assert advice == {"n": "double", "h": "string"}
    assert tables.load_events(events, "e", [("n", advice["n"])]).agg(F.sum("n")).first()[0] == sum(numbers)
    forced = tables.load_events(events, "e", [("n", "smallint")])
    assert forced.agg(F.sum("n"), F.count_if(F.col("n").isNull())).first()[:] == (sum(range(1, 30)), 2)


def test_layout_advice(spark):
    f = lambda e, field, pos, null, d: (e, field, pos, "string", null, d, 10, 0, 0, 10, ["x"], 1, None, None)
    rows = [f("a", "os", 0, 0.0, 5), f("a", "device_type", 1, 0.0, 3), f("a", "destination", 2, 0.1, 1), f("a", "user_id", 3, 0.0, 9), f("a", "share_id", 4, 0.0, 9), f("a", "timestamp", 5, 0.0, 9),
            f("b", "ref_token", 0, 0.0, 9), f("b", "x", 1, 0.0, 1), f("c", "x", 0, 0.0, 1)]
    got = {r.event: (r.order_by, r.partition_by) for r in profiling.recommend_layout(spark.createDataFrame(rows, TYPES)).collect()}
    assert got == {"a": (["device_type", "share_id", "timestamp"], "month(timestamp)"), "b": (["ref_token"], ""), "c": ([], "")}


def test_typed_table_round_trip(spark, events, tmp_path):
    columns = [("id", "string"), ("timestamp", "timestamp"), ("otp_success", "smallint"), ("payment_amount", "decimal(18,2)"), ("payment_amount__2", "int"), ("os", "string")]
    rows = tables.load_events(events, "otp_entered", columns)
    for _ in range(2):
        tables.write_event_table(rows, str(tmp_path / "otp"), ["id", "timestamp"], bloom=["id"])
    back = spark.read.parquet(str(tmp_path / "otp"))
    assert [(str(r.payment_amount), r.payment_amount__2, r.otp_success, r.month) for r in back.orderBy("id").collect()] == [("1502.50", None, 1, 202601), ("7.00", 1000, 0, 202601)]
    counted = tables.verify_counts(events.filter("event = 'otp_entered'"), back.withColumn("event", F.lit("otp_entered"))).first()
    assert (counted.source_rows, counted.table_rows, counted.matches) == (2, 2, True)
    assert tables.expire(back, "timestamp", tables.RETENTION["events"], F.lit("2027-01-02 12:00").cast("timestamp")).count() == 1


def test_staging_by_event(spark, capture, tmp_path):
    tables.stage_by_event(ndjson.read_ndjson(spark, capture), str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).filter("event = 'otp_entered'").count() == 2


RUN_EVENT = "run_id string, spec string, seq int, ts string, type string, name string, payload string, phase string"


def run_events(spark, *keys):
    return spark.createDataFrame([(run, "s", seq, f"2026-01-0{day} 03:04:05", "status", "running", "{}", "") for run, seq, day in keys], RUN_EVENT)


def test_run_log_holds_each_event_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert versions.read_run_events(spark, path).count() == 0
    for batch in ([("r", 1, 2)], [("r", 1, 2)], [("r", 1, 2), ("r", 2, 3), ("r", 2, 3)], [("q", 2, 3)], [("r", 2, 3), ("q", 1, 1)]):
        versions.append_run_events(run_events(spark, *batch), path)
    assert sorted((r.run_id, r.seq, str(r.day)) for r in versions.read_run_events(spark, path).collect()) == [("q", 1, "2026-01-01"), ("q", 2, "2026-01-03"), ("r", 1, "2026-01-02"), ("r", 2, "2026-01-03")]


def test_run_log_as_a_stream(spark, tmp_path):
    schema = run_events(spark, ("r", 1, 1)).schema
    for start, keys in enumerate(([("r", 1, 2), ("r", 2, 2)], [("r", 2, 2), ("r", 3, 3)], [])):
        if keys:
            run_events(spark, *keys).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        versions.sink_run_events(stream, str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination()
        assert versions.read_run_events(spark, str(tmp_path / "log")).count() == (2, 3, 3)[start]


def test_files_of_a_month_do_not_overlap(spark, tmp_path):
    """A month with most rows is several files; a lookup by month and key reads one."""
    rows = spark.range(6000).select(F.xxhash64("id").alias("k"), "id", F.when(F.col("id") % 10 == 0, "2026-02-03").otherwise("2026-01-02").cast("timestamp").alias("timestamp"))
    tables.write_event_table(rows, str(tmp_path / "t"), ["k"], ranges=5)
    back = spark.read.parquet(str(tmp_path / "t"))
    files = tables.file_ranges(back, ["k"])
    check = {r.month: r for r in tables.layout_check(files).collect()}
    assert {m: (r.rows_n, r.overlapping_n) for m, r in check.items()} == {202601: (5400, 0), 202602: (600, 0)} and check[202601].files_n > 1
    key = files.filter("month = 202601").orderBy("low").collect()[1].low.k
    plan = back.filter((F.col("month") == 202601) & (F.col("k") == key))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k," in plan
    assert files.filter((F.col("month") == 202601) & F.lit(key).between(F.col("low.k"), F.col("high.k"))).count() == 1
    overlapping = spark.createDataFrame([(1, "a", 1, (1,), (5,)), (1, "b", 1, (2,), (3,)), (1, "c", 1, (4,), (6,)), (1, "d", 1, (7,), (7,))], "month int, file string, rows_n long, low struct<k:int>, high struct<k:int>")
    assert tables.layout_check(overlapping).first().overlapping_n == 2


@pytest.mark.parametrize("keep_from,dropped,rewritten,left", [
    ("2026-02-10 00:00:00", ["202601"], ["202602"], {"202602": 19, "202603": 31, None: 1}),
    ("2026-02-01 00:00:00", ["202601"], [], {"202602": 28, "202603": 31, None: 1}),
    ("2025-01-01 00:00:00", [], [], {"202601": 31, "202602": 28, "202603": 31, None: 1}),
    ("2026-03-31 12:00:00", ["202601", "202602", "202603"], [], {None: 1}),
])
def test_retention_rewrites_one_month(spark, tmp_path, keep_from, dropped, rewritten, left):
    database = "kept_" + tmp_path.name.replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path}/db'")
    try:
        days = spark.range(90).select((F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("timestamp"), "id")
        name = f"{database}.events"
        tables.save_event_table(days.unionByName(spark.range(1).select(F.lit(None).cast("timestamp").alias("timestamp"), "id")), name, ["id"])
        held = lambda: {(r.month, r.f) for r in spark.table(name).select("month", F.col("_metadata.file_path").alias("f")).distinct().collect()}
        before = held()
        assert tables.expire_months(spark, name, "timestamp", keep_from, ["id"]) == {"dropped": dropped, "rewritten": rewritten}
        assert {r.month: r["count"] for r in spark.table(name).groupBy("month").count().collect()} == left
        after = held()
        assert {m for m, f in after if (m, f) not in before} == set(rewritten) and after - before == {x for x in after if x[0] in rewritten}
        assert {m for m, _ in before - after} == {*dropped, *rewritten}
        assert tables.expire_months(spark, name, "timestamp", keep_from) == {"dropped": [], "rewritten": []} and held() == after
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_document_table(spark, tmp_path):
    spark.range(1).selectExpr("id", "id AS v").write.format("parquet").option("path", str(tmp_path / "t")).mode("overwrite").saveAsTable("documented")
    try:
        assert tables.document_table(spark, "documented", "it's a table", {"v": "a value", "ghost": "none"}) == ["v"]
        assert {r["col_name"]: r["comment"] for r in spark.sql("DESCRIBE documented").collect()}["v"] == "a value"
    finally:
        spark.sql("DROP TABLE documented")


def test_stream_intake(spark, tmp_path):
    """Strict: a malformed line stops the batch before it is written, and once it is mended the batch goes through. Quarantine: it is kept aside."""
    root, lines = tmp_path / "in", FIXTURE.splitlines()
    root.mkdir()
    (root / "1.ndjson").write_text("\n".join(lines[:3]) + "\n")
    start = lambda out, mode, **more: stream_events(spark, str(root), f"{tmp_path}/{out}", f"{tmp_path}/{out}_checkpoint", mode, **more).awaitTermination(120)
    start("strict", "fail")
    assert staged_lines(spark, f"{tmp_path}/strict").count() == 3
    (root / "2.ndjson").write_text("\n".join(lines[3:]))
    with pytest.raises(Exception, match="malformed line"):
        start("strict", "fail")
    assert staged_lines(spark, f"{tmp_path}/strict").count() == 3
    (root / "2.ndjson").write_text(lines[3])
    for _ in range(2):  # a second start finds nothing new
        start("strict", "fail")
        assert staged_lines(spark, f"{tmp_path}/strict").groupBy("batch").count().orderBy("batch").collect() == [(0, 3), (1, 1)]
    (root / "2.ndjson").write_text("\n".join(lines[3:]))
    start("kept", "keep", typed={"otp_entered": [("id", "string"), ("payment_amount", "int")]}, files_per_batch=1)
    kept = staged_lines(spark, f"{tmp_path}/kept")
    assert sorted((r.batch, r.event, r.malformed, r.value) for r in kept.collect() if r.malformed) == [(1, "unknown_event", True, "{malformed")] and kept.count() == 5
    assert sorted((r.batch, r.payment_amount) for r in typed_rows(spark, f"{tmp_path}/kept", "otp_entered").collect() if r.payment_amount) == [(0, 7)]


def test_late_rows_of_a_stream(spark, tmp_path):
    """An hour is given out once, when the latest time seen is the lateness past its end; what comes for it later is not counted."""
    at = lambda *times: spark.createDataFrame([(f"2026-01-01 {t}", i) for i, t in enumerate(times)], "t string, query_duration_ms int").select(F.col("t").cast("timestamp").alias("event_time"), "query_duration_ms")
    given = []
    for part in (at("01:10", "02:05", "04:30"), at("01:50", "02:59", "03:10", "05:00"), at("09:00")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        sink_hourly_counts(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "2 hours").awaitTermination()
        given.append(sorted((r.hour_ts // 3600 % 24, r.queries, r.max_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert given[0] == [(1, 1, 0)] and given[1] == [(1, 1, 0), (2, 2, 1)]
    assert given[2] == [(1, 1, 0), (2, 2, 1), (3, 1, 2), (4, 1, 2), (5, 1, 3)]


def test_late_queries_of_the_given_log_are_dropped(spark):
    from evidencelake.plans.registry import Tables, load_all

    t = Tables(spark, "/root/testdata/sf0.001")
    counted, sent = (load_all()[n].build(t).agg(F.sum("queries")).first()[0] for n in ("hourly_stream", "hourly_log_counts"))
    assert 0.9 * sent < counted < sent - 20
