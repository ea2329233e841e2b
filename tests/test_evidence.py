"""Digest, precision, sanity, verification and confidence on the recorded cases."""

import pytest
from pyspark.sql import functions as F

from evidencelake.functions.stats import wilson
from evidencelake.operators import confidence, digest, precision, sanity, verify
from evidencelake.operators.quantiles import exact_quantiles

P = "answer_id string, column string, kind string, value double, n double, half_width_pp double"
A = (
    "answer_id string, headline_columns array<string>, verified_column string, has_verification boolean, agreed boolean, relative_delta double,"
    "definition_ok boolean, concern string, verify_note string, impossible_flags int, small_sample_flags int, dropped_tasks int, planned_tasks int,"
    "citation_retries int, assumptions array<string>, named_metrics array<string>"
)


def bounded(a, column, n, hw, value=0.5):
    return (a, column, "proportion", value, float(n), float(hw))


def unbounded(a, column, kind):
    return (a, column, kind, 1.0, None, None)


def answer(a, headline=(), verified=None, has=False, agreed=None, delta=None, ok=True, concern="", note="", imp=0, small=0, dropped=0, planned=0, retries=0, assumptions=(), named=()):
    return (a, list(headline), verified, has, agreed, delta, ok, concern, note, imp, small, dropped, planned, retries, list(assumptions), list(named))


def score(spark, answers, precisions):
    out = confidence.confidence(spark.createDataFrame(answers, A), spark.createDataFrame(precisions, P))
    return {r["answer_id"]: r for r in out.collect()}


GOLDEN = [
    # verified population figure with three thin segments
    (answer("q1", ["full_applied_rate"], "full_applied_rate", True, True, 0.0, planned=3),
     [bounded("q1", "full_applied_rate", 848, 3.1), bounded("q1", "applied_rate", 2, 40.5), bounded("q1", "apply_rate", 14, 24), bounded("q1", "segment_rate", 31, 17)],
     0.79, "high"),
    (answer("tails", planned=2), [bounded("tails", "applied_rate", 2, 40.5), bounded("tails", "apply_rate", 5, 30), bounded("tails", "seg_rate", 8, 25)], 0.05, "low"),
    (answer("pop", ["full_apply_rate"], planned=2), [bounded("pop", "full_apply_rate", 400, 4.5), bounded("pop", "applied_rate", 2, 40.5)], 0.50, "medium"),
    (answer("dis", ["full_conv_rate"], "full_conv_rate", True, False, 0.053, planned=1), [bounded("dis", "full_conv_rate", 1200, 2.0)], 0.38, "low"),
    (answer("sums", planned=2), [unbounded("sums", "avg_discount", "mean"), unbounded("sums", "discount_per_order", "ratio")], 0.60, "medium"),
    (answer("athigh", ["full_rate"], None, True, True, assumptions=list("abcd")), [bounded("athigh", "full_rate", 1000, 0)], 0.75, "high"),
    (answer("atmed", ["full_rate"], None, True, True, 0.0, False, "wrong denominator", assumptions=list("abcd"), retries=2), [bounded("atmed", "full_rate", 1000, 0)], 0.45, "medium"),
    (answer("below", ["full_rate"], None, True, True, 0.0, False, "wrong denominator", assumptions=list("abcd"), retries=2), [bounded("below", "full_rate", 1000, 0.33)], 0.44, "low"),
    (answer("perfect", ["full_rate"], None, True, True, named=["m"]), [bounded("perfect", "full_rate", 1000, 0)], 1.0, "high"),
    (answer("named", ["full_rate"], None, True, True, assumptions=["last 30 days"], named=["m"]), [bounded("named", "full_rate", 1000, 0)], 0.97, "high"),
    (answer("flagged", [], None, True, True, small=1), [unbounded("flagged", "avg_x", "mean")], 0.50, "medium"),
    (answer("noden", [], None, True, True), [unbounded("noden", "a_rate", "proportion"), unbounded("noden", "b_rate", "proportion")], 0.50, "medium"),
    (answer("same", ["conversion_rate"], None, True, True), [bounded("same", "conversion_rate", 14026, 0.83), bounded("same", "conversion_rate", 198, 6.81), bounded("same", "conversion_rate", 41, 15.2)], 0.94, "high"),
]


@pytest.fixture(scope="module")
def scored(spark):
    return score(spark, [g[0] for g in GOLDEN], [p for g in GOLDEN for p in g[1]])


@pytest.mark.parametrize("case", GOLDEN, ids=lambda g: g[0][0])
def test_golden_scores(scored, case):
    r = scored[case[0][0]]
    assert (r["score"], r["level"]) == (case[2], case[3])
    assert round(1 + sum(float(s["delta"]) for s in r["signals"]), 2) == r["score"]


def test_notes_tell_what_happened(scored):
    assert "n=848" in scored["q1"]["note"] and "3 small segments (applied_rate, apply_rate, segment_rate; n 2–31)" in scored["q1"]["note"]
    assert "5.3%" in scored["dis"]["note"]
    assert "none of the figures has an interval" in scored["sums"]["note"]
    assert "2 rates lack a base count" in scored["noden"]["note"]
    assert scored["same"]["note"].count("conversion_rate") == 2 and "n=41" in scored["same"]["note"]


def test_two_thin_figures_of_the_headline_column(spark):
    r = score(spark, [answer("x", ["r_rate"], None, True, True)], [bounded("x", "r_rate", 30, 12), bounded("x", "r_rate", 20, 14), bounded("x", "r_rate", 20, 14), bounded("x", "r_rate", 5, 30)])["x"]
    assert "3 small segments (r_rate; n 5–20)" in r["note"]


def test_headline_penalty_is_continuous(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 4.0, 10.0, 24.0, 1000.0, -3.0, float("nan"))], "hw double")
    got = [round(r[0], 9) for r in df.select(confidence.headline_penalty(F.col("hw"))).collect()]
    assert got == [0, 0.12, 0.57, 0.65, 0.65, 0, 0]


@pytest.mark.parametrize("headline,verified,want", [
    (["full_wide_rate"], "checked_rate", "checked_rate"),
    (["full_wide_rate"], None, "full_wide_rate"),
    ([], None, "checked_rate"),
])
def test_pick_headline(spark, headline, verified, want):
    p = spark.createDataFrame([bounded("a", "full_wide_rate", 100, 20), bounded("a", "checked_rate", 900, 1)], P)
    picked = precision.pick_headline(p, spark.createDataFrame([answer("a", headline, verified)], A)).collect()
    assert [r["column"] for r in picked] == [want]


def test_wilson(spark):
    r = spark.range(1).select(wilson(F.lit(0.8364485981308412), F.lit(428)).alias("w"), wilson(F.lit(0.5), F.lit(0)).alias("z")).first()
    assert (round(r.w.lo, 3), round(r.w.hi, 3)) == (0.798, 0.869) or (round(r.w.lo, 2), round(r.w.hi, 2)) == (0.8, 0.87)
    assert (r.z.lo, r.z.hi) == (0.0, 1.0)


def test_bare_n_is_refused_beside_two_rates(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.3519, 1), ("b", 0.8, None, 500)], "answer_id string, guest_share double, overall_guest_share double, n int")
    got = {(r["answer_id"], r["column"]): r["n"] for r in precision.precision(precision.figures_map(rows), ["answer_id"]).collect()}
    assert got == {("a", "guest_share"): None, ("a", "overall_guest_share"): None, ("b", "guest_share"): 500.0}


def test_named_denominators_beside_two_rates(spark):
    rows = spark.createDataFrame([(0.29, 119, 0.352, 6715)], "guest_share double, guest_n int, overall_guest_share double, overall_guest_n int")
    got = {r["column"]: r["n"] for r in precision.precision(precision.figures_map(rows)).collect()}
    assert got == {"guest_share": 119.0, "overall_guest_share": 6715.0}


def test_declared_denominator_wins(spark):
    rows = spark.createDataFrame([(500, 100, 0.2)], "offer_shown_n int, purchased_n int, attach_rate double")
    got = precision.precision(precision.figures_map(rows), denominators={"attach_rate": "offer_shown_n"}).collect()
    assert [(r["column"], r["n"]) for r in got] == [("attach_rate", 500.0)]


def test_classification_and_aliases(spark):
    df = spark.createDataFrame([], "conversion_rate double, conversion_n int, city string, d date, t timestamp, spend decimal(9,2), tags array<string>, ok boolean, `bad name` int")
    kinds = digest.classify_columns(df.schema)
    assert kinds == {"conversion_rate": "rate", "conversion_n": "count", "city": "categorical", "d": "temporal", "t": "temporal", "spend": "numeric", "tags": "other", "ok": "other"}
    aliases = [e.alias for e in digest.plan_digest({"x": "numeric", "x_min": "numeric"})]
    assert "x_min_d2" in aliases and len(aliases) == len(set(aliases))
    assert digest.tie_breakers({"m_rate": "rate", "city": "categorical", "tags": "other", "day": "temporal", "signups": "count", "spend": "numeric"}, "m_rate") == ["city", "day", "signups", "spend"]


@pytest.mark.parametrize("rate,columns,want", [
    ("otp_success_rate", ["otp_success_n"], "otp_success_n"), ("conversion_rate", ["conversion_total"], "conversion_total"),
    ("rate", ["n"], "n"), ("conversion_rate", ["city"], None), ("n_rate", ["n_rate"], None),
])
def test_denominator_by_name(rate, columns, want):
    assert digest.denominator_for(rate, columns) == want


def test_weighted_rate_is_not_the_mean(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 0.5, 99), (None, None, 0)], "city string, r_rate double, r_n int")
    row = digest.digest(df).first().asDict()
    assert row["full_r_rate"] == pytest.approx((1 + 49.5) / 100) and "r_rate_avg" not in row
    assert (row["total_rows"], row["city_distinct"], row["r_rate_p50"]) == (3, 2, 1.0)


def test_text_kinds_read_every_row(spark):
    df = spark.createDataFrame([(None, "x", "2025-01-01", ""), ("42", "1", "2025-01-02", "")], "latency_count string, mixed string, day string, blank string")
    assert {r["column"]: r["kind"] for r in digest.classify_text_columns(df).collect()} == {"latency_count": "count", "mixed": "other", "day": "temporal", "blank": "other"}


def test_digest_flags(spark):
    df = spark.createDataFrame([(1.2, 12), (0.5, 3)], "a_rate double, a_n int")
    kinds = digest.classify_columns(df.schema)
    assert {r["kind"] for r in digest.digest_flags(digest.digest(df), kinds).collect()} == {"impossible", "small_sample"}


def test_formats(spark):
    df = spark.createDataFrame([(0.83, 83.0, 120.0, 5.5, 3, 2.5, 0.1)], "a_rate double, b_rate double, p_ms double, price double, users int, x double, gap_pp double")
    got = {r["column"]: r["format"] for r in digest.infer_formats(df).collect()}
    assert got == {"a_rate": "fraction", "b_rate": "percent", "p_ms": "ms", "price": "currency", "users": "count", "x": "number", "gap_pp": "percentage_points"}


@pytest.mark.parametrize("values,q,kind,want", [
    ([1, 2, 3, 4], 0.5, "upper", 3), ([5], 0.5, "upper", 5), ([1, 2, 3, 4], 0.5, "interpolated", 2.5),
    (list(range(1, 101)), 0.95, "interpolated", 95.05), ([-5.5, -1, 0, 1e9, 2, 2, 2], 0.5, "upper", 2), ([7, None, 7], 0.5, "upper", 7),
])
def test_exact_quantiles(spark, values, q, kind, want):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert exact_quantiles(df, [], "v", {"x": (kind, q)}).first()["x"] == pytest.approx(want)


def test_quantiles_of_a_null_group_and_skew(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), (F.col("id") * 7 % 3000).cast("double").alias("v"))
    got = {r["k"]: (r["n"], r["x"]) for r in exact_quantiles(df, ["k"], "v", {"x": ("upper", 0.5)}).collect()}
    want = {k: sorted(i * 7 % 3000 for i in range(3000) if (i % 3 > 0) == (k == "hot")) for k in ("hot", None)}
    assert got == {k: (len(v), float(v[len(v) // 2])) for k, v in want.items()}


CELLS = "answer_id string, task_id string, row_id int, column string, value_num double, value_str string"


def cells(spark, tasks):
    rows = []
    for task, records in tasks.items():
        for i, record in enumerate(records):
            for c, v in record.items():
                number = float(v) if isinstance(v, (int, float)) else None
                rows.append(("a", task, i, c, number, None if v is None else str(v)))
    return spark.createDataFrame(rows, CELLS)


def gate(spark, tasks, digested=None, flags=None):
    planned = spark.createDataFrame([("a", t) for t in tasks], "answer_id string, task_id string")
    g = sanity.sanity_gate(planned, cells(spark, tasks), digested, flags)
    return {r["task_id"]: r for r in g.collect()}, sanity.sanity_counts(g).first()


def test_sanity_gate_counts(spark):
    tasks = {"t1": [], "t2": [{"blocked": 1, "reason": "no coupon column"}], "t3": [{"a_rate": 1.2, "b_rate": 1.4, "applied_n": 900}], "t4": [{"apply_rate": 0.3, "applied_n": 9}],
             "t5": [{"apply_rate": 0.4, "applied_n": 12}, {"apply_rate": 0.5, "applied_n": 900}], "t6": [{"share_clicked_applications": 1601, "applied_n": 900}]}
    by_task, counts = gate(spark, tasks)
    assert (counts.dropped_tasks, counts.small_sample_flags, counts.impossible_flags, counts.planned_tasks) == (2, 1, 2, 6)
    assert by_task["t2"].drop_reason == "not computable: no coupon column" and by_task["t1"].drop_reason == "empty result set"


def test_a_digested_column_is_not_flagged_twice(spark):
    digested = spark.createDataFrame([("a", "t", "a_rate")], "answer_id string, task_id string, column string")
    flags = spark.createDataFrame([("a", "t", "impossible", "a_rate exceeds 100% in 1 of 1 rows of the whole result")], "answer_id string, task_id string, kind string, flag string")
    _, counts = gate(spark, {"t": [{"a_rate": 1.2, "e_rate": 1.3}]}, digested, flags)
    assert counts.impossible_flags == 2


@pytest.mark.parametrize("rows,want", [([{"n": 0, "r_rate": None}], False), ([{"n": 5000, "r": 0}], True), ([{"country": "SG", "n": 0}], True), ([], False)])
def test_has_evidence(spark, rows, want):
    answers = spark.createDataFrame([("a",)], "answer_id string")
    assert sanity.has_evidence(cells(spark, {"t": rows}), answers).first()["has_evidence"] is want


RESOLVE = [
    ("digest first", "full_applied_rate", 0.327, {"full_applied_rate": 0.327, "full_applied_n": 848}, [{"full_applied_rate": 0.9}], ("full_applied_rate", 0.327, "name")),
    ("rows by name", "apply_rate", 0.42, {}, [{"apply_rate": 0.42, "apply_n": 1200}], ("apply_rate", 0.42, "name")),
    ("by value", "total_discount", 47262, {"full_discount_sum": 47262, "total_rows": 1200}, [], ("full_discount_sum", 47262, "value")),
    ("ambiguous", "revenue", 5000, {"full_paid_sum": 5000, "full_charged_sum": 5000}, [{"paid": 1}, {"paid": 2}], (None, None, None)),
    ("kind differs", "applied_rate", 0.42, {}, [{"applied_n": 0.42, "other_n": 7}], (None, None, None)),
    ("magnitude", "applications", 3, {"full_apply_rate": 0.5, "full_apply_n": 3}, [], ("full_apply_n", 3, "value")),
    ("only figure", "", None, {}, [{"conversion": 0.61}], ("conversion", 0.61, "value")),
    ("two figures", "", None, {}, [{"a_total": 5, "b_total": 9}], (None, None, None)),
    ("nothing", "anything", 42, {}, [], (None, None, None)),
    ("rows differ", "checkout_rate", None, {}, [{"checkout_rate": 0.41}, {"checkout_rate": 0.33}, {"checkout_rate": 0.5}], (None, None, None)),
    ("rows agree", "checkout_rate", None, {}, [{"checkout_rate": 0.41}, {"checkout_rate": 0.41}], ("checkout_rate", 0.41, "name")),
]


def test_figure_resolution(spark):
    figures, checks = [], []
    for name, expected, value, dig, rows, _ in RESOLVE:
        figures += [(name, "digest", 0, c, float(v)) for c, v in dig.items()]
        figures += [(name, "rows", i, c, float(v)) for i, row in enumerate(rows) for c, v in row.items()]
        checks.append((name, expected, None if value is None else float(value), len(rows)))
    got = verify.resolve_figure(
        spark.createDataFrame(figures, "check_id string, origin string, row_id int, column string, value double"),
        spark.createDataFrame(checks, "check_id string, expected string, verified_value double, rows_n int"),
    ).collect()
    assert {r.check_id: (r.resolved_column, r.resolved_value, r.matched_by) for r in got} == {c[0]: c[5] for c in RESOLVE}


def test_single_value(spark):
    df = spark.createDataFrame([("a", 0, 0.479), ("b", 0, 0.479), ("b", 1, 0.4791), ("c", 0, 0.479), ("c", 1, 0.419), ("d", 0, None)], "check_id string, position int, v double")
    got = {r.check_id: (r.verified_value, r.inconclusive) for r in verify.single_value(df, ["check_id"], "v").collect()}
    assert got == {"a": (0.479, False), "b": (0.479, False), "c": (None, True), "d": (None, False)}


def test_digest_describes_every_column(spark):
    df = spark.createDataFrame([tuple(0.1 * i for i in range(1, 8)), tuple(1.2 * i for i in range(1, 8))], ", ".join(f"r{i}_rate double" for i in range(1, 8)))
    row = digest.digest(df).first().asDict()
    assert row["r7_rate_max"] == pytest.approx(8.4) and row["r7_rate_gt1_n"] == 1
    flagged = {r.flag.split()[0] for r in digest.digest_flags(digest.digest(df), digest.classify_columns(df.schema)).collect() if r.kind == "impossible"}
    assert flagged == {f"r{i}_rate" for i in range(1, 8)}
    assert "r5_rate_max" not in digest.digest(df, caps=digest.SHORT).columns
