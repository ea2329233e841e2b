"""Citations, named metrics and assumptions on the recorded cases."""

import pytest
from pyspark.sql import functions as F

from evidencelake.functions.text import numbers_in
from evidencelake.operators import citations, questions

# (case, text, pool, dates, asked, uncited)
CITED = [
    ("range", "somewhere in 33.9%-35.6%", [33.9, 35.6, 0.339, 0.356], [], [], set()),
    ("months", "reports of Feb-2026 and Mar-2026", [], [], [], set()),
    ("brackets", "margins (29.6%)-(30.7%)", [29.6, 30.7], [], [], set()),
    ("negative", "it moved by -5.2pp", [5.2], [], [], {"-5.2"}),
    ("difference", "it moved by -5.2pp", [10, 15.2], [], [], set()),
    ("years", "sales of 2025-2026, or 2025 alone", [], [], [], set()),
    ("known dates", "from 2025-03-01 until 2025-06-30", [5], ["2025-03-01", "2025-06-30"], [], set()),
    ("unknown date", "one jump on 2024-11-17", [5], ["2025-03-01"], [], {"-17"}),
    ("shorter date", "the newest is of 2025-03-15 08:45", [7], ["2025-03-15 08:45:00"], [], set()),
    ("two dates", "2025-03-15 10:33 or later than 2025-03-15", [7], ["2025-03-15 08:45:00"], [], {"-15", "33"}),
    ("rate of counts", "Of the parcels 23.1% arrived late.", [13, 1, 3], [], [], set()),
    ("raw rate", "Late by a share of 0.231.", [13, 1, 3], [], [], set()),
    ("invented rate", "Of the parcels 61.4% arrived late.", [13, 1, 3], [], [], {"61.4"}),
    ("gap", "Rail beats road by 37.9pp.", [0.858, 85.8, 0.479, 47.9], [], [], set()),
    ("invented gap", "Rail beats road by 64.2pp.", [0.858, 85.8, 0.479, 47.9], [], [], {"64.2"}),
    ("unasked", "Nothing changed within 30 days.", [0.5], [], [], {"30"}),
    ("asked", "Nothing changed within 30 days.", [0.5], [], [30], set()),
    ("asked is not arithmetic", "that is 4.29 weeks, or 30 days", [0.5], [], [30, 7], {"4.29"}),
    ("thousands", "14,026 parcels, not 88,431", [14026], [], [], {"88,431"}),
    ("small integers", "12 depots in 3 towns", [], [], [], set()),
    ("pair", "2400", [24, 0.01], [], [], set()),
    ("no pair", "2400", [24], [], [], {"2400"}),
    ("bounds", "83.6% on time (80.1%-87.1% at 95%, ±3.5pp over n=428)", [0.8364, 83.64, 428, 0.7985, 0.8684, 3.49, 79.85, 86.84, 95], [], [], set()),
    ("empty", "nothing to count", [], [], [], set()),
]


def test_citations(spark):
    rows = lambda i, schema: spark.createDataFrame([(c[0], *x) for c in CITED for x in i(c)], schema)
    texts = rows(lambda c: [("body", c[1])], "answer_id string, section string, text string")
    pool = rows(lambda c: [([n], float(v)) for n, v in enumerate(c[2])], "answer_id string, position array<int>, value double")
    dates = rows(lambda c: [(d,) for d in c[3]], "answer_id string, literal string")
    asked = rows(lambda c: [(float(v),) for v in c[4]], "answer_id string, value double")
    got = {}
    for r in citations.uncited_numbers(texts, pool, dates, asked).collect():
        got.setdefault(r.answer_id, set()).add(r.raw)
    assert {c[0]: got.get(c[0], set()) for c in CITED} == {c[0]: c[5] for c in CITED}


def test_band_join_agrees_with_the_predicate(spark):
    """Near the edges of every tolerance the banded join must find what a full comparison finds."""
    figures = [0.0, 0.05, -0.05, 1.0, 3.99, 4.0, 4.01, -4.01, 7.3, 52.0, 99.99, -640.0, 12345.6, 1e9]
    numbers = sorted({round(f + s * max(0.06, abs(f) * 0.015) * k, 9) for f in figures for s in (-1, 1) for k in (0.5, 0.999, 1.001, 1.5)})
    n = spark.createDataFrame([(float(x),) for x in numbers], "n double").withColumn("_band", F.explode(citations.near_bands(F.col("n"))))
    p = spark.createDataFrame([(f,) for f in figures], "value double").withColumn("_band", citations.band(F.col("value")))
    got = {(r.n, r.value) for r in n.join(p, "_band").filter(citations.near(F.col("n"), F.col("value"))).select("n", "value").collect()}
    assert got == {(x, f) for x in numbers for f in figures if abs(x - f) <= max(0.06, abs(f) * 0.015)}


def test_derived_numbers_cost_no_row_per_figure(spark, monkeypatch):
    """Answers of many blocks of figures and numbers find what a full comparison finds, and blocks meet only where a result can come from."""
    monkeypatch.setattr(citations, "BLOCK", 16)
    many = [float(i * i) if i % 3 else i * 7.31 for i in range(1, 200)]
    numbers = {"few": [5.2, 43.0, 33.3, 61.4, 7e5], "many": [round(13.7 * i, 2) for i in range(1, 40)] + [2e6, 0.02, 9e-9], "none": [50.0]}
    figures = {"few": [10.0, 15.2, 100.0, 43.0, 0.0, -3.0], "many": many}
    frame = lambda d, c: spark.createDataFrame([(a, float(x)) for a, v in d.items() for x in v], f"answer_id string, {c} double")
    blocks, open_ = citations.figure_blocks(frame(figures, "value")), frame(numbers, "n")

    def derived(n, a, b):
        near = lambda x, scale=1.0: min(n - 0.06, n / 1.015, n / 0.985) / scale <= x <= max(n + 0.06, n / 1.015, n / 0.985) / scale
        return a != b and (near(a - b) or b != 0 and (near(a / b) or a == int(a) and b == int(b) and abs(a / b) <= 1 and near(a / b, 100.0)))

    got = {(r.answer_id, r.n) for r in citations.derivable(open_, blocks).collect()}
    assert got == {(k, n) for k, v in figures.items() for n in numbers[k] if any(derived(n, a, b) for a in v for b in v)} and 10 < len(got) < 46
    sizes = {r.answer_id: r.n for r in blocks.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("members")).alias("most")).filter("most <= 16").collect()}
    units = citations.meeting_blocks(open_, blocks).groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")).collect()
    # an open number and a figure are no row: 42 numbers of 199 figures are at most 5 blocks with 15 times 15
    assert sizes["many"] < 16 and {r.answer_id for r in units} == {"few", "many"} and all(r.n <= 5 * sizes[r.answer_id] ** 2 for r in units)


def test_audit_over_many_blocks(spark, monkeypatch):
    """An answer whose figures fill several blocks, one without figures and one without numbers are counted alike."""
    monkeypatch.setattr(citations, "BLOCK", 4)
    texts = spark.createDataFrame([("a", "s", "from 400 to 4,100, a gap of 3,700, not 77,000"), ("b", "s", "over 55 and 66.5"), ("c", "s", "none"), ("d", "s", "nearly 55")], "answer_id string, section string, text string")
    pool = spark.createDataFrame([("a", float(100 * i)) for i in range(1, 42)] + [("c", 1.0), ("d", 55.2)], "answer_id string, value double")
    assert citations.figure_blocks(pool).filter("answer_id = 'a'").count() > 10
    audit = citations.citation_audit(texts, citations.uncited_numbers(texts, pool)).collect()
    assert {(r.answer_id, r.uncited_n, r.passes) for r in audit} == {("a", 1, False), ("b", 2, False), ("c", 0, True), ("d", 0, True)}


def test_blocks_of_one_answer_meet_few_others(spark, monkeypatch):
    """Pairs of blocks grow with the blocks of an answer, not with their square, whatever the bounds of its open numbers; what is found stays."""
    monkeypatch.setattr(citations, "BLOCK", 16)
    numbers = [-90.0, 0.3, 33.9, 41.7, 500.5, 2503.0, 7e8]
    figures = {"thousands": [1000.0 * i for i in range(1, 401)], "signed": [37.0 * i + (i % 4) / 4 for i in range(-200, 201)], "limits": [float("inf"), float("-inf"), float("nan"), 1e300, 0.0, *range(3000, 3060)]}
    frame = lambda d, c: spark.createDataFrame([(a, float(x)) for a, v in d.items() for x in v], f"answer_id string, {c} double")
    blocks, open_ = citations.figure_blocks(frame(figures, "value")), frame({a: numbers for a in figures}, "n")
    sizes = {r.answer_id: r["count"] for r in blocks.groupBy("answer_id").count().collect()}
    pairs = {r.answer_id: r["count"] for r in citations.meeting_blocks(open_, blocks).groupBy("answer_id").count().collect()}
    assert min(sizes["thousands"], sizes["signed"]) > 24 and all(pairs[a] <= 8 * sizes[a] for a in ("thousands", "signed"))

    def derived(n, a, b):
        near = lambda x, scale=1.0: min(n - 0.06, n / 1.015, n / 0.985) / scale <= x <= max(n + 0.06, n / 1.015, n / 0.985) / scale
        return a != b and (near(a - b) or b != 0 and (near(a / b) or a % 1 == 0 and b == b // 1 and abs(a / b) <= 1 and near(a / b, 100.0)))

    got = {(r.answer_id, r.n) for r in citations.derivable(open_, blocks).collect()}
    finite = {k: [x for x in v if abs(x) < float("inf")] for k, v in figures.items()}
    want = {(k, n) for k, v in finite.items() for n in numbers if any(derived(n, float(a), float(b)) for a in v for b in v)}
    assert got == want and ("thousands", 500.5) not in got and 6 < len(got) < 20


def test_pool_puts_shown_rows_before_profiles(spark):
    cell = "answer_id string, task_position int, row_id int, position int, value double"
    cells = spark.createDataFrame([("a", 0, 0, 0, 0.5), ("a", 0, 30, 0, 77.0), ("a", 1, 0, 0, 0.31)], cell)
    profile = spark.createDataFrame([("a", 0, 0, 0, 0.0712)], cell)
    tasks = spark.createDataFrame([("a", 0, 1000, 52340), ("a", 1, 1, 1)], "answer_id string, task_position int, fetched_rows int, total_rows int")
    pool = [r.value for r in citations.numeric_pool(cells, tasks, profile).orderBy("position").collect()]
    assert pool.index(0.31) < pool.index(0.0712) and {1000.0, 52340.0, 77.0, 50.0, 31.0} <= set(pool)
    shown = {r.value for r in citations.numeric_pool(cells, tasks, profile, rows_shown=24).collect()}
    assert 24.0 in shown and 77.0 not in shown


def test_numbers_in(spark):
    df = spark.createDataFrame([("30 trucks, 14,026 parcels, 47.9% by rail",)], "t string")
    assert df.select(numbers_in(F.col("t"))).first()[0] == [30.0, 14026.0, 47.9]


STORED = ["metric:delivery_rate", "metric:rail_usage_rate", "metric:rail_on_time_delivery_rate", "metric:rail_cost_share", "metric:depot_turnover", "metric:label_scan_pass_rate",
          "metric:road_on_time_delivery_rate", "overview:depots", "table:parcel_scanned"]
NAMED = {
    "Tell me the road on time delivery rate": ["road_on_time_delivery_rate"],
    "Does rail usage rate differ between towns?": ["rail_usage_rate"],
    "List depot turnover for every town": ["depot_turnover"],
    "draw metric:label_scan_pass_rate by week": ["label_scan_pass_rate"],
    "Put rail usage rate beside label scan pass rate": ["label_scan_pass_rate", "rail_usage_rate"],
    "Are the depots fine?": [], "Which deliveries went missing?": [], "And the rate?": [], "": [], "deliveries rate": [], "open the depots overview": [],
}


def test_named_metrics(spark):
    q = spark.createDataFrame([(t, t) for t in NAMED], "question_id string, question string")
    m = spark.createDataFrame([(e,) for e in STORED + STORED[:1]], "entity string")
    got = {}
    for r in questions.named_metrics(q, m).collect():
        got.setdefault(r.question_id, []).append(r.metric)
    assert {t: sorted(got.get(t, [])) for t in NAMED} == NAMED


DEFINITION = "**Road on time delivery rate**: parcels in `delivered_on_time` over parcels in `parcel_scanned`, after `convention:clean_rows` (`copy_id IS NULL` and `is_replayed != 1`)."
USAGE = "**Rail usage rate**: parcels in `rail_chosen` over parcels in `rail_offered` in one period. Split by `town`/`depot_kind`/`label_type` to see where rail is liked."
FULL = "Road on time delivery rate — delivered over parcel_scanned parcels, between 2026-01-01 and 2026-07-01, all depots"
WINDOW, DENOMINATOR = "time window = 2026-01-01 to 2026-07-01", "denominator = parcel_scanned parcels"
CLEAN = "apply convention:clean_rows (copy_id IS NULL, is_replayed != 1)"
ROAD = "Tell me the road on time delivery rate"
ASSUMED = [
    (FULL, [WINDOW, DENOMINATOR, "all depots included"], [], []),
    (FULL, [WINDOW, CLEAN], [], [CLEAN]),
    ("Are we fine?", ["past 30 days", DENOMINATOR, "all depots"], [], ["past 30 days", DENOMINATOR, "all depots"]),
    ("heavy parcels to Bergen by rail", ["segment: town_code = 'BGO'"], [], ["segment: town_code = 'BGO'"]),
    ("delivery between 2026-01-01 and 2026-07-01", [WINDOW, "denominator = rail_offered"], [], ["denominator = rail_offered"]),
    ("whatever", ["= 42"], [], ["= 42"]),
    ("q", ["b thing", "a thing"], [], ["b thing", "a thing"]),
    (ROAD, [DENOMINATOR, "apply clean rows filters (copy_id IS NULL, is_replayed != 1)", "every year"], [DEFINITION], ["apply clean rows filters (copy_id IS NULL, is_replayed != 1)", "every year"]),
    (ROAD, [DENOMINATOR, "every year"], [], [DENOMINATOR, "every year"]),
    (ROAD, ["segment: heavy parcels only"], [DEFINITION], ["segment: heavy parcels only"]),
    ("Do lost parcels count?", ["excluding lost parcels"], [], ["excluding lost parcels"]),
    ("delivery rate, exclude lost parcels", ["excluding lost parcels"], [], []),
    ("delivery rate without trial parcels", ["without trial parcels"], [], []),
    ("all depots", ["all depots included"], [], []),
    ("Tell me the rail usage rate", ["split by depot_kind"], [USAGE], ["split by depot_kind"]),
    ("Tell me the rail usage rate", ["denominator = rail_offered"], [USAGE], []),
    ("delivery rate, exclude our own trial parcels.", ["exclude our own trial parcels"], [], []),
    (ROAD, [DENOMINATOR, "every stored row"], [DEFINITION], ["every stored row"]),
]


def test_unstated_assumptions(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(ASSUMED)], "i int, q string, a array<string>, d array<string>")
    got = df.select("i", questions.unstated_assumptions(F.col("q"), F.col("a"), F.col("d")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [c[3] for c in ASSUMED]


@pytest.mark.parametrize("raw,want", [("one winter; all depots", ["one winter", "all depots"]), (" ; \n", []), ("a;b;c;d;e;f;g", list("abcdefg")), ("x" * 121, ["x" * 121])])
def test_assumption_cleanup(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(questions.split_assumptions(F.col("t"))).first()[0] == want


def test_spec_text(spark):
    body = "# S\n- `label_read` — Label scanned (`scan_tries`, `scan_ok`)\n* `x` - no\n## Questions to expect\n- Is **Rail** cheaper per `parcel`?\n-  is  rail cheaper per parcel?\n- short\n## Next\n- Does this stand in another section?"
    docs = spark.createDataFrame([("01", body)], "spec string, body string")
    assert [r.question for r in questions.suggested_questions(docs).collect()] == ["Is Rail cheaper per parcel?"]
    assert [(r.event, r.purpose) for r in questions.event_purposes(docs).collect()] == [("label_read", "Label scanned")]
