"""Citations, confidence and question analysis over the driver texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.text import first_sentence, numbers_in
from evidencelake.operators import citations, confidence, metrics, precision, questions
from evidencelake.operators.metrics import RateSpec
from evidencelake.plans.metric_queries import ORDER_FLAGS, order_flags
from evidencelake.plans.registry import Tables, query


def documents(t: Tables) -> DataFrame:
    return t.documents


@query("CIT1", r"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')) AS tok FROM documents)
SELECT doc_id, count(*) AS numbers_n, max(CAST(replace(tok, ',', '') AS DOUBLE)) AS largest FROM n GROUP BY doc_id""")
def numbers_in_texts(t: Tables) -> DataFrame:
    """Numbers written in every document, whole texts."""
    n = documents(t).select("doc_id", F.explode(numbers_in(F.col("text"))).alias("n"))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers_n"), F.max("n").alias("largest"))


def line_cells(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An answer per order: its lines are the rows of its one task."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    cell = lambda i, c: F.struct(F.lit(i).alias("position"), F.col(c).alias("value"))
    cells = t.lineitem.select(
        F.col("l_orderkey").alias("answer_id"), F.lit(0).alias("task_position"), row.alias("row_id"),
        F.array(cell(0, "l_quantity"), cell(1, "l_extendedprice"), cell(2, "l_discount")).alias("c"),
    ).select("answer_id", "task_position", "row_id", F.inline("c"))
    sizes = t.lineitem.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.count(F.lit(1)).alias("total_rows"))
    tasks = sizes.select("answer_id", F.lit(0).alias("task_position"), F.col("total_rows").alias("fetched_rows"), "total_rows")
    return cells, tasks


POOL_SQL = """
lr AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
raw AS (SELECT l_orderkey AS a, 0 AS k, 0 AS r, 0 AS p, CAST(c AS DOUBLE) AS v FROM lr
  UNION ALL SELECT l_orderkey, 0, 0, 2, CAST(c AS DOUBLE) FROM lr
  UNION ALL SELECT l_orderkey, 1, rn, 0, l_quantity FROM lr UNION ALL SELECT l_orderkey, 1, rn, 1, l_extendedprice FROM lr UNION ALL SELECT l_orderkey, 1, rn, 2, l_discount FROM lr),
scaled AS (SELECT a, k, r, p, 0 AS s, v FROM raw UNION ALL SELECT a, k, r, p, 1, v * 100 FROM raw WHERE k = 1 AND v BETWEEN -1 AND 1),
pool AS (SELECT a, v, min(k * 1000000 + r * 1000 + p * 10 + s) AS pos FROM scaled GROUP BY a, v)
"""


@query("CIT2", f"WITH {POOL_SQL} SELECT a AS answer_id, v AS value FROM pool")
def numeric_pool(t: Tables) -> DataFrame:
    """The figures each answer may cite: sizes, shown rows, fractions also as percentages."""
    return citations.numeric_pool(*line_cells(t)).select("answer_id", "value")


def uncited_sql(tokens: str, pool: str) -> str:
    """Brute force: every number against every figure and every pair of figures."""
    return f"""
{pool}, {tokens},
num AS (SELECT DISTINCT a, replace(tok, chr(1), '-') AS raw, CAST(replace(replace(tok, ',', ''), chr(1), '') AS DOUBLE) AS n FROM tok),
claim AS (SELECT * FROM num WHERE NOT (n = floor(n) AND abs(n) <= 12) AND NOT (n = floor(n) AND abs(n) BETWEEN 2020 AND 2030)),
few AS (SELECT a, v FROM pool WHERE pos < 99999999),
pairs AS (SELECT x.a, x.v - y.v AS d, CASE WHEN y.v != 0 THEN x.v / y.v END AS q, x.v = floor(x.v) AND y.v = floor(y.v) AS whole FROM few x JOIN few y ON x.a = y.a AND x.v != y.v
          WHERE x.a IN (SELECT a FROM claim)),
der AS (SELECT a, d AS v FROM pairs UNION ALL SELECT a, q FROM pairs WHERE q IS NOT NULL UNION ALL SELECT a, q * 100 FROM pairs WHERE whole AND q BETWEEN -1 AND 1),
cit AS (SELECT a, v FROM pool UNION ALL SELECT a, v FROM der)
SELECT DISTINCT a AS answer_id, raw FROM claim c WHERE NOT EXISTS (SELECT 1 FROM cit WHERE cit.a = c.a AND abs(c.n - cit.v) <= greatest(0.06, abs(cit.v) * 0.015))"""


_MARK = "regexp_replace(regexp_replace({x}, '([A-Za-z0-9_%)\\]])-([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([A-Za-z0-9_%)\\]])-([0-9])', '\\1' || chr(1) || '\\2', 'g')"
_TOKENS = "regexp_extract_all({x}, '[-\\x01]?[0-9][0-9,]*(?:\\.[0-9]+)?')"
DOC_TOKENS = f"tok AS (SELECT doc_id AS a, unnest({_TOKENS.format(x=_MARK.format(x='text'))}) AS tok FROM documents)"


@query("CIT5 CIT4 CIT2", "WITH " + uncited_sql(DOC_TOKENS, POOL_SQL))
def uncited_in_documents(t: Tables) -> DataFrame:
    """Numbers each document quotes that the order of the same key does not back."""
    texts = documents(t).select(F.col("doc_id").alias("answer_id"), F.lit("body").alias("section"), "text")
    return citations.uncited_numbers(texts, citations.numeric_pool(*line_cells(t)))


NARRATIVE = (
    "'Spent at most ' || CAST(CAST(mx AS DECIMAL(18,2)) AS {S}) || ' and at least ' || CAST(CAST(mn AS DECIMAL(18,2)) AS {S}) || ' over ' || CAST(n AS {S})"
    " || ' orders since ' || d || ', reviewed 2031-07-' || CAST(k % 15 + 13 AS {S}) || '; a gap of ' || CAST(CAST(mx - mn AS DECIMAL(18,2)) AS {S})"
    " || ', a claim of ' || CAST(k * 7 + 1000 AS {S}) || ' in a 33.9%-' || CAST(k % 50 + 40 AS {S}) || '.5% band, down -' || CAST(k % 90 + 13 AS {S}) || 'pp'"
)
CUSTOMER_POOL = """
lr AS (SELECT o_custkey AS ak, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
raw AS (SELECT ak AS a, 0 AS k, 0 AS r, 0 AS p, CAST(c AS DOUBLE) AS v FROM lr UNION ALL SELECT ak, 0, 0, 2, CAST(c AS DOUBLE) FROM lr
  UNION ALL SELECT ak, 1, rn, 0, o_totalprice FROM lr),
scaled AS (SELECT a, k, r, p, 0 AS s, v FROM raw UNION ALL SELECT a, k, r, p, 1, v * 100 FROM raw WHERE k = 1 AND v BETWEEN -1 AND 1),
pool AS (SELECT a, v, min(k * 1000000 + r * 1000 + p * 10 + s) AS pos FROM scaled GROUP BY a, v
         UNION ALL SELECT o_custkey, CAST(o_custkey * 7 + 1000 AS DOUBLE), 99999999 FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
"""
STORIES = f"""
st AS (SELECT o_custkey AS k, max(o_totalprice) AS mx, min(o_totalprice) AS mn, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS d FROM orders GROUP BY 1),
story AS (SELECT k AS a, replace({NARRATIVE.format(S="VARCHAR")}, d, ' ') AS text FROM st),
tok AS (SELECT a, unnest({_TOKENS.format(x=_MARK.format(x='text'))}) AS tok FROM story)
"""


def narratives(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts about each customer written from its orders, some claims made up; with pool, dates and asked numbers."""
    stats = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_totalprice").alias("mx"), F.min("o_totalprice").alias("mn"), F.count(F.lit(1)).alias("n"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("d"),
    )
    texts = stats.select(F.col("k").alias("answer_id"), F.lit("what").alias("section"), F.expr(NARRATIVE.format(S="STRING")).alias("text"))
    from pyspark.sql import Window

    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    rows = t.orders.select(
        F.col("o_custkey").alias("answer_id"), F.lit(0).alias("task_position"), F.lit(0).alias("position"),
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)) - 1).alias("row_id"),
        F.col("o_totalprice").alias("value"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("text"),
    )
    tasks = stats.select(F.col("k").alias("answer_id"), F.lit(0).alias("task_position"), F.col("n").alias("fetched_rows"), F.col("n").alias("total_rows"))
    asked = citations.asked_numbers(
        stats.filter("k % 3 = 0").select(F.col("k").alias("answer_id"), F.concat(F.lit("is it "), (F.col("k") * 7 + 1000).cast("string"), F.lit("?")).alias("question"))
    )
    return texts, citations.numeric_pool(rows, tasks), citations.date_literals(rows), asked


@query("CIT2 CIT3 CIT4 CIT5", "WITH " + uncited_sql(STORIES, CUSTOMER_POOL))
def uncited_numbers(t: Tables) -> DataFrame:
    """Made-up figures in narratives, dates and asked numbers respected.

    The oracle marks asked numbers by their position: citable, never paired.
    """
    return citations.uncited_numbers(*narratives(t))


@query("CIT5 CIT3", "WITH u AS (WITH " + uncited_sql(STORIES, CUSTOMER_POOL) + """)
SELECT o_custkey AS answer_id, count(DISTINCT raw) AS uncited_n, count(raw) = 0 AS passes FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN u ON answer_id = o_custkey GROUP BY 1""")
def citation_audit(t: Tables) -> DataFrame:
    """Every answer with its count of uncited numbers."""
    texts, pool, dates, asked = narratives(t)
    return citations.citation_audit(texts, citations.uncited_numbers(texts, pool, dates, asked))


@query("CIT6", r"""
WITH p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN n END) AS h, max(CASE WHEN turn = 1 THEN n END) AS w, max(CASE WHEN turn = 2 THEN n END) AS y, max(CASE WHEN turn = 3 THEN n END) AS a
  FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM conversations) GROUP BY 1)
SELECT conv_id, coalesce(w, '') != '' AND coalesce(y, '') != '' AND coalesce(a, '') != '' AND length(coalesce(y, '')) >= 60 AND NOT contains(coalesce(h, ''), coalesce(y, '')) AND NOT contains(coalesce(w, ''), coalesce(y, ''))
  AND NOT contains(coalesce(y, ''), coalesce(w, '')) AND length(coalesce(a, '')) >= 25 AS substantive FROM p""")
def section_checks(t: Tables) -> DataFrame:
    """Do the parts of each conversation say something the others do not?"""
    part = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    p = t.conversations.groupBy("conv_id").agg(*[F.coalesce(part(i), F.lit("")).alias(c) for i, c in enumerate("hwya")])
    return p.select("conv_id", citations.sections_substantive(F.col("h"), F.col("w"), F.col("y"), F.col("a")).alias("substantive"))


def confidence_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An answer per customer with one rate per priority and one over all; a tenth ships no denominators."""
    flags = order_flags(t, ("o_custkey", "o_orderpriority"))
    spec = [RateSpec("x", "returned", "ordered")]
    by_priority = metrics.rates(flags, spec, ["o_custkey", "o_orderpriority"]).select("o_custkey", F.lit("segment_rate").alias("c"), "x_rate", "x_n")
    overall = metrics.rates(flags, spec, ["o_custkey"]).select("o_custkey", F.lit("full_rate").alias("c"), "x_rate", "x_n")
    figures = by_priority.unionByName(overall)
    k = F.col("o_custkey")
    entry = F.map_from_arrays(
        F.array(F.col("c"), F.when(k % 10 == 0, "other").otherwise("n")), F.array("x_rate", F.col("x_n").cast("double"))
    )
    p = precision.precision(figures.select(k.alias("answer_id"), entry.alias("figures")), ["answer_id"])
    p = p.withColumn("half_width_pp", F.round("half_width_pp", 9))
    answers = overall.select(
        k.alias("answer_id"),
        F.when(k % 3 == 0, F.array(F.lit("full_rate"))).otherwise(F.array().cast("array<string>")).alias("headline_columns"),
        F.when(k % 3 == 1, "segment_rate").alias("verified_column"),
        (k % 4 != 0).alias("has_verification"), F.when(k % 4 == 1, True).when(k % 4 == 2, False).alias("agreed"),
        F.lit(0.053).alias("relative_delta"), (k % 5 != 0).alias("definition_ok"), F.when(k % 7 == 0, "fan-out").otherwise("").alias("concern"),
        F.lit("recomputed").alias("verify_note"), (k % 3).alias("impossible_flags"), (k % 2).alias("small_sample_flags"), (k % 6).alias("dropped_tasks"),
        F.lit(6).alias("planned_tasks"), (k % 3).alias("citation_retries"),
        F.transform(F.sequence(F.lit(1), k % 5 + 1), lambda i: F.concat(F.lit("a"), i.cast("string"))).alias("assumptions"),
        F.when(k % 8 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("named_metrics"),
    )
    return answers, p


CONFIDENCE_SQL = f"""
{ORDER_FLAGS},
fig AS (SELECT o_custkey AS k, 'segment_rate' AS col, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n FROM flags GROUP BY o_custkey, o_orderpriority
  UNION ALL SELECT o_custkey, 'full_rate', CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*), CAST(count(*) AS DOUBLE) FROM flags GROUP BY o_custkey),
wl AS (SELECT *, greatest(0, (p + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) AS lo,
        least(1, (p + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) AS hi FROM fig),
fw AS (SELECT k, col, p, n, round((hi - lo) / 2 * 100, 9) AS hw FROM wl WHERE k % 10 != 0),
best AS (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY k, col ORDER BY n DESC, hw DESC, p) = 1),
head AS (SELECT *, CASE WHEN k % 3 = 1 AND col = 'segment_rate' THEN 0 WHEN k % 3 = 0 AND col = 'full_rate' THEN 1 ELSE 2 END AS tier FROM best
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, CASE WHEN tier < 2 THEN hw ELSE n END DESC, col) = 1),
small AS (SELECT fw.k, sum(CASE WHEN fw.n < 50 OR fw.hw > 10 THEN 1 ELSE 0 END) - max(CASE WHEN head.n < 50 OR head.hw > 10 THEN 1 ELSE 0 END) AS s FROM fw JOIN head USING (k) GROUP BY 1),
f AS (SELECT a.k, h.hw, coalesce(s, 0) AS s, h.hw IS NULL AS unb FROM (SELECT DISTINCT k FROM fig) a LEFT JOIN head h USING (k) LEFT JOIN small USING (k)),
d AS (SELECT k, unb,
  CASE WHEN k % 4 = 2 THEN CASE WHEN unb THEN 0.44 ELSE 0.44 END WHEN k % 4 IN (0, 3) THEN CASE WHEN unb THEN 0.60 ELSE 0.70 END ELSE CASE WHEN unb THEN 0.60 ELSE 1.00 END END AS ceiling,
  coalesce(floor((CASE WHEN hw IS NULL THEN 0 WHEN hw <= 4 THEN 0.03 * hw WHEN hw <= 10 THEN 0.12 + 0.075 * (hw - 4) ELSE 0.57 + least(0.08, 0.008 * (hw - 10)) END) * 100 + 0.5) / 100, 0) AS head,
  least(0.12, 0.04 * s) AS sm, CASE WHEN unb THEN 0.10 ELSE 0 END AS noden, CASE WHEN unb AND k % 2 > 0 THEN 0.10 ELSE 0 END AS samp,
  CASE WHEN k % 4 != 0 AND k % 5 = 0 THEN 0.10 ELSE 0 END AS def, least(0.20, 0.10 * (k % 3)) AS imp, least(0.21, 0.07 * (k % 6)) AS drp, least(0.20, 0.10 * (k % 3)) AS ret,
  least(0.25, 0.08 * (k % 5 + 1)) AS asm FROM f),
e AS (SELECT k, ceiling, round(head + sm + noden + samp + def + imp + drp + ret + asm, 2) AS ded FROM d),
sc AS (SELECT k, greatest(0.05, round(ceiling - ded + CASE WHEN k % 8 = 0 THEN least(0.05, ded) ELSE 0 END, 2)) AS score FROM e)
"""


@query("CNF1 CNF2", f"""
WITH {CONFIDENCE_SQL}
SELECT k AS answer_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM sc""")
def confidence_scores(t: Tables) -> DataFrame:
    """Score and level of every answer."""
    return confidence.confidence(*confidence_inputs(t)).select("answer_id", "score", "level")


@query("CNF2", f"""
WITH {CONFIDENCE_SQL} SELECT k AS answer_id, CAST(score AS DOUBLE) AS total FROM sc""")
def confidence_sum_invariant(t: Tables) -> DataFrame:
    """One plus the deltas of the listed signals is the score, for every answer."""
    c = confidence.confidence(*confidence_inputs(t))
    total = F.aggregate("signals", F.lit(1).cast("decimal(12,2)"), lambda a, s: (a + s["delta"]).cast("decimal(12,2)"))
    return c.select("answer_id", total.cast("double").alias("total"))


@query("CNF2", f"""
WITH {CONFIDENCE_SQL}, x AS (SELECT d.*, f.hw, e.ded, k % 4 = 2 AS failed, k % 4 IN (0, 3) AS unverified, d.ceiling - ded + CASE WHEN k % 8 = 0 THEN least(0.05, ded) ELSE 0 END AS raw FROM d JOIN e USING (k) JOIN f USING (k)),
c AS (SELECT *, CASE WHEN failed THEN 0.44 WHEN unverified THEN 0.70 ELSE 1.00 END AS c1 FROM x),
s AS (SELECT k, unnest(list_filter([
  {{'name': 'verification_failed', 'told': failed, 'delta': c1 - 1}}, {{'name': 'unverified', 'told': unverified, 'delta': c1 - 1}}, {{'name': 'no_bounded_precision', 'told': unb, 'delta': ceiling - c1}},
  {{'name': 'headline_interval', 'told': hw IS NOT NULL, 'delta': -head}}, {{'name': 'small_segments', 'told': sm > 0, 'delta': -sm}}, {{'name': 'rates_without_denominator', 'told': noden > 0, 'delta': -noden}},
  {{'name': 'small_sample_flag', 'told': samp > 0, 'delta': -samp}}, {{'name': 'definition_concern', 'told': def > 0 OR (k % 4 != 0 AND k % 7 = 0), 'delta': -def}}, {{'name': 'impossible_values', 'told': imp > 0, 'delta': -imp}},
  {{'name': 'dropped_tasks', 'told': drp > 0, 'delta': -drp}}, {{'name': 'citation_retries', 'told': ret > 0, 'delta': -ret}}, {{'name': 'assumptions', 'told': asm > 0, 'delta': -asm}},
  {{'name': 'named_metric', 'told': k % 8 = 0, 'delta': least(0.05, ded)}}, {{'name': 'floor', 'told': raw < 0.05, 'delta': 0.05 - raw}}], lambda z: z.told)) AS z, k AS answer_id FROM c)
SELECT answer_id, z.name AS name, round(z.delta::DOUBLE, 2) AS delta FROM s""")
def confidence_signals(t: Tables) -> DataFrame:
    """The itemised signals behind each score, one row each."""
    c = confidence.confidence(*confidence_inputs(t))
    # the outer form keeps the optimiser from computing every signal a second time to test for emptiness
    rows = c.select("answer_id", F.posexplode_outer("signals").alias("position", "s")).filter(F.col("s").isNotNull())
    return rows.select("answer_id", "s.name", F.col("s.delta").cast("double").alias("delta"))


METRIC_IDS = """
b AS (SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 1)) AS w1, lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 2)) AS w2 FROM benchmark),
m AS (SELECT DISTINCT id, ws FROM (SELECT w1 || '_' || w2 AS id, [w1, w2] AS ws FROM b WHERE w1 != '' UNION ALL SELECT w1, [w1] FROM b WHERE w1 != ''))
"""


@query("CNF3", f"""
WITH {METRIC_IDS},
hit AS (SELECT doc_id, id, ws FROM documents, m WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || id || '($|[^a-z0-9])')
        OR len(list_filter(ws, lambda w: NOT regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '($|[^a-z0-9_])'))) = 0)
SELECT doc_id AS question_id, id AS metric FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.id != h.id AND len(list_distinct(o.ws)) > len(list_distinct(h.ws)) AND list_has_all(o.ws, h.ws))""")
def named_metrics(t: Tables) -> DataFrame:
    """Which stored metrics every text names, the most specific only."""
    word = lambda i: F.lower(F.regexp_extract("text", "^([A-Za-z]+) ([A-Za-z]+)", i))
    entity = F.explode(F.array(F.concat(F.lit("metric:"), word(1), F.lit("_"), word(2)), F.concat(F.lit("metric:"), word(1))))
    ids = t.benchmark.filter(word(1) != "").select(entity.alias("entity"))
    return questions.named_metrics(documents(t).select(F.col("doc_id").alias("question_id"), F.col("text").alias("question")), ids)


@query("CNF4", r"""
WITH a AS (SELECT doc_id, lower(text) AS text, unnest(['segment = ' || source, 'excluding the rows', 'window: last thereed']) AS assumption FROM documents),
tok AS (SELECT DISTINCT doc_id, CASE WHEN w IN ('without', 'excluding', 'excluded') THEN 'exclude' ELSE w END AS w FROM
  (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(lower(text), '[^a-z0-9_.-]+', ' ', 'g'), ' '), lambda x: regexp_replace(x, '^[.-]+|[.-]+$', '', 'g'))) AS w FROM documents) WHERE w != ''),
cw AS (SELECT doc_id, assumption, w FROM (SELECT doc_id, assumption, unnest(CASE WHEN assumption LIKE 'segment%' THEN [substr(assumption, 11)] WHEN assumption LIKE 'exc%' THEN ['exclude'] ELSE ['window', 'last', 'thereed'] END) AS w FROM a))
SELECT DISTINCT c.doc_id, assumption FROM cw c WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = c.doc_id AND (tok.w = c.w OR starts_with(tok.w, c.w || '_') OR ends_with(tok.w, '_' || c.w)))""")
def unstated_assumptions(t: Tables) -> DataFrame:
    """Assumptions no text states, over whole texts."""
    listed = F.array(F.concat(F.lit("segment = "), F.col("source")), F.lit("excluding the rows"), F.lit("window: last thereed"))
    kept = questions.unstated_assumptions(F.col("text"), listed)
    return documents(t).select("doc_id", F.explode(kept).alias("assumption"))


@query("CNF5", r"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[;\n]')) AS a, generate_subscripts(string_split_regex(text, '[;\n]'), 1) AS i FROM documents),
k AS (SELECT doc_id, trim(a, ' ') AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM s WHERE trim(a, ' ') != '')
SELECT doc_id, a AS assumption, CAST(rn - 1 AS INTEGER) AS position FROM k""")
def assumption_cleanup(t: Tables) -> DataFrame:
    """A text split at semicolons and line breaks into trimmed assumptions."""
    return documents(t).select("doc_id", F.posexplode(questions.split_assumptions(F.col("text"))).alias("position", "assumption"))


@query("KNO4", r"""
WITH f AS (SELECT doc_id, trim(replace(regexp_replace(text, '\n+', ' ', 'g'), '**', ''), ' ') AS flat FROM documents),
s AS (SELECT doc_id, flat, regexp_extract(flat, '^(.*?[.;])\s', 1) AS m FROM f)
SELECT doc_id, trim(CASE WHEN m != '' THEN m ELSE flat END, ' ') AS brief FROM s""")
def brief_definitions(t: Tables) -> DataFrame:
    """First sentence of each definition."""
    return documents(t).select("doc_id", first_sentence(F.col("text")).alias("brief"))


@query("PRO16", r"""
WITH b AS (SELECT conv_id, turn, trim(regexp_replace(replace(text, '`', ''), '\s+', ' ', 'g'), ' ') AS q FROM conversations),
k AS (SELECT lower(q) AS lq, min((lpad(CAST(conv_id AS VARCHAR), 8, '0'), turn, q)) AS m FROM b WHERE length(q) BETWEEN 15 AND 200 GROUP BY 1)
SELECT m[1] AS spec, m[3] AS question FROM k ORDER BY m LIMIT 12""")
def suggested_questions(t: Tables) -> DataFrame:
    """Bullets under a Questions heading, cleaned and deduplicated; the first twelve."""
    one_line = F.regexp_replace("text", r"\s+", " ")
    line = F.concat(F.lit("- "), one_line)
    # a conversation has few turns: its document is as long as its turns
    docs = t.conversations.groupBy(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("spec")).agg(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l")
    ).select("spec", F.concat(F.lit("# Spec\n## Questions\n"), F.array_join("l.line", "\n"), F.lit("\n## Next\n- not a question of this section")).alias("body"))
    return questions.suggested_questions(docs).select("spec", "question")


@query("PRO15", """
SELECT 'all' AS spec, 'supplier_' || s_suppkey AS event, s_name || ' ships goods' AS purpose FROM supplier""")
def event_purposes(t: Tables) -> DataFrame:
    """Event purposes from bulleted documents."""
    body = F.concat(F.lit("intro\n- `supplier_"), F.col("s_suppkey").cast("string"), F.lit("` — "), F.col("s_name"), F.lit(" ships `goods` (`nation`, `balance`)\nend"))
    return questions.event_purposes(t.supplier.select(F.lit("all").alias("spec"), body.alias("body")))
