"""Digests, precision, sanity and verification over results computed from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.stats import agrees, relative_delta
from evidencelake.operators import digest, metrics, precision, sanity, verify
from evidencelake.operators.metrics import RateSpec
from evidencelake.plans.metric_queries import ORDER_FLAGS, order_flags
from evidencelake.plans.registry import Tables, query


def customer_result(t: Tables) -> DataFrame:
    """A result with every kind of column: one row per customer that ordered."""
    flags = order_flags(t, ("o_custkey", "o_orderdate", "o_orderstatus"))
    r = metrics.rates(flags, [RateSpec("return", "returned", "ordered")], ["o_custkey"])
    extra = t.orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
        F.min("o_orderdate").alias("first_order"), F.min("o_orderstatus").alias("status"),
    )
    return r.join(extra, "o_custkey").select(
        F.col("o_custkey").cast("string").alias("customer"), "return_rate", "return_n", "spend", "first_order", "status"
    )


CUSTOMER_RESULT = f"""
{ORDER_FLAGS},
res AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS return_rate, count(*) AS return_n,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend, min(o_orderdate) AS first_order, min(o_orderstatus) AS status FROM flags GROUP BY o_custkey),
med AS (SELECT max(CASE WHEN ir = n // 2 + 1 THEN return_rate END) AS r50, max(CASE WHEN isp = n // 2 + 1 THEN spend END) AS s50 FROM
        (SELECT *, row_number() OVER (ORDER BY return_rate) AS ir, row_number() OVER (ORDER BY spend) AS isp, count(*) OVER () AS n FROM res))
"""
WIDE = """
SELECT count(*) AS total_rows, min(return_rate) AS return_rate_min, max(return_rate) AS return_rate_max, any_value(r50) AS return_rate_p50,
  CAST(sum(CASE WHEN return_rate > 1.05 THEN 1 ELSE 0 END) AS BIGINT) AS return_rate_gt1_n, round(sum(return_rate * return_n) / sum(return_n), 9) AS full_return_rate,
  CAST(sum(return_n) AS BIGINT) AS full_return_n, min(return_n) AS return_n_min, max(return_n) AS return_n_max, CAST(sum(return_n) AS BIGINT) AS full_return_n_sum,
  min(spend) AS spend_min, max(spend) AS spend_max, round(avg(spend), 4) AS spend_avg, any_value(s50) AS spend_p50,
  strftime(min(first_order), '%Y-%m-%d') AS first_order_min, strftime(max(first_order), '%Y-%m-%d') AS first_order_max,
  count(DISTINCT customer) AS customer_distinct, count(DISTINCT status) AS status_distinct FROM res, med
"""


def rounded_digest(t: Tables) -> DataFrame:
    w = digest.digest(customer_result(t))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return w.withColumns(
        {
            "full_return_rate": F.round("full_return_rate", 9), "spend_avg": F.round("spend_avg", 4),
            "first_order_min": day("first_order_min"), "first_order_max": day("first_order_max"),
        }
    )


@query("DIG1 DIG3 DIG4 DIG5 DIG6 DIG7 DIG8 DIG10 AGG2 AGG4 AGG5", f"WITH {CUSTOMER_RESULT} {WIDE}")
def digest_wide(t: Tables) -> DataFrame:
    """One row describing every row of the per-customer result."""
    return rounded_digest(t)


@query("DIG11", f"""
WITH {CUSTOMER_RESULT}, w AS ({WIDE}),
u AS (SELECT alias, number, NULL AS day FROM (SELECT columns(* EXCLUDE (first_order_min, first_order_max))::DOUBLE FROM w) UNPIVOT (number FOR alias IN (*))
  UNION ALL SELECT alias, NULL, day FROM (SELECT first_order_min, first_order_max FROM w) UNPIVOT (day FOR alias IN (*))),
l AS (SELECT CAST(position AS INTEGER) AS position, alias, "column", kind, stat, scope FROM w, (VALUES
 (0,'total_rows','','','total_rows','population'),(1,'return_rate_min','return_rate','rate','min','column'),(2,'return_rate_max','return_rate','rate','max','column'),
 (3,'return_rate_p50','return_rate','rate','p50','column'),(4,'return_rate_gt1_n','return_rate','rate','gt1_n','column'),(5,'full_return_rate','return_rate','rate','full_rate','population'),
 (6,'full_return_n','return_n','count','full_n','population'),(7,'return_n_min','return_n','count','min','column'),(8,'return_n_max','return_n','count','max','column'),
 (9,'full_return_n_sum','return_n','count','sum','population'),(10,'spend_min','spend','numeric','min','column'),(11,'spend_max','spend','numeric','max','column'),
 (12,'spend_avg','spend','numeric','avg','column'),(13,'spend_p50','spend','numeric','p50','column'),(14,'first_order_min','first_order','temporal','min','column'),
 (15,'first_order_max','first_order','temporal','max','column'),(16,'customer_distinct','customer','categorical','distinct','column'),(17,'status_distinct','status','categorical','distinct','column')
) v(position, alias, "column", kind, stat, scope) WHERE total_rows > 0)
SELECT l.*, CASE WHEN alias IN ('first_order_min', 'first_order_max') THEN NULL ELSE u.number END AS number, CASE WHEN alias IN ('first_order_min', 'first_order_max') THEN u.day END AS day FROM l JOIN u USING (alias)""")
def digest_long(t: Tables) -> DataFrame:
    """The digest split into population figures and per-column figures."""
    r = customer_result(t)
    long = digest.digest_long(rounded_digest(t), digest.classify_columns(r.schema))
    dated = F.col("kind") == "temporal"
    number, day = F.when(~dated, F.col("value").cast("double")), F.when(dated, F.col("value"))
    return long.filter(F.col("value").isNotNull()).select("position", "alias", "column", "kind", "stat", "scope", number.alias("number"), day.alias("day"))


@query("DIG9 TOP3", f"""
WITH {CUSTOMER_RESULT},
r AS (SELECT *, row_number() OVER (ORDER BY return_rate DESC, customer) AS hi, row_number() OVER (ORDER BY return_rate, customer) AS lo FROM res)
SELECT customer, return_rate, return_n, spend, 'top' AS "end", CAST(hi AS INTEGER) AS position FROM r WHERE hi <= 5
UNION ALL SELECT customer, return_rate, return_n, spend, 'bottom', CAST(lo AS INTEGER) FROM r WHERE lo <= 5""")
def digest_extremes(t: Tables) -> DataFrame:
    """The extreme rows by the metric the digest chooses: the weighted rate."""
    return digest.digest_extremes(customer_result(t)).select("customer", "return_rate", "return_n", "spend", "end", "position")


@query("DIG12", f"""
WITH {ORDER_FLAGS}, small AS (SELECT o_custkey, 1.0 + max(o_totalprice) / 1000000 AS odd_rate, count(*) AS orders_n FROM flags GROUP BY 1),
w AS (SELECT count(*) AS n, sum(CASE WHEN odd_rate > 1.05 THEN 1 ELSE 0 END) AS g, max(orders_n) AS m FROM small)
SELECT 'impossible' AS kind, 'odd_rate exceeds 100% in ' || CAST(g AS BIGINT) || ' of ' || n || ' rows of the whole result' AS flag FROM w WHERE g > 0
UNION ALL SELECT 'small_sample', 'no sample in any of ' || n || ' rows reaches 50: weak evidence' FROM w WHERE m < 50""")
def digest_flags(t: Tables) -> DataFrame:
    """Impossible rates anywhere and samples small everywhere."""
    r = t.orders.groupBy("o_custkey").agg((F.max("o_totalprice") / 1000000 + 1.0).alias("odd_rate"), F.count(F.lit(1)).alias("orders_n"))
    r = r.select(F.col("o_custkey").cast("string").alias("customer"), "odd_rate", "orders_n")
    kinds = digest.classify_columns(r.schema)
    return digest.digest_flags(digest.digest(r), kinds)


@query("DIG13", f"""
WITH {CUSTOMER_RESULT}
SELECT 'return_rate' AS "column", CASE WHEN max(abs(return_rate)) <= 1.05 THEN 'fraction' ELSE 'percent' END AS format FROM res
UNION ALL SELECT 'return_n', CASE WHEN max(return_n) = floor(max(return_n)) THEN 'count' ELSE 'number' END FROM res
UNION ALL SELECT 'spend', CASE WHEN max(abs(spend)) = floor(max(abs(spend))) THEN 'count' ELSE 'number' END FROM res""")
def value_formats(t: Tables) -> DataFrame:
    """Format hints from names and magnitudes."""
    return digest.infer_formats(customer_result(t))


@query("DIG2", """
SELECT 'k' AS "column", CASE WHEN count(*) FILTER (WHERE try_cast(o_orderkey AS DOUBLE) IS NULL) = 0 THEN 'numeric' ELSE 'other' END AS kind FROM orders
UNION ALL SELECT 'priority', CASE WHEN count(*) FILTER (WHERE try_cast(o_orderpriority AS DOUBLE) IS NOT NULL) = 0 THEN 'categorical' ELSE 'other' END FROM orders
UNION ALL SELECT 'day', CASE WHEN count(*) FILTER (WHERE o_orderdate IS NULL) = 0 THEN 'temporal' ELSE 'other' END FROM orders
UNION ALL SELECT 'mixed', 'other'""")
def text_column_kinds(t: Tables) -> DataFrame:
    """Kinds of all-text columns, judged on every row."""
    o = t.orders.select(
        F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"),
        F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("1.5").alias("mixed"),
    )
    return digest.classify_text_columns(o)


def many_results(t: Tables) -> DataFrame:
    """One result per ship year: a row per part with a rate, its sample and a text, as long cells."""
    wide = t.lineitem.groupBy(F.year("l_shipdate").cast("string").alias("task_id"), F.col("l_partkey").alias("row_id")).agg(
        F.count(F.lit(1)).alias("back_n"), F.count_if(F.col("l_returnflag") == "R").alias("h"), F.min("l_linestatus").alias("status"),
        F.max("l_quantity").alias("quantity"),
    )
    cells = F.array(
        F.struct(F.lit(0).alias("position"), F.lit("back_rate").alias("column"), (F.col("h") / F.col("back_n")).cast("string").alias("value")),
        F.struct(F.lit(1).alias("position"), F.lit("back_n").alias("column"), F.col("back_n").cast("string").alias("value")),
        F.struct(F.lit(2).alias("position"), F.lit("quantity").alias("column"), F.col("quantity").cast("string").alias("value")),
        F.struct(F.lit(3).alias("position"), F.lit("status").alias("column"), F.col("status").alias("value")),
    )
    return wide.select("task_id", "row_id", F.inline(cells))


@query("DIG2 DIG4 DIG5 DIG6 DIG7 DIG11", """
WITH p AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS task_id, l_partkey, count(*) AS n, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS r, min(l_linestatus) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY r) AS ir, row_number() OVER (PARTITION BY task_id ORDER BY q) AS iq, count(*) OVER (PARTITION BY task_id) AS c FROM p),
w AS (SELECT task_id, min(r) AS rmin, max(r) AS rmax, max(CASE WHEN ir = c // 2 + 1 THEN r END) AS r50, sum(CASE WHEN r > 1.05 THEN 1 ELSE 0 END) AS gt1, sum(r*n)/sum(n) AS fr, sum(n) AS fn,
        min(n) AS nmin, max(n) AS nmax, min(q) AS qmin, max(q) AS qmax, avg(q) AS qavg, max(CASE WHEN iq = c // 2 + 1 THEN q END) AS q50, count(DISTINCT s) AS sd FROM i GROUP BY 1)
SELECT task_id, col AS "column", kind, stat, round(CAST(v AS DOUBLE), 6) AS value FROM (
 SELECT task_id, 'back_rate' AS col, 'rate' AS kind, 'min' AS stat, rmin AS v FROM w UNION ALL SELECT task_id, 'back_rate', 'rate', 'max', rmax FROM w UNION ALL SELECT task_id, 'back_rate', 'rate', 'p50', r50 FROM w
 UNION ALL SELECT task_id, 'back_rate', 'rate', 'gt1_n', gt1 FROM w UNION ALL SELECT task_id, 'back_rate', 'rate', 'full_rate', fr FROM w UNION ALL SELECT task_id, 'back_rate', 'rate', 'full_n', fn FROM w
 UNION ALL SELECT task_id, 'back_n', 'count', 'min', nmin FROM w UNION ALL SELECT task_id, 'back_n', 'count', 'max', nmax FROM w UNION ALL SELECT task_id, 'back_n', 'count', 'sum', fn FROM w
 UNION ALL SELECT task_id, 'quantity', 'numeric', 'min', qmin FROM w UNION ALL SELECT task_id, 'quantity', 'numeric', 'max', qmax FROM w UNION ALL SELECT task_id, 'quantity', 'numeric', 'avg', qavg FROM w
 UNION ALL SELECT task_id, 'quantity', 'numeric', 'p50', q50 FROM w UNION ALL SELECT task_id, 'status', 'categorical', 'distinct', sd FROM w)""")
def digest_many_results(t: Tables) -> DataFrame:
    """Digests of one result per ship year, all in one job."""
    d = digest.digest_many(many_results(t))
    return d.withColumn("value", F.round(F.col("value").cast("double"), 6))


PRECISION_INPUT = f"""
{ORDER_FLAGS},
seg AS (SELECT o_custkey, sum(CASE WHEN returned THEN 1 ELSE 0 END) / count(*) AS return_rate, count(*) AS return_n, sum(CASE WHEN fulfilled THEN 1 ELSE 0 END) / count(*) AS fulfil_rate,
        count(*) / 10 AS group_ratio, avg(o_totalprice) AS price_avg FROM flags GROUP BY 1)
"""


def precision_input(t: Tables) -> DataFrame:
    flags = order_flags(t, ("o_custkey", "o_totalprice"))
    wide = flags.groupBy("o_custkey").agg(
        F.try_divide(F.count_if("returned").cast("double"), F.count(F.lit(1)).cast("double")).alias("return_rate"), F.count(F.lit(1)).alias("return_n"),
        F.try_divide(F.count_if("fulfilled").cast("double"), F.count(F.lit(1)).cast("double")).alias("fulfil_rate"),
        (F.count(F.lit(1)) / 10).alias("group_ratio"), F.avg("o_totalprice").alias("price_avg"),
    )
    packed = precision.figures_map(wide.select(F.col("o_custkey").cast("string").alias("answer_id"), "return_rate", "return_n", "fulfil_rate", "group_ratio", "price_avg"))
    return packed.select("answer_id", "figures")


PRECISION_SQL = """
b AS (SELECT o_custkey, CAST(return_n AS DOUBLE) AS n, return_rate AS p FROM seg),
wil AS (SELECT o_custkey, n, p, greatest(0, (p + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) AS lo,
        least(1, (p + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) AS hi FROM b),
prec AS (SELECT CAST(o_custkey AS VARCHAR) AS answer_id, 'return_rate' AS "column", 'proportion' AS kind, p AS value, n, lo, hi, (hi - lo) / 2 * 100 AS half_width_pp FROM wil
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'fulfil_rate', 'proportion', fulfil_rate, NULL, NULL, NULL, NULL FROM seg
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'group_ratio', CASE WHEN group_ratio <= 1.0001 THEN 'proportion' ELSE 'ratio' END, group_ratio, NULL, NULL, NULL, NULL FROM seg
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'price_avg', 'mean', price_avg, NULL, NULL, NULL, NULL FROM seg)
"""


@query("PRC1 PRC2 PRC3 PRC4", f"""
WITH {PRECISION_INPUT}, {PRECISION_SQL}
SELECT answer_id, "column", kind, round(value, 4) AS value, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(half_width_pp, 4) AS half_width_pp,
  n IS NOT NULL AS bounded FROM prec""")
def precision_rows(t: Tables) -> DataFrame:
    """Precision of every figure of every row: proportions bounded by their own denominator, the rest with a reason."""
    p = precision.precision(precision_input(t), ["answer_id"], aggregates={"price_avg": "avg"})
    return p.select(
        "answer_id", "column", "kind", F.round("value", 4).alias("value"), "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"),
        F.round("half_width_pp", 4).alias("half_width_pp"), F.col("n").isNotNull().alias("bounded"),
    )


def headline_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Many bounded figures per answer (a nation): one rate per customer of the nation and one over all of it."""
    flags = order_flags(t, ("o_custkey",)).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    spec = [RateSpec("return", "returned", "ordered")]
    seg = metrics.rates(flags, spec, ["c_nationkey", "o_custkey"]).select(
        F.col("c_nationkey").alias("answer_id"), F.col("return_rate").alias("segment_rate"), F.col("return_n").alias("segment_n")
    )
    full = metrics.rates(flags, spec, ["c_nationkey"]).select(
        F.col("c_nationkey").alias("answer_id"), F.col("return_rate").alias("full_return_rate"), F.col("return_n").alias("full_return_n")
    )
    rows = [precision.figures_map(d.withColumn("answer_id", F.col("answer_id").cast("string"))).select("answer_id", "figures") for d in (seg, full)]
    p = precision.precision(rows[0].unionByName(rows[1]), ["answer_id"])
    k = F.col("n_nationkey")
    answers = t.nation.select(
        k.cast("string").alias("answer_id"), k,
        F.when(k % 3 == 0, F.array(F.lit("full_return_rate"))).otherwise(F.array().cast("array<string>")).alias("headline_columns"),
        F.when(k % 3 == 1, "segment_rate").alias("verified_column"),
    )
    return p, answers


HEADLINE_SQL = f"""
{ORDER_FLAGS},
base AS (SELECT c_nationkey AS k, o_custkey, returned FROM flags JOIN customer ON c_custkey = o_custkey),
fig AS (SELECT k, 'segment_rate' AS col, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n FROM base GROUP BY k, o_custkey
  UNION ALL SELECT k, 'full_return_rate', CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*), CAST(count(*) AS DOUBLE) FROM base GROUP BY k),
wl AS (SELECT *, greatest(0, (p + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) AS lo,
        least(1, (p + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n))) AS hi FROM fig),
fw AS (SELECT *, (hi - lo) / 2 * 100 AS hw FROM wl),
best AS (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY k, col ORDER BY n DESC, round(hw, 9) DESC, p) = 1),
head AS (SELECT *, CASE WHEN k % 3 = 1 AND col = 'segment_rate' THEN 0 WHEN k % 3 = 0 AND col = 'full_return_rate' THEN 1 ELSE 2 END AS tier FROM best
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, CASE WHEN tier < 2 THEN hw ELSE n END DESC, col) = 1)
"""


@query("PRC5 AGG17", f"""
WITH {HEADLINE_SQL} SELECT CAST(k AS VARCHAR) AS answer_id, col AS "column", n, round(hw, 6) AS half_width_pp FROM head""")
def headline_choice(t: Tables) -> DataFrame:
    """The figure each answer rests on."""
    p, answers = headline_inputs(t)
    # equal widths must tie in both engines
    p = p.withColumn("half_width_pp", F.round("half_width_pp", 9))
    return precision.pick_headline(p, answers).select("answer_id", "column", "n", F.round("half_width_pp", 6).alias("half_width_pp"))


@query("AGG17 PRC6", f"""
WITH {HEADLINE_SQL},
pick AS (SELECT *, CASE WHEN k % 3 = 0 AND col = 'full_return_rate' THEN n ELSE round(hw, 9) END AS strength FROM fw)
SELECT CAST(k AS VARCHAR) AS answer_id, col AS "column", n, round(hw, 6) AS half_width_pp FROM pick
QUALIFY row_number() OVER (PARTITION BY k, col ORDER BY strength DESC, p, n DESC) = 1""")
def widest_figures(t: Tables) -> DataFrame:
    """One representative interval per column of an answer, gathered from all its roles."""
    p, answers = headline_inputs(t)
    p = p.withColumn("half_width_pp", F.round("half_width_pp", 9))
    seg, full = p.filter("column = 'segment_rate'"), p.filter("column = 'full_return_rate'")
    everything = precision.collect_precision(seg.filter("n >= 0"), full, seg.filter("n < 0"))
    return precision.widest_per_column(everything, answers).select("answer_id", "column", "n", F.round("half_width_pp", 6).alias("half_width_pp"))


@query("PRC7", f"""
WITH {ORDER_FLAGS}, r AS (SELECT o_custkey, o_orderpriority, sum(CASE WHEN returned THEN 1 ELSE 0 END) / count(*) AS p, count(*) AS n FROM flags GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS i FROM r)
SELECT CAST(o_custkey AS VARCHAR) AS answer_id, string_agg('r' || i || '_rate=' || printf('%.1f', round(p * 100, 1)) || '% (n=' || n || ')', '; ' ORDER BY i) AS figures FROM k WHERE i <= 6 GROUP BY o_custkey""")
def carried_figures(t: Tables) -> DataFrame:
    """What each answer already told, as one line."""
    r = metrics.rates(order_flags(t, ("o_custkey", "o_orderpriority")), [RateSpec("x", "returned", "ordered")], ["o_custkey", "o_orderpriority"])
    from evidencelake.operators.joins import first_per_key
    from pyspark.sql import Window

    kept = first_per_key(r, ["o_custkey"], [F.col("o_orderpriority")], precision.FIGURES_CARRIED)
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority"))
    p = kept.select(
        F.col("o_custkey").cast("string").alias("answer_id"), i.alias("position"), F.concat(F.lit("r"), i.cast("string"), F.lit("_rate")).alias("column"),
        F.lit("proportion").alias("kind"), F.round("x_rate", 3).alias("value"), F.col("x_n").cast("double").alias("n"),
    )
    return precision.established_figures(p)


def sanity_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A task per part and year: the result's cells, some with a rate above one, some blocked, some missing."""
    rows = t.lineitem.groupBy(F.col("l_partkey"), F.year("l_shipdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("d")
    )
    blocked = F.col("l_partkey") % 97 == 0
    cell = lambda c, num, txt: F.struct(F.lit(c).alias("column"), num.cast("double").alias("value_num"), txt.cast("string").alias("value_str"))
    cells = F.when(
        blocked, F.array(cell("blocked", F.lit(1), F.lit("1")), cell("reason", F.lit(None), F.lit("no such column")))
    ).otherwise(
        F.array(cell("fill_rate", F.col("q") / 48, F.col("q")), cell("lines_n", F.col("n"), F.col("n")), cell("d", F.col("d"), F.col("d")))
    )
    results = rows.select(
        (F.col("l_partkey") % 50).cast("string").alias("answer_id"), F.col("l_partkey").cast("string").alias("task_id"), F.col("y").alias("row_id"), F.inline(cells)
    )
    task = t.part.select((F.col("p_partkey") % 50).cast("string").alias("answer_id"), F.col("p_partkey").cast("string").alias("task_id"))
    # tasks beyond the parts, whose results are empty
    empty = task.filter("task_id % 10 = 9").withColumn("task_id", F.concat(F.lit("none_"), "task_id"))
    return task.unionByName(empty), results


SANITY_SQL = """
r AS (SELECT l_partkey AS k, year(l_shipdate) AS y, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
tasks AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS task_id FROM part UNION ALL SELECT p_partkey, 'none_' || p_partkey FROM part WHERE p_partkey % 10 = 9),
g AS (SELECT k, count(DISTINCT CASE WHEN q / 48 > 1.05 THEN q END) AS imp, CASE WHEN max(n) < 50 THEN 1 ELSE 0 END AS sm FROM r GROUP BY 1),
gate AS (SELECT tasks.k, task_id, g.k IS NULL OR tasks.k % 97 = 0 AS dropped, CASE WHEN g.k IS NULL THEN 'empty result set' WHEN tasks.k % 97 = 0 THEN 'not computable: no such column' END AS drop_reason,
   CASE WHEN g.k IS NULL OR tasks.k % 97 = 0 THEN 0 ELSE imp END AS imp, CASE WHEN g.k IS NULL OR tasks.k % 97 = 0 THEN 0 ELSE sm END AS sm FROM tasks LEFT JOIN g ON CAST(g.k AS VARCHAR) = task_id)
"""


@query("SAN1", f"""
WITH {SANITY_SQL}
SELECT CAST(k % 50 AS VARCHAR) AS answer_id, task_id, dropped, drop_reason, CAST(imp AS BIGINT) AS impossible_n, CAST(sm AS BIGINT) AS small_sample_n FROM gate""")
def sanity_gate(t: Tables) -> DataFrame:
    """Every planned task: dropped with its reason, or kept with its flags."""
    tasks, results = sanity_inputs(t)
    return sanity.sanity_gate(tasks, results)


@query("SAN1", """
WITH r AS (SELECT l_partkey AS k, year(l_shipdate) AS y, max(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_partkey % 97 != 0 GROUP BY 1, 2)
SELECT DISTINCT CAST(k % 50 AS VARCHAR) AS answer_id, CAST(k AS VARCHAR) AS task_id, 'small_sample' AS kind, 'no sample reaches 50: weak evidence' AS flag FROM r GROUP BY k HAVING max(n) < 50""")
def sanity_small_samples(t: Tables) -> DataFrame:
    """The small-sample flags; the rate column here is one a digest answered for."""
    tasks, results = sanity_inputs(t)
    digested = results.filter("column = 'fill_rate'").select("answer_id", "task_id", "column").distinct()
    return sanity.sanity_flags(results, digested)


@query("SAN3", f"""
WITH {SANITY_SQL}
SELECT CAST(k % 50 AS VARCHAR) AS answer_id, CAST(sum(imp) AS BIGINT) AS impossible_flags, CAST(sum(sm) AS BIGINT) AS small_sample_flags,
 CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS dropped_tasks, count(*) AS planned_tasks FROM gate GROUP BY k % 50""")
def sanity_counts(t: Tables) -> DataFrame:
    """Flag counts by kind, per answer."""
    tasks, results = sanity_inputs(t)
    return sanity.sanity_counts(sanity.sanity_gate(tasks, results))


@query("SAN2", """
WITH e AS (SELECT o_custkey, bool_or(o_totalprice > 450000) AS any_value FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS answer_id, coalesce(any_value, false) AS has_evidence FROM customer LEFT JOIN e ON o_custkey = c_custkey""")
def evidence_test(t: Tables) -> DataFrame:
    """Did an answer's results hold anything other than zeros and blanks?"""
    results = t.orders.select(
        F.col("o_custkey").cast("string").alias("answer_id"), F.when(F.col("o_totalprice") > 450000, F.col("o_totalprice")).otherwise(0.0).alias("value_num"),
        F.lit("").alias("value_str"),
    )
    return sanity.has_evidence(results, t.customer.select(F.col("c_custkey").cast("string").alias("answer_id")))


@query("VER1 VER2", """
WITH a AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL),
b AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, CAST(sum(CAST(CASE WHEN o_custkey % 40 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(18,2))) AS DOUBLE) AS w FROM orders WHERE year(o_orderdate) > 1992 GROUP BY ALL)
SELECT coalesce(a.p, b.p) AS o_orderpriority, CAST(coalesce(a.y, b.y) AS INTEGER) AS y, v AS value, w AS verified_value, round(abs(v - w) / greatest(abs(v), abs(w), 1e-9), 9) AS relative_delta,
 CASE WHEN v IS NULL OR w IS NULL THEN 'inconclusive' WHEN abs(v - w) <= greatest(0, greatest(abs(v), abs(w), 1e-9) * 0.02) THEN 'agreed' ELSE 'disagreed' END AS verdict
FROM a FULL JOIN b ON a.p = b.p AND a.y = b.y""")
def cross_check(t: Tables) -> DataFrame:
    """Order totals recomputed independently, with the verdict per figure."""
    o = t.orders.withColumn("y", F.year("o_orderdate"))
    total = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double").alias("v")
    a = o.groupBy("o_orderpriority", "y").agg(total(F.col("o_totalprice")))
    b = o.filter("y > 1992").groupBy("o_orderpriority", "y").agg(total(F.when(F.col("o_custkey") % 40 == 0, 0.0).otherwise(F.col("o_totalprice"))))
    return verify.verify(a, b, ["o_orderpriority", "y"], "v").withColumn("relative_delta", F.round("relative_delta", 9))


@query("VER1", """
SELECT o_orderkey, CASE WHEN abs(a) <= 1 AND abs(b) <= 1 THEN abs(a - b) <= greatest(0.005, greatest(abs(a), abs(b), 1e-9) * 0.02) ELSE abs(a - b) <= greatest(abs(a), abs(b), 1e-9) * 0.02 END AS agree,
 round(abs(a - b) / greatest(abs(a), abs(b), 1e-9), 9) AS delta FROM (SELECT o_orderkey, o_totalprice / 100000 AS a, (o_totalprice + o_custkey) / 100000 AS b FROM orders)""")
def agree_check(t: Tables) -> DataFrame:
    """The agreement predicate over every order."""
    a, b = F.col("o_totalprice") / 100000, (F.col("o_totalprice") + F.col("o_custkey")) / 100000
    return t.orders.select("o_orderkey", agrees(a, b).alias("agree"), F.round(relative_delta(a, b), 9).alias("delta"))


@query("VER4", """
WITH f AS (SELECT l_orderkey, arg_min(l_tax, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS f, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT l.l_orderkey, any_value(n) AS n, any_value(f) AS f, bool_and(abs(l_tax - f) <= greatest(0.005, greatest(abs(l_tax), abs(f), 1e-9) * 0.02)) AS same FROM lineitem l JOIN f USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, n AS rows_n, CASE WHEN n = 1 OR same THEN f END AS verified_value, NOT (n = 1 OR same) AS inconclusive FROM s""")
def single_value_read(t: Tables) -> DataFrame:
    """One figure per order when its rows agree, none when they differ."""
    position = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return verify.single_value(t.lineitem.withColumn("position", position), ["l_orderkey"], "l_tax")


@query("VER3", """
WITH d AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
c AS (SELECT k, s, n, CASE WHEN k % 4 = 0 THEN 'full_spend_sum' WHEN k % 4 = 1 THEN 'spend' WHEN k % 4 = 2 THEN '' ELSE 'spend' END AS e, CASE WHEN k % 4 = 2 THEN n WHEN k % 4 = 3 THEN s * 1.5 ELSE s * 1.01 END AS v FROM d),
m AS (SELECT *, (v > 1.0001 AND abs(v - s) <= greatest(v, s) * 0.02) AS ms, (v > 1.0001 AND abs(v - n) <= greatest(v, n) * 0.02) AS mn, (v <= 1.0001) AS unit FROM c)
SELECT CAST(k AS VARCHAR) AS check_id, CASE WHEN e = 'full_spend_sum' THEN e WHEN unit THEN NULL WHEN ms AND mn THEN NULL WHEN ms THEN 'full_spend_sum' WHEN mn THEN 'full_orders_n' END AS resolved_column,
 CASE WHEN e = 'full_spend_sum' THEN s WHEN unit THEN NULL WHEN ms AND mn THEN NULL WHEN ms THEN s WHEN mn THEN n END AS resolved_value,
 CASE WHEN e = 'full_spend_sum' THEN 'name' WHEN unit THEN NULL WHEN ms AND mn THEN NULL WHEN ms OR mn THEN 'value' END AS matched_by FROM m""")
def figure_resolution(t: Tables) -> DataFrame:
    """Which figure of each customer's digest an independent value reproduces, by name or by value."""
    d = t.orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n")
    )
    k, s, n = F.col("o_custkey"), F.col("s"), F.col("n")
    figure = lambda name, v: F.struct(F.lit(name).alias("column"), v.alias("value"))
    figures = d.select(k.cast("string").alias("check_id"), F.lit("digest").alias("origin"), F.lit(0).alias("row_id"), F.inline(F.array(figure("full_spend_sum", s), figure("full_orders_n", n))))
    checks = d.select(
        k.cast("string").alias("check_id"), F.when(k % 4 == 0, "full_spend_sum").when(k % 4 == 2, "").otherwise("spend").alias("expected"),
        F.when(k % 4 == 2, n).when(k % 4 == 3, s * 1.5).otherwise(s * 1.01).alias("verified_value"), F.lit(0).alias("rows_n"),
    )
    return verify.resolve_figure(figures, checks)


@query("VER5", """
WITH tk AS (SELECT o_custkey AS a, o_orderkey AS k, o_orderkey % 3 AS rc, o_orderkey % 11 AS rows FROM orders)
SELECT CAST(a AS VARCHAR) AS answer_id, CAST(k AS VARCHAR) AS task_id, rc AS rate_columns, rows AS total_rows FROM tk WHERE rows > 0
QUALIFY row_number() OVER (PARTITION BY a ORDER BY rc DESC, rows DESC, k) = 1""")
def task_to_verify(t: Tables) -> DataFrame:
    """Per answer, the task with most rate columns, then most rows."""
    k = F.col("o_orderkey")
    key = [F.col("o_custkey").cast("string").alias("answer_id"), k.cast("string").alias("task_id")]
    columns = t.orders.select(*key, F.explode(F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.when(i == 0, "city").otherwise(F.concat(F.lit("x"), i.cast("string"), F.lit("_rate"))))).alias("column"))
    tasks = t.orders.select(*key, k.alias("position"), (k % 11).alias("total_rows"))
    return verify.task_to_verify(columns, tasks).select("answer_id", "task_id", "rate_columns", "total_rows")
