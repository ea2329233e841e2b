"""Rates, funnels, hygiene, joins, aggregates and limits over the driver tables.

Stand-ins: an order is an application, its stages are having a fulfilled line and having a returned line; an
``events`` row is an event of a user; every 33rd event is a duplicate copy and every 50th a backfilled row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.stats import half_width_pp, wilson
from evidencelake.operators import hygiene, joins, metrics, quantiles, topk
from evidencelake.operators.metrics import RateSpec
from evidencelake.plans.registry import Tables, query


def order_flags(t: Tables, by: tuple[str, ...] = ("o_orderpriority",)) -> DataFrame:
    """One row per order: has a fulfilled line, has a returned line. Lines are reduced before the join."""
    lines = metrics.key_flags(
        t.lineitem, "l_orderkey",
        {"fulfilled": F.col("l_linestatus") == "F", "returned": F.col("l_returnflag") == "R"},
    )
    orders = t.orders.select("o_orderkey", *by)
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .drop("l_orderkey")
        .withColumn("ordered", F.lit(True))
        .fillna({"fulfilled": False, "returned": False})
    )


ORDER_FLAGS = """
lines AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS fulfilled, bool_or(l_returnflag = 'R') AS returned
          FROM lineitem GROUP BY l_orderkey),
flags AS (SELECT o.*, coalesce(l.fulfilled, false) AS fulfilled, coalesce(l.returned, false) AS returned
          FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey)
"""

RETURN_RATE = [RateSpec("return", "returned", "ordered")]


@query("MET9 AGG1 AGG3 JON3", f"""
WITH {ORDER_FLAGS}
SELECT o_orderpriority, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS BIGINT) AS return_hits, count(*) AS return_n,
       sum(CASE WHEN returned THEN 1 ELSE 0 END) / count(*) AS return_rate
FROM flags GROUP BY o_orderpriority""")
def rate_by_segment(t: Tables) -> DataFrame:
    """Share of orders with a returned line, by priority."""
    return metrics.rates(order_flags(t), RETURN_RATE, ["o_orderpriority"])


@query("PRC2 PRC4 MET9", f"""
WITH {ORDER_FLAGS},
r AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p
      FROM flags GROUP BY o_orderpriority),
w AS (SELECT *, (p + 3.8416/(2*n)) / (1 + 3.8416/n) AS c, 1.96/(1 + 3.8416/n) * sqrt(p*(1-p)/n + 3.8416/(4*n*n)) AS h FROM r)
SELECT o_orderpriority, CAST(n AS BIGINT) AS return_n, round(p, 6) AS return_rate, round(greatest(0, c - h), 6) AS lo,
       round(least(1, c + h), 6) AS hi, round((least(1, c + h) - greatest(0, c - h)) / 2 * 100, 4) AS half_width_pp
FROM w""")
def rate_wilson(t: Tables) -> DataFrame:
    """The flagship: returned share by priority with its 95% bounds."""
    r = metrics.rates(order_flags(t), RETURN_RATE, ["o_orderpriority"])
    w = r.withColumn("w", wilson(F.col("return_rate"), F.col("return_n")))
    return w.select(
        "o_orderpriority", "return_n", F.round("return_rate", 6).alias("return_rate"),
        F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"),
        F.round(half_width_pp(F.col("w.lo"), F.col("w.hi")), 4).alias("half_width_pp"),
    )


FUNNEL_SQL = """
, wide AS (SELECT {by} count(*) AS a, sum(CASE WHEN fulfilled THEN 1 ELSE 0 END) AS b, sum(CASE WHEN returned THEN 1 ELSE 0 END) AS c
           FROM flags {group}),
long AS (SELECT {by} 0 AS stage_index, 'ordered' AS stage, a AS keys_n, b AS next_n FROM wide
         UNION ALL SELECT {by} 1, 'fulfilled', b, c FROM wide
         UNION ALL SELECT {by} 2, 'returned', c, NULL FROM wide)
"""


@query("MET1", f"""
WITH {ORDER_FLAGS} {FUNNEL_SQL.format(by="o_orderpriority,", group="GROUP BY o_orderpriority")}
SELECT o_orderpriority, CAST(stage_index AS INTEGER) AS stage_index, stage, CAST(keys_n AS BIGINT) AS keys_n, CAST(next_n AS BIGINT) AS next_n,
       next_n / keys_n AS step_through_rate, 1 - next_n / keys_n AS drop_off_rate FROM long""")
def funnel_set(t: Tables) -> DataFrame:
    """Set-membership funnel over orders, cut by priority."""
    return metrics.funnel(order_flags(t), ["ordered", "fulfilled", "returned"], ["o_orderpriority"])


@query("MET18 MET1", f"""
WITH {ORDER_FLAGS} {FUNNEL_SQL.format(by="o_orderpriority,", group="GROUP BY o_orderpriority")},
d AS (SELECT *, 1 - next_n / keys_n AS drop_off_rate FROM long WHERE next_n IS NOT NULL)
SELECT o_orderpriority, stage, drop_off_rate FROM d
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY drop_off_rate DESC, stage_index) = 1""")
def largest_stage_drop(t: Tables) -> DataFrame:
    """Where each priority loses most."""
    f = metrics.funnel(order_flags(t), ["ordered", "fulfilled", "returned"], ["o_orderpriority"])
    return metrics.largest_drop(f, ["o_orderpriority"]).select("o_orderpriority", "stage", "drop_off_rate")


def user_days(t: Tables) -> DataFrame:
    """Per-event tables keyed by (user, day): every user has every event type over the whole range."""
    key = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select(key.alias("user_day"), "event_type", "ts", "value", "event_id")


@query("MET1 SET1", """
WITH k AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type FROM events),
f AS (SELECT user_id, d, bool_or(event_type='view') AS v, bool_or(event_type='click') AS c, bool_or(event_type='purchase') AS p FROM k GROUP BY ALL),
w AS (SELECT sum(CASE WHEN v THEN 1 ELSE 0 END) AS v, sum(CASE WHEN c THEN 1 ELSE 0 END) AS c, sum(CASE WHEN p THEN 1 ELSE 0 END) AS p FROM f)
SELECT CAST(0 AS INTEGER) AS stage_index, 'view' AS stage, CAST(v AS BIGINT) AS keys_n, CAST(c AS BIGINT) AS next_n, c/v AS step_through_rate, 1-c/v AS drop_off_rate FROM w
UNION ALL SELECT 1, 'click', CAST(c AS BIGINT), CAST(p AS BIGINT), p/c, 1-p/c FROM w
UNION ALL SELECT 2, 'purchase', CAST(p AS BIGINT), NULL, NULL, NULL FROM w""")
def funnel_daily_users(t: Tables) -> DataFrame:
    """Funnel over separate stage tables, unioned and reduced to one row per key."""
    e = user_days(t)
    stages = {s: e.filter(F.col("event_type") == s) for s in ("view", "click", "purchase")}
    return metrics.funnel(metrics.stage_flags(stages, "user_day"), list(stages))


HYGIENE_EVENTS = """
h AS (SELECT *, CASE WHEN event_id % 33 = 0 THEN CAST(event_id AS VARCHAR) END AS duplicate_id,
             CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS is_back_filled FROM events)
"""


def flagged_events(t: Tables) -> DataFrame:
    """Events with the hygiene columns the stand-in derives; some backfill flags are unknown."""
    i = F.col("event_id")
    return t.events.withColumns(
        {
            "duplicate_id": F.when(i % 33 == 0, i.cast("string")),
            "is_back_filled": F.when(i % 7 == 0, F.lit(None)).when(i % 50 == 0, 1).otherwise(0),
        }
    )


@query("HYG1 HYG2 HYG8", f"""
WITH {HYGIENE_EVENTS},
c AS (SELECT event_type, count(*) AS raw, sum(CASE WHEN duplicate_id IS NULL AND is_back_filled != 1 THEN 1 ELSE 0 END) AS cl,
             sum(CASE WHEN duplicate_id IS NOT NULL THEN 1 ELSE 0 END) AS d, sum(CASE WHEN is_back_filled = 1 THEN 1 ELSE 0 END) AS b
      FROM h GROUP BY event_type)
SELECT event_type, raw AS raw_rows, CAST(cl AS BIGINT) AS clean_rows, CAST(d AS BIGINT) AS duplicate_rows, CAST(b AS BIGINT) AS backfill_rows,
       round(CAST((cl - raw) * 100 AS DOUBLE) / raw, 2) AS delta_pct, round(CAST(d * 100 AS DOUBLE) / raw, 2) AS duplicate_pct,
       round(CAST(b * 100 AS DOUBLE) / raw, 2) AS backfill_pct FROM c""")
def hygiene_report(t: Tables) -> DataFrame:
    """What the two hygiene filters remove, per event type."""
    return hygiene.hygiene_report(flagged_events(t), ["event_type"])


@query("HYG3 AGG1 AGG2", f"""
WITH {HYGIENE_EVENTS}
SELECT event_type, count(*) AS rows_n, count(DISTINCT user_id) AS users_n FROM h
WHERE duplicate_id IS NULL AND is_back_filled != 1 GROUP BY event_type""")
def clean_event_counts(t: Tables) -> DataFrame:
    """Counts after hygiene, distinct users exactly."""
    return hygiene.clean(flagged_events(t)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows_n"), F.count_distinct("user_id").alias("users_n")
    )


@query("HYG4 HYG5 HYG6 AGG1", """
WITH d AS (SELECT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'web-user-b2c' WHEN 'MACHINERY' THEN 'Desktop' WHEN 'BUILDING' THEN 'ios' ELSE 'android' END AS device,
                  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE 'iOS' END AS os,
                  CASE WHEN c_custkey % 9 = 0 THEN 'g' END AS g, CASE WHEN c_custkey % 10 = 0 THEN 'f' END AS f FROM customer)
SELECT CASE WHEN device IN ('web-user-b2c', 'Desktop') THEN 'web' ELSE device END AS cohort,
       CASE WHEN os IS NULL OR os = '' THEN 'unknown' ELSE os END AS os,
       CASE WHEN g IS NOT NULL THEN 'paid_search' WHEN f IS NOT NULL THEN 'paid_social' ELSE 'organic' END AS acquisition,
       count(*) AS customers_n FROM d GROUP BY ALL""")
def cohort_buckets(t: Tables) -> DataFrame:
    """Device cohort, OS bucket and acquisition of customers."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    device = F.when(s == "HOUSEHOLD", "web-user-b2c").when(s == "MACHINERY", "Desktop").when(s == "BUILDING", "ios").otherwise("android")
    os = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise("iOS")
    return (
        t.customer.select(
            hygiene.device_cohort(device).alias("cohort"), hygiene.os_bucket(os).alias("os"),
            hygiene.acquisition(F.when(k % 9 == 0, "g"), F.when(k % 10 == 0, "f")).alias("acquisition"),
        ).groupBy("cohort", "os", "acquisition").agg(F.count(F.lit(1)).alias("customers_n"))
    )


@query("HYG7", """
WITH b AS (SELECT o_orderpriority, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN '24 hours' WHEN 2 THEN '3-5 days' WHEN 3 THEN '5-7 days' ELSE '7-10 days' END AS eta FROM orders)
SELECT eta, CAST(CASE eta WHEN '24 hours' THEN 24 WHEN '3-5 days' THEN 72 WHEN '5-7 days' THEN 120 ELSE 168 END AS INTEGER) AS min_hours,
       CAST(CASE eta WHEN '24 hours' THEN 24 WHEN '3-5 days' THEN 120 WHEN '5-7 days' THEN 168 ELSE 240 END AS INTEGER) AS max_hours, count(*) AS orders_n
FROM b GROUP BY ALL""")
def eta_bucket_hours(t: Tables) -> DataFrame:
    """ETA bucket texts, which mix units, as hours."""
    p = F.substring("o_orderpriority", 1, 1)
    eta = F.when(p == "1", "24 hours").when(p == "2", "3-5 days").when(p == "3", "5-7 days").otherwise("7-10 days")
    parsed = t.orders.select(eta.alias("eta")).withColumn("h", hygiene.eta_hours(F.col("eta")))
    return parsed.groupBy("eta", F.col("h.min_hours").alias("min_hours"), F.col("h.max_hours").alias("max_hours")).agg(
        F.count(F.lit(1)).alias("orders_n")
    )


@query("HYG9 AGG4", """
SELECT event_type, count(*) AS rows_n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS value_sum, min(value) AS value_min, max(value) AS value_max,
       round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS value_avg
FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY event_type""")
def window_bounded_totals(t: Tables) -> DataFrame:
    """Totals inside an explicit reporting window, pushed into the scan."""
    money = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return hygiene.within(t.events, "ts", "2024-01-03", "2024-01-10").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows_n"), F.round(money, 2).alias("value_sum"), F.min("value").alias("value_min"),
        F.max("value").alias("value_max"), F.round(money / F.count(F.lit(1)), 6).alias("value_avg"),
    )


@query("HYG10", """
SELECT n_name AS unit, c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice_sum, count(o_totalprice) AS o_totalprice_n
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def money_by_unit(t: Tables) -> DataFrame:
    """Order totals per unit (nation) and segment, never across units."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_name").alias("unit"))
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = hygiene.sum_money(o, "o_totalprice", "unit", ["c_mktsegment"])
    return out.withColumn("o_totalprice_sum", F.col("o_totalprice_sum").cast("double"))


@query("HYG11", """
WITH q AS (SELECT unnest(['with', 'rate']) AS term)
SELECT lang, count(*) AS docs_n FROM documents WHERE EXISTS (SELECT 1 FROM q WHERE contains(lower(text), term)) GROUP BY lang""")
def term_filter(t: Tables) -> DataFrame:
    """Documents that mention any term of a question."""
    from evidencelake.functions.text import mentions_any, question_terms

    terms = question_terms(F.lit("with a rate"), longer_than=2)
    return t.documents.filter(mentions_any(F.col("text"), terms)).groupBy("lang").agg(F.count(F.lit(1)).alias("docs_n"))


@query("HYG12 AGG16", """
SELECT DISTINCT source, lang FROM documents WHERE starts_with(source, 'src') AND source LIKE 'src%' AND lang NOT IN ('de') AND lang IN ('en', 'fr', 'es')""")
def prefix_and_set_predicates(t: Tables) -> DataFrame:
    """Prefix, LIKE and membership predicates over distinct pairs."""
    s, g = F.col("source"), F.col("lang")
    return t.documents.filter(F.startswith(s, F.lit("src")) & s.like("src%") & ~g.isin("de") & g.isin("en", "fr", "es")).select("source", "lang").distinct()


@query("HYG13", """
SELECT event_type, count(*) AS rows_n FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AND list_contains(['click', 'view', 'error'], event_type) GROUP BY event_type""")
def json_and_array_predicates(t: Tables) -> DataFrame:
    """JSON field and array membership predicates."""
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "error")])
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.filter((k >= 50) & F.array_contains(kinds, F.col("event_type"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_n"))


@query("JON1", """
SELECT n_name, count(*) AS lines_n, count(DISTINCT o_orderkey) AS orders_n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def equi_join_counts(t: Tables) -> DataFrame:
    """Lines and orders per nation: lines are counted per order before the join, so nothing fans out."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    per_customer = (
        t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("orders"))
    )
    return (
        per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(F.sum("lines").alias("lines_n"), F.sum("orders").alias("orders_n"))
    )


@query("JON2", """
WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def lookup_first_match(t: Tables) -> DataFrame:
    """Every customer with its first order, without fan-out."""
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    joined = joins.lookup_join(t.customer, orders, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return joined.select("c_custkey", "o_orderkey", "o_totalprice")


@query("JON3", """
SELECT k, orders_n, customers_n FROM (SELECT c_nationkey AS k, count(*) AS customers_n FROM customer GROUP BY 1)
JOIN (SELECT c_nationkey AS k, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (k)""")
def aggregate_then_join(t: Tables) -> DataFrame:
    """Both sides reduced to one row per nation before they meet."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"))
    c = t.customer.select(F.col("c_nationkey").alias("k"))
    return joins.join_aggregates(o, c, ["k"], [F.count(F.lit(1)).alias("orders_n")], [F.count(F.lit(1)).alias("customers_n")])


@query("JON4", """
SELECT o_orderpriority, count(*) AS orders_n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1""")
def semi_join_filter(t: Tables) -> DataFrame:
    """Orders that have a large line."""
    big = t.lineitem.filter("l_quantity >= 49").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.having_match(t.orders, big, ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders_n"))


@query("JON5 SET3", """
WITH d AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), l AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k, 'documented_not_live' AS status FROM d WHERE k NOT IN (SELECT k FROM l)
UNION ALL SELECT k, 'live_not_documented' FROM l WHERE k NOT IN (SELECT k FROM d)""")
def reconcile_keys(t: Tables) -> DataFrame:
    """Customers in credit against customers with orders, both directions."""
    d = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.reconcile(d, t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("JON6", """
SELECT DISTINCT l_partkey AS phantom FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def phantom_references(t: Tables) -> DataFrame:
    """Referenced parts that the known set does not hold."""
    return joins.phantom_refs(t.lineitem, "l_partkey", t.part.filter("p_size > 5"), "p_partkey")


@query("JON7", """
SELECT c_custkey, coalesce(n, 0) AS orders_n, coalesce(s, '') AS last_status FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_aggregate_defaults(t: Tables) -> DataFrame:
    """Order statistics per customer, misses read as 0 and the empty text."""
    stats = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders_n"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status")
    )
    return joins.left_with_defaults(t.customer.select("c_custkey"), stats, ["c_custkey"], {"orders_n": 0, "last_status": ""})


@query("JON10", """
SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 48) AS already FROM supplier""")
def catalog_membership(t: Tables) -> DataFrame:
    """Suppliers flagged by whether they appear in a filtered fact table."""
    hot = t.lineitem.filter("l_discount = 0.1 AND l_quantity > 48")
    return joins.membership_flag(t.supplier, "s_suppkey", hot, "l_suppkey", "already").select("s_suppkey", "already")


@query("AGG5", """
WITH r AS (SELECT l_shipmode, v, row_number() OVER (PARTITION BY l_shipmode ORDER BY v) AS i, count(*) OVER (PARTITION BY l_shipmode) AS n
           FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS v FROM lineitem))
SELECT l_shipmode AS l_returnflag, n AS rows_n, max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) + 1 THEN v END) AS price_p50 FROM r GROUP BY ALL""")
def upper_median_by_flag(t: Tables) -> DataFrame:
    """Exact median, the upper middle at even counts, ranked across tasks."""
    q = quantiles.exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"price_p50": ("upper", 0.5)})
    return q.withColumnRenamed("n", "rows_n")


@query("AGG6", """
SELECT event_type, count(*) AS rows_n, round(quantile_cont(value, 0.95), 4) AS value_p95 FROM events GROUP BY event_type""")
def interpolated_p95(t: Tables) -> DataFrame:
    """Interpolated 95th percentile."""
    q = quantiles.exact_quantiles(t.events, ["event_type"], "value", {"value_p95": ("interpolated", 0.95)})
    return q.select("event_type", F.col("n").alias("rows_n"), F.round("value_p95", 4).alias("value_p95"))


@query("AGG7 AGG8 AGG9 AGG10", """
SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type,
       arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, min(event_type) AS any_type
FROM events GROUP BY user_id""")
def arg_extremes(t: Tables) -> DataFrame:
    """Value at the latest, earliest and latest qualifying row."""
    bought = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"),
        F.max_by(F.when(bought, F.col("value")), F.when(bought, F.col("event_id"))).alias("last_purchase"),
        F.min("event_type").alias("any_type"),
    )


@query("AGG12", """
SELECT CASE WHEN grouping(h) = 1 AND grouping(event_type) = 1 THEN 'total' WHEN grouping(h) = 0 THEN 'hour' ELSE 'type' END AS grouping,
       h AS hour_ts, event_type, count(*) AS rows_n, max(value) AS value_max
FROM (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, event_type, value FROM events) GROUP BY GROUPING SETS ((), (h), (event_type))""")
def grouping_sets_scan(t: Tables) -> DataFrame:
    """Totals, hours and types from one scan, told apart by grouping id rather than by value."""
    e = t.events.select(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("hour_ts"), "event_type", "value")
    gid = F.grouping_id()
    sets = e.groupingSets([[], ["hour_ts"], ["event_type"]], "hour_ts", "event_type").agg(
        F.count(F.lit(1)).alias("rows_n"), F.max("value").alias("value_max"), gid.alias("g")
    )
    label = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "hour").otherwise("type")
    return sets.select(label.alias("grouping"), "hour_ts", "event_type", "rows_n", "value_max")


@query("AGG13", """SELECT o_custkey, count(*) AS orders_n FROM orders GROUP BY o_custkey HAVING count(*) >= 15""")
def having_filter(t: Tables) -> DataFrame:
    """Filter on an aggregate."""
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_n")).filter("orders_n >= 15")


@query("AGG14", f"""
WITH {ORDER_FLAGS},
seg AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate FROM flags GROUP BY ALL)
SELECT o_orderpriority, round(sum(rate * n) / sum(n), 9) AS population_rate, CAST(sum(n) AS BIGINT) AS population_n FROM seg GROUP BY 1""")
def weighted_population_rate(t: Tables) -> DataFrame:
    """Population rate of segments: weighted by their samples, never a mean of rates."""
    seg = metrics.rates(order_flags(t, ("o_orderpriority", "o_orderstatus")), RETURN_RATE, ["o_orderpriority", "o_orderstatus"])
    weighted = F.try_divide(F.sum(F.col("return_rate") * F.col("return_n")), F.sum("return_n").cast("double"))
    return seg.groupBy("o_orderpriority").agg(F.round(weighted, 9).alias("population_rate"), F.sum("return_n").alias("population_n"))


@query("AGG15", """
SELECT l_shipyear, lines_n, floor(CAST(lines_n AS DOUBLE) / sum(lines_n) OVER () * 1000 + 0.5) / 10 AS share_pct
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipyear, count(*) AS lines_n FROM lineitem GROUP BY 1)""")
def share_of_total(t: Tables) -> DataFrame:
    """Share of lines per ship year, one decimal."""
    years = t.lineitem.groupBy(F.year("l_shipdate").alias("l_shipyear")).agg(F.count(F.lit(1)).alias("lines_n"))
    return metrics.share_of_total(years, "lines_n")


@query("SET1", """
SELECT 'order' AS kind, o_orderstatus AS status, count(*) AS rows_n, NULL::DOUBLE AS qty FROM orders GROUP BY ALL
UNION ALL SELECT 'line', l_linestatus, count(*), CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem GROUP BY ALL""")
def union_of_stages(t: Tables) -> DataFrame:
    """Two stage tables, each scanned and aggregated once, then stacked by name."""
    o = t.orders.groupBy(F.lit("order").alias("kind"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("rows_n"))
    li = t.lineitem.groupBy(F.lit("line").alias("kind"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("rows_n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty")
    )
    return o.unionByName(li, allowMissingColumns=True)


@query("TOP3", """
WITH p AS (SELECT l_partkey, count(*) AS lines_n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY qty DESC, l_partkey) AS hi, row_number() OVER (ORDER BY qty, l_partkey) AS lo FROM p)
SELECT l_partkey, lines_n, qty, 'top' AS "end", CAST(hi AS INTEGER) AS position FROM r WHERE hi <= 5
UNION ALL SELECT l_partkey, lines_n, qty, 'bottom', CAST(lo AS INTEGER) FROM r WHERE lo <= 5""")
def extremes_top_bottom(t: Tables) -> DataFrame:
    """The five best and five worst parts, whole rows under a total order."""
    p = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines_n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))
    return topk.extremes(p, "qty", ["l_partkey", "lines_n"])


@query("TOP3", """
WITH p AS (SELECT l_returnflag, l_partkey, count(*) AS lines_n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY lines_n DESC, l_partkey) AS hi, row_number() OVER (PARTITION BY l_returnflag ORDER BY lines_n, l_partkey) AS lo FROM p)
SELECT l_returnflag, l_partkey, lines_n, 'top' AS "end", CAST(hi AS INTEGER) AS position FROM r WHERE hi <= 5
UNION ALL SELECT l_returnflag, l_partkey, lines_n, 'bottom', CAST(lo AS INTEGER) FROM r WHERE lo <= 5""")
def extremes_per_result(t: Tables) -> DataFrame:
    """Extremes of many results at once, limited per group before the shuffle."""
    p = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("lines_n"))
    return topk.extremes_by(p, ["l_returnflag"], "lines_n", ["l_partkey"])


@query("TOP4", """SELECT * FROM (SELECT p_partkey, p_brand, p_type FROM part) ORDER BY ALL LIMIT 1000""")
def display_cap(t: Tables) -> DataFrame:
    """Deterministic display cap under ORDER BY ALL."""
    return topk.display_cap(t.part.select("p_partkey", "p_brand", "p_type"))


@query("TOP6", """SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def most_recent_orders(t: Tables) -> DataFrame:
    """Most recent rows."""
    return topk.most_recent(t.orders, "o_orderdate", 20, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("TOP7", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MED' ELSE 'LOW' END AS severity FROM events
ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id DESC LIMIT 30""")
def severity_order(t: Tables) -> DataFrame:
    """Custom rank order."""
    k = F.col("event_type")
    s = t.events.select("event_id", F.when(k == "error", "HIGH").when(k == "purchase", "MED").otherwise("LOW").alias("severity"))
    return s.orderBy(topk.severity_rank(F.col("severity")), F.col("event_id").desc()).limit(30)


@query("MET2", """
WITH s AS (SELECT count(*) AS n FROM events WHERE event_type = 'signup'), p AS (SELECT count(*) AS n FROM events WHERE event_type = 'purchase')
SELECT p.n AS conversion_hits, s.n AS conversion_n, p.n / s.n AS conversion_rate FROM s, p""")
def headline_conversion(t: Tables) -> DataFrame:
    """Purchases over sessions, where every start row is a session."""
    k = F.col("event_type")
    counted = t.events.filter(k.isin("signup", "purchase")).agg(
        F.count_if(k == "purchase").alias("conversion_hits"), F.count_if(k == "signup").alias("conversion_n")
    )
    return counted.withColumn("conversion_rate", F.try_divide(F.col("conversion_hits").cast("double"), F.col("conversion_n").cast("double")))


USER_DAY_FLAGS = """
f AS (SELECT user_id, CAST(ts AS DATE) AS d, bool_or(event_type='signup') AS started, bool_or(event_type='view') AS shown, bool_or(event_type='click') AS clicked,
             bool_or(event_type='purchase') AS bought, bool_or(event_type='error') AS failed FROM events GROUP BY 1, 2)
"""


def user_day_flags(t: Tables) -> DataFrame:
    k = F.col("event_type")
    return metrics.key_flags(
        user_days(t), "user_day",
        {"started": k == "signup", "shown": k == "view", "clicked": k == "click", "bought": k == "purchase", "failed": k == "error"},
    )


@query("MET3", f"""
WITH {USER_DAY_FLAGS}
SELECT CAST(sum(CASE WHEN bought AND started THEN 1 ELSE 0 END) AS BIGINT) AS funnel_hits, CAST(sum(CASE WHEN started THEN 1 ELSE 0 END) AS BIGINT) AS funnel_n,
       sum(CASE WHEN bought AND started THEN 1 ELSE 0 END) / sum(CASE WHEN started THEN 1 ELSE 0 END) AS funnel_rate FROM f""")
def funnel_conversion(t: Tables) -> DataFrame:
    """Purchasing user-days among those that started."""
    return metrics.rates(user_day_flags(t), [RateSpec("funnel", "bought & started", "started")])


@query("MET4", f"""
WITH {HYGIENE_EVENTS}, c AS (SELECT * FROM h WHERE duplicate_id IS NULL AND is_back_filled != 1),
f AS (SELECT user_id, CAST(ts AS DATE) AS d, bool_or(event_type='click') AS pay, bool_or(event_type='purchase') AS buy FROM c WHERE event_type IN ('click','purchase') GROUP BY 1, 2)
SELECT CAST(sum(CASE WHEN buy THEN 1 ELSE 0 END) AS BIGINT) AS checkout_hits, CAST(sum(CASE WHEN pay THEN 1 ELSE 0 END) AS BIGINT) AS checkout_n,
       sum(CASE WHEN buy THEN 1 ELSE 0 END) / sum(CASE WHEN pay THEN 1 ELSE 0 END) AS checkout_rate FROM f""")
def checkout_conversion(t: Tables) -> DataFrame:
    """Distinct keys that bought over distinct keys that clicked pay, both cleaned, from two tables."""
    e = flagged_events(t).withColumn("key", F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    stages = {"pay": e.filter("event_type = 'click'"), "buy": e.filter("event_type = 'purchase'")}
    return metrics.rates(metrics.stage_flags(stages, "key"), [RateSpec("checkout", "buy", "pay")])


@query("MET5 MET14", f"""
WITH {USER_DAY_FLAGS}, c AS (SELECT sum(CASE WHEN shown THEN 1 ELSE 0 END) AS s, sum(CASE WHEN clicked THEN 1 ELSE 0 END) AS k, sum(CASE WHEN bought THEN 1 ELSE 0 END) AS b FROM f)
SELECT CAST(b AS BIGINT) AS completion_hits, CAST(k AS BIGINT) AS completion_n, b / k AS completion_rate,
       CAST(b AS BIGINT) AS conversion_hits, CAST(s AS BIGINT) AS conversion_n, b / s AS conversion_rate,
       CAST(k AS BIGINT) AS adoption_hits, CAST(s AS BIGINT) AS adoption_n, k / s AS adoption_rate FROM c""")
def stage_matched_rates(t: Tables) -> DataFrame:
    """Completion, conversion and adoption: three declared rates, one scan."""
    specs = [RateSpec("completion", "bought", "clicked"), RateSpec("conversion", "bought", "shown"), RateSpec("adoption", "clicked", "shown")]
    return metrics.rates(user_day_flags(t), specs)


@query("MET6", """
SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity <= 40 THEN 1 ELSE 0 END) AS BIGINT) AS pass_hits, count(*) AS pass_n,
       sum(CASE WHEN l_quantity <= 40 THEN 1 ELSE 0 END) / count(*) AS pass_rate FROM lineitem GROUP BY 1""")
def capture_pass_rate(t: Tables) -> DataFrame:
    """Rows that did not cross the threshold over all rows."""
    return metrics.row_rates(t.lineitem, {"pass": (F.col("l_quantity") <= 40, F.lit(True))}, ["l_returnflag"])


@query("MET7", """
SELECT o_orderstatus AS unit, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue_sum, count(o_totalprice) AS conversions_n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS revenue_per_conversion FROM orders GROUP BY 1""")
def revenue_per_conversion(t: Tables) -> DataFrame:
    """Revenue per conversion by unit."""
    return metrics.revenue_per_conversion(t.orders.withColumnRenamed("o_orderstatus", "unit"), "o_totalprice", "unit")


@query("MET8", """
SELECT strftime(l_shipdate, '%Y-%m') AS month, l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS month_hits, count(*) AS month_n,
       sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS month_rate FROM lineitem GROUP BY ALL""")
def monthly_rate_trend(t: Tables) -> DataFrame:
    """Monthly return rate by line status."""
    return metrics.monthly_rate(t.lineitem, "l_shipdate", F.col("l_returnflag") == "R", F.lit(True), ["l_linestatus"])


@query("MET10", f"""
WITH {ORDER_FLAGS}, s AS (SELECT sum(CASE WHEN o_orderpriority = '1-URGENT' AND returned THEN 1 ELSE 0 END) AS ah, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS an,
  sum(CASE WHEN o_orderpriority = '5-LOW' AND returned THEN 1 ELSE 0 END) AS bh, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS bn FROM flags)
SELECT CAST(ah AS BIGINT) AS a_hits, CAST(an AS BIGINT) AS a_n, CAST(bh AS BIGINT) AS b_hits, CAST(bn AS BIGINT) AS b_n, ah/an AS a_rate, bh/bn AS b_rate,
       round((ah/an - bh/bn) * 100, 9) AS gap_pp, round((ah/an) / (bh/bn), 9) AS lift FROM s""")
def segment_gap(t: Tables) -> DataFrame:
    """Urgent against low priority: gap in points and lift."""
    seg = metrics.rates(order_flags(t), RETURN_RATE, ["o_orderpriority"])
    c = metrics.compare(seg, "o_orderpriority", "1-URGENT", "5-LOW", "return_hits", "return_n")
    return c.withColumns({"gap_pp": F.round("gap_pp", 9), "lift": F.round("lift", 9)})


@query("MET10", f"""
WITH {ORDER_FLAGS}, s AS (SELECT o_orderpriority, sum(CASE WHEN returned THEN 1 ELSE 0 END) / count(*) AS return_rate FROM flags GROUP BY 1)
(SELECT 'best' AS which, o_orderpriority, return_rate FROM s ORDER BY return_rate DESC, o_orderpriority LIMIT 1)
UNION ALL (SELECT 'worst', o_orderpriority, return_rate FROM s ORDER BY return_rate, o_orderpriority LIMIT 1)""")
def best_worst_segment(t: Tables) -> DataFrame:
    """Best and worst priority."""
    seg = metrics.rates(order_flags(t), RETURN_RATE, ["o_orderpriority"]).select("o_orderpriority", "return_rate")
    return metrics.best_and_worst(seg, "o_orderpriority", "return_rate")


@query("MET11", """
WITH s AS (SELECT user_id * 1000 + event_id % 1000 AS sid FROM events WHERE event_type = 'signup'), d AS (SELECT DISTINCT user_id * 1000 + event_id % 1000 AS sid FROM events WHERE event_type = 'purchase')
SELECT (SELECT count(*) FROM s) AS start_rows, (SELECT count(DISTINCT sid) FROM s) AS start_sessions, (SELECT count(*) FROM d) AS downstream_sessions,
       (SELECT count(*) FROM d WHERE sid NOT IN (SELECT sid FROM s)) AS orphan_sessions, (SELECT count(*) = count(DISTINCT sid) FROM s) AS unique_starts""")
def session_audit(t: Tables) -> DataFrame:
    """Is every start its own session and every downstream session contained?"""
    e = t.events.withColumn("sid", F.col("user_id") * 1000 + F.col("event_id") % 1000)
    return metrics.session_audit(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), "sid")


@query("MET12", """
WITH u AS (SELECT user_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS k, min(ts) AS m FROM events WHERE event_type = 'click' GROUP BY 1),
d AS (SELECT user_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS k, min(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) AS keys_n, CAST(sum(CASE WHEN d.m < u.m THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order_n, sum(CASE WHEN d.m < u.m THEN 1 ELSE 0 END) / count(*) AS out_of_order_rate FROM u JOIN d USING (k)""")
def ordering_audit(t: Tables) -> DataFrame:
    """How often a purchase precedes the first click of the same user-day."""
    e = user_days(t)
    return metrics.ordering_audit(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_day", "ts", "ts")


@query("MET13", """
WITH r AS (SELECT event_id, event_id * 2 + 1 AS ref FROM events WHERE event_id % 33 = 0)
SELECT count(*) AS reference_rows, CAST(sum(CASE WHEN ref NOT IN (SELECT event_id FROM events) THEN 1 ELSE 0 END) AS BIGINT) AS dangling_rows FROM r""")
def dangling_references(t: Tables) -> DataFrame:
    """References that resolve to no row of the same table."""
    i = F.col("event_id")
    return metrics.dangling_refs(t.events.withColumn("ref", F.when(i % 33 == 0, i * 2 + 1)), "ref", "event_id")


@query("MET14 AGG5", """
WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n AS rows_n, max(CASE WHEN i = least(CAST(floor(n*0.5) AS BIGINT) + 1, n) THEN v END) AS p50, max(CASE WHEN i = least(CAST(floor(n*0.9) AS BIGINT) + 1, n) THEN v END) AS p90,
       max(CASE WHEN i = least(CAST(floor(n*0.99) AS BIGINT) + 1, n) THEN v END) AS p99 FROM r GROUP BY ALL""")
def latency_distribution(t: Tables) -> DataFrame:
    """Quantiles of a measured latency."""
    q = quantiles.exact_quantiles(t.events, ["event_type"], "value", {"p50": ("upper", 0.5), "p90": ("upper", 0.9), "p99": ("upper", 0.99)})
    return q.withColumnRenamed("n", "rows_n")


@query("MET15", """
WITH g AS (SELECT o_orderkey, count(l_orderkey) AS size, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS BIGINT) AS removed, coalesce(bool_and(l_linestatus = 'F'), false) AS done
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT size AS group_size, count(*) AS completion_n, CAST(sum(CASE WHEN done THEN 1 ELSE 0 END) AS BIGINT) AS completion_hits, sum(CASE WHEN done THEN 1 ELSE 0 END) / count(*) AS completion_rate,
       CAST(sum(size - removed) AS BIGINT) AS added_n, CAST(sum(removed) AS BIGINT) AS removed_n FROM g GROUP BY 1""")
def group_completion(t: Tables) -> DataFrame:
    """Completion by group size, added against removed members."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("group_size"), F.count_if(F.col("l_returnflag") == "R").alias("removed"),
        F.bool_and(F.col("l_linestatus") == "F").alias("done"),
    )
    g = t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").fillna({"group_size": 0, "removed": 0, "done": False})
    out = g.groupBy("group_size").agg(
        F.count(F.lit(1)).alias("completion_n"), F.count_if("done").alias("completion_hits"),
        F.sum(F.col("group_size") - F.col("removed")).alias("added_n"), F.sum("removed").alias("removed_n"),
    )
    return out.withColumn("completion_rate", F.try_divide(F.col("completion_hits").cast("double"), F.col("completion_n").cast("double")))


@query("MET16 AGG15", """
WITH c AS (SELECT event_type AS channel, count(*) AS opens_n, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS new_user_n,
                  CAST(sum(CASE WHEN user_id % 3 = 0 AND value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS kfactor_hits FROM events GROUP BY 1)
SELECT *, floor(CAST(opens_n AS DOUBLE) / sum(opens_n) OVER () * 1000 + 0.5) / 10 AS share_pct, kfactor_hits / new_user_n AS kfactor_rate FROM c""")
def channel_mix(t: Tables) -> DataFrame:
    """Channel mix, new-user opens and the share of them that go on."""
    new = F.col("user_id") % 3 == 0
    c = t.events.groupBy(F.col("event_type").alias("channel")).agg(
        F.count(F.lit(1)).alias("opens_n"), F.count_if(new).alias("new_user_n"), F.count_if(new & (F.col("value") > 20)).alias("kfactor_hits")
    )
    mixed = metrics.share_of_total(c, "opens_n")
    return mixed.withColumn("kfactor_rate", F.try_divide(F.col("kfactor_hits").cast("double"), F.col("new_user_n").cast("double")))


@query("MET17 MET9", f"""
WITH {ORDER_FLAGS}
SELECT CASE WHEN hour_bucket < 24 THEN 'under 24h' WHEN hour_bucket < 48 THEN '24h-48h' ELSE '48h and more' END AS timing,
       CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS BIGINT) AS recovery_hits, count(*) AS recovery_n, sum(CASE WHEN returned THEN 1 ELSE 0 END) / count(*) AS recovery_rate
FROM (SELECT *, o_custkey % 72 AS hour_bucket FROM flags) GROUP BY 1""")
def recovery_timing(t: Tables) -> DataFrame:
    """Recovery rate by hours since the drop."""
    hours = F.col("o_custkey") % 72
    timing = F.when(hours < 24, "under 24h").when(hours < 48, "24h-48h").otherwise("48h and more")
    return metrics.rates(order_flags(t, ("o_custkey",)).withColumn("timing", timing), [RateSpec("recovery", "returned", "ordered")], ["timing"])


@query("MET18 AGG5", """
WITH a AS (SELECT o_orderpriority, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY v) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM a)
SELECT o_orderpriority, n AS attachers_n, (SELECT count(*) FROM orders o WHERE o.o_orderpriority = r.o_orderpriority) AS attach_n,
       n / (SELECT count(*) FROM orders o WHERE o.o_orderpriority = r.o_orderpriority) AS attach_rate, max(CASE WHEN i = CAST(floor(n*0.5) AS BIGINT) + 1 THEN v END) AS addon_p50
FROM r GROUP BY ALL""")
def attach_rate_and_value(t: Tables) -> DataFrame:
    """Attach rate and the value distribution among attachers."""
    attached = F.col("o_orderstatus") == "F"
    rate = metrics.row_rates(t.orders, {"attach": (attached, F.lit(True))}, ["o_orderpriority"]).withColumnRenamed("attach_hits", "attachers_n")
    q = quantiles.exact_quantiles(t.orders.filter(attached), ["o_orderpriority"], "o_totalprice", {"addon_p50": ("upper", 0.5)})
    return quantiles.with_quantiles(rate, q, ["o_orderpriority"])


@query("MET19 HYG10 AGG15", """
WITH c AS (SELECT p_brand AS code, count(*) AS uses_n, CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS applied_n,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS discount_sum FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT *, applied_n / uses_n AS applied_rate, floor(CAST(uses_n AS DOUBLE) / sum(uses_n) OVER () * 1000 + 0.5) / 10 AS share_pct FROM c""")
def discount_by_code(t: Tables) -> DataFrame:
    """Volume, valid share and discount cost per code."""
    # lines are folded per part before the join
    cost = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    parts = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("u"), F.count_if(F.col("l_discount") >= 0.05).alias("a"), F.sum(cost).alias("d")
    )
    c = parts.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("code")).agg(
        F.sum("u").alias("uses_n"), F.sum("a").alias("applied_n"), F.sum("d").cast("double").alias("discount_sum")
    )
    rated = c.withColumn("applied_rate", F.try_divide(F.col("applied_n").cast("double"), F.col("uses_n").cast("double")))
    return metrics.share_of_total(rated, "uses_n")


@query("MET20", """
WITH r AS (SELECT user_id AS qid, value AS wall, CASE WHEN event_type = 'error' THEN 'boom' ELSE '' END AS err, event_id % 4 AS head, event_id % 3 AS sqlset FROM events)
SELECT qid, count(*) AS runs_n, CAST(sum(CASE WHEN err != '' THEN 1 ELSE 0 END) AS BIGINT) AS failures_n, round(quantile_cont(wall, 0.5), 6) AS median_wall,
       count(DISTINCT CASE WHEN err = '' THEN head END) AS head_distinct, count(DISTINCT CASE WHEN err = '' THEN sqlset END) AS sqlset_distinct FROM r GROUP BY qid""")
def repeatability(t: Tables) -> DataFrame:
    """Per question: median wall time, distinct digests, failures."""
    runs = t.events.select(
        F.col("user_id").alias("qid"), F.col("value").alias("wall"), F.when(F.col("event_type") == "error", "boom").otherwise("").alias("err"),
        (F.col("event_id") % 4).alias("head"), (F.col("event_id") % 3).alias("sqlset"),
    )
    return metrics.repeatability(runs, "qid", "wall", "err", ["head", "sqlset"]).withColumn("median_wall", F.round("median_wall", 6))


@query("MET17", f"""
WITH {ORDER_FLAGS}
SELECT o_orderpriority AS drop_step, CAST(sum(CASE WHEN returned THEN 1 ELSE 0 END) AS BIGINT) AS recovery_hits, count(*) AS recovery_n, sum(CASE WHEN returned THEN 1 ELSE 0 END) / count(*) AS recovery_rate FROM flags GROUP BY 1""")
def recovery_by_step(t: Tables) -> DataFrame:
    """Recovery rate by the step at which the order was dropped."""
    flags = order_flags(t, ("o_orderpriority",)).withColumnRenamed("o_orderpriority", "drop_step")
    return metrics.rates(flags, [RateSpec("recovery", "returned", "ordered")], ["drop_step"])


CHANNEL_SQL = "CASE user_id % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'email' ELSE 'whatsapp' END"


@query("MET17", f"""
WITH f AS (SELECT {CHANNEL_SQL} AS channel, user_id, bool_or(event_type = 'view') AS opened, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1, 2),
c AS (SELECT channel, count(*) FILTER (opened) AS o, count(*) FILTER (opened AND clicked) AS k, count(*) FILTER (opened AND clicked AND bought) AS b FROM f GROUP BY 1)
SELECT channel, k AS click_hits, o AS click_n, k / o AS click_rate, b AS reconvert_hits, k AS reconvert_n, b / k AS reconvert_rate, b AS recovery_hits, o AS recovery_n, b / o AS recovery_rate FROM c""")
def recovery_chain(t: Tables) -> DataFrame:
    """Opened, then clicked, then bought again, by channel: each step over the one before and the whole chain."""
    u = F.col("user_id")
    channel = F.when(u % 3 == 0, "push").when(u % 3 == 1, "email").otherwise("whatsapp")
    did = lambda kind: F.bool_or(F.col("event_type") == kind)
    users = t.events.groupBy(channel.alias("channel"), "user_id").agg(did("view").alias("opened"), did("click").alias("_k"), did("purchase").alias("_b"))
    users = users.withColumn("clicked", F.col("opened") & F.col("_k")).withColumn("bought", F.col("clicked") & F.col("_b"))
    return metrics.rates(users, [RateSpec("click", "clicked", "opened"), RateSpec("reconvert", "bought", "clicked"), RateSpec("recovery", "bought", "opened")], ["channel"])


@query("MET14 MET10", """
WITH f AS (SELECT user_id % 4 = 0 AS express, user_id, bool_or(event_type = 'purchase') AS b FROM events GROUP BY 1, 2),
s AS (SELECT count(*) FILTER (express AND b) AS ah, count(*) FILTER (express) AS an, count(*) FILTER (NOT express AND b) AS bh, count(*) FILTER (NOT express) AS bn FROM f)
SELECT ah AS a_hits, an AS a_n, bh AS b_hits, bn AS b_n, ah / an AS a_rate, bh / bn AS b_rate, round((ah / an - bh / bn) * 100, 9) AS gap_pp, round((ah / an) / (bh / bn), 9) AS lift FROM s""")
def express_lift(t: Tables) -> DataFrame:
    """Conversion of the express flow against the standard one: gap in points and lift."""
    users = t.events.groupBy(F.when(F.col("user_id") % 4 == 0, "express").otherwise("standard").alias("flow"), "user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    by_flow = metrics.rates(users.withColumn("shown", F.lit(True)), [RateSpec("conversion", "bought", "shown")], ["flow"])
    c = metrics.compare(by_flow, "flow", "express", "standard", "conversion_hits", "conversion_n")
    return c.withColumns({"gap_pp": F.round("gap_pp", 9), "lift": F.round("lift", 9)})


@query("MET14 AGG12", """
WITH v AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'phone' ELSE 'desktop' END AS device, 'os' || (event_id % 5) AS os, 'c' || (user_id % 7) AS country, event_type = 'purchase' AS ok FROM events),
u AS (SELECT unnest([{'cut': 'device', 'value': device}, {'cut': 'os', 'value': os}, {'cut': 'country', 'value': country}]) AS c, ok FROM v)
SELECT c.cut AS cut, c.value AS value, count(*) FILTER (ok) AS success_hits, count(*) AS success_n, count(*) FILTER (ok) / count(*) AS success_rate FROM u GROUP BY 1, 2""")
def success_by_platform(t: Tables) -> DataFrame:
    """Success rate cut by device, system and country, from one scan."""
    i, s = F.col("event_id"), (lambda p, c: F.concat(F.lit(p), c.cast("string")))
    cuts = {"device": F.when(i % 2 == 0, "phone").otherwise("desktop"), "os": s("os", i % 5), "country": s("c", F.col("user_id") % 7)}
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("cut"), v.alias("value")) for k, v in cuts.items()]))
    return metrics.row_rates(t.events.select("event_type", each), {"success": (F.col("event_type") == "purchase", F.lit(True))}, ["cut", "value"])


@query("MET14", """
WITH f AS (SELECT 'm' || (user_id % 4) AS saved_method, user_id, bool_or(event_type = 'view') AS shown, bool_or(event_type = 'click') AS chosen FROM events GROUP BY 1, 2)
SELECT saved_method, count(*) FILTER (chosen) AS adoption_hits, count(*) FILTER (shown) AS adoption_n, count(*) FILTER (chosen) / count(*) FILTER (shown) AS adoption_rate FROM f GROUP BY 1""")
def adoption_by_method(t: Tables) -> DataFrame:
    """Adoption by the method a user has saved."""
    did = lambda kind: F.bool_or(F.col("event_type") == kind)
    users = t.events.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("saved_method"), "user_id").agg(did("view").alias("shown"), did("click").alias("chosen"))
    return metrics.rates(users, [RateSpec("adoption", "chosen", "shown")], ["saved_method"])


@query("MET15", """
WITH g AS (SELECT l_orderkey, count(*) AS group_size, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT group_size, sum(done)::BIGINT AS docs_hits, sum(group_size)::BIGINT AS docs_n, sum(done) / sum(group_size) AS docs_rate FROM g GROUP BY 1""")
def docs_complete_by_size(t: Tables) -> DataFrame:
    """Share of members whose documents are complete, by group size."""
    groups = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("group_size"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    out = groups.groupBy("group_size").agg(F.sum("done").alias("docs_hits"), F.sum("group_size").alias("docs_n"))
    return out.withColumn("docs_rate", F.try_divide(F.col("docs_hits").cast("double"), F.col("docs_n").cast("double")))


@query("MET16", """
SELECT o_orderstatus AS status, count(*) FILTER (o_custkey % 3 = 0) AS share_hits, count(*) AS share_n, count(*) FILTER (o_custkey % 3 = 0) / count(*) AS share_rate FROM orders GROUP BY 1""")
def share_rate_by_status(t: Tables) -> DataFrame:
    """How many of the orders in each status were shared."""
    return metrics.row_rates(t.orders.withColumnRenamed("o_orderstatus", "status"), {"share": (F.col("o_custkey") % 3 == 0, F.lit(True))}, ["status"])


@query("MET16", """
WITH k AS (SELECT user_id AS share_id, event_id // 8 % 4 AS destination, count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) AS opens, count(*) FILTER (event_type = 'click' AND event_id % 2 = 0) AS taps FROM events GROUP BY 1, 2)
SELECT destination, count(*) FILTER (opens > 0) AS opened_shares, count(*) FILTER (opens > 0 AND taps > 0) AS factor_hits, sum(opens)::BIGINT AS new_opens,
 count(*) FILTER (opens > 0 AND taps > 0) / nullif(count(*) FILTER (opens > 0), 0) AS factor_rate FROM k GROUP BY 1""")
def recipient_factor(t: Tables) -> DataFrame:
    """Per share, whether a new recipient who opened it went on; the factor by destination."""
    new = F.col("event_id") % 2 == 0
    kind = lambda k: F.count_if((F.col("event_type") == k) & new)
    shares = t.events.groupBy(F.col("user_id").alias("share_id"), (F.expr("event_id div 8") % 4).alias("destination")).agg(kind("view").alias("opens"), kind("click").alias("taps"))
    opened, went_on = F.col("opens") > 0, (F.col("opens") > 0) & (F.col("taps") > 0)
    out = shares.groupBy("destination").agg(F.count_if(opened).alias("opened_shares"), F.count_if(went_on).alias("factor_hits"), F.sum("opens").alias("new_opens"))
    return out.withColumn("factor_rate", F.try_divide(F.col("factor_hits").cast("double"), F.col("opened_shares").cast("double")))


@query("MET19 AGG15", """
WITH v AS (SELECT CASE l_returnflag WHEN 'A' THEN 'expired' WHEN 'R' THEN 'already used' ELSE 'valid' END AS outcome FROM lineitem)
SELECT outcome, count(*) AS uses_n, floor(count(*)::DOUBLE / sum(count(*)) OVER () * 1000 + 0.5) / 10 AS share_pct FROM v GROUP BY 1""")
def coupon_outcomes(t: Tables) -> DataFrame:
    """Valid codes and each reason of rejection, with their shares."""
    flag = F.col("l_returnflag")
    outcome = F.when(flag == "A", "expired").when(flag == "R", "already used").otherwise("valid")
    return metrics.share_of_total(t.lineitem.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("uses_n")), "uses_n")


@query("MET19 MET10", """
WITH v AS (SELECT CASE WHEN l_discount >= 0.05 THEN 'code' ELSE 'none' END AS arm, l_linestatus = 'F' AS done FROM lineitem),
s AS (SELECT count(*) FILTER (arm = 'code' AND done) AS ah, count(*) FILTER (arm = 'code') AS an, count(*) FILTER (arm = 'none' AND done) AS bh, count(*) FILTER (arm = 'none') AS bn FROM v)
SELECT ah AS a_hits, an AS a_n, bh AS b_hits, bn AS b_n, ah / an AS a_rate, bh / bn AS b_rate, round((ah / an - bh / bn) * 100, 9) AS gap_pp, round((ah / an) / (bh / bn), 9) AS lift FROM s""")
def coupon_lift(t: Tables) -> DataFrame:
    """Conversion with a code against the baseline without one."""
    arm = F.when(F.col("l_discount") >= 0.05, "code").otherwise("none")
    by_arm = metrics.row_rates(t.lineitem.withColumn("arm", arm), {"conversion": (F.col("l_linestatus") == "F", F.lit(True))}, ["arm"])
    c = metrics.compare(by_arm, "arm", "code", "none", "conversion_hits", "conversion_n")
    return c.withColumns({"gap_pp": F.round("gap_pp", 9), "lift": F.round("lift", 9)})
