"""The versioned definition store and its changelog, over entries derived from ``documents``.

A document is an entry: its language gives the category, its source the name, its id the version; every 25
entries were written by one run. Run events come from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.text import category
from evidencelake.operators import changelog, knowledge, topk
from evidencelake.plans.registry import Tables, query
from evidencelake.sources import tables as table_sources
from evidencelake.sources import versions

STORE = """
store AS (SELECT CASE lang WHEN 'en' THEN 'table' WHEN 'fr' THEN 'metric' WHEN 'de' THEN 'convention' ELSE 'guide' END || ':' || source AS entity, text AS definition_md,
  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, CAST(doc_id + 1 AS INTEGER) AS version, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT)) AS updated_at,
  CASE WHEN doc_id % 10 < 3 THEN 'base_context.md' WHEN doc_id % 10 = 3 THEN 'data_audit_' || (doc_id % 4) ELSE 'spec_' || (doc_id % 7) END AS source_spec,
  'run_' || (doc_id // 25) AS run_id, doc_id FROM documents)
"""


def store(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "table").when(F.col("lang") == "fr", "metric").when(F.col("lang") == "de", "convention").otherwise("guide")
    spec = (
        F.when(i % 10 < 3, "base_context.md").when(i % 10 == 3, F.concat(F.lit("data_audit_"), (i % 4).cast("string")))
        .otherwise(F.concat(F.lit("spec_"), (i % 7).cast("string")))
    )
    return t.documents.select(
        F.concat(kind, F.lit(":"), F.col("source")).alias("entity"), F.col("text").alias("definition_md"), (i + 1).cast("int").alias("version"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=i.cast("int"))).alias("updated_at"), spec.alias("source_spec"),
        F.lit("").alias("change_note"), F.concat(F.lit("run_"), F.floor(i / 25).cast("string")).alias("run_id"), "doc_id",
    )


@query("TOP1 KNO1 SRC11", f"""
WITH {STORE} SELECT entity, version, doc_id FROM store QUALIFY row_number() OVER (PARTITION BY entity ORDER BY version DESC) = 1""")
def latest_version(t: Tables) -> DataFrame:
    """The entry in force per entity."""
    return topk.latest_version(store(t).select("entity", "version", "doc_id"))


@query("SRC11 AGG7", """
WITH u AS (SELECT user_id AS k, event_id AS v, event_type AS status, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS deleted FROM events),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1) SELECT k, v, status FROM l WHERE deleted = 0""")
def last_writes(t: Tables) -> DataFrame:
    """Last write per key, tombstones honoured."""
    u = t.events.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("deleted"),
    )
    return versions.latest_rows(u, ["k"], "v", "deleted").select("k", "v", "status")


@query("KNO1", f"""
WITH {STORE} SELECT entity, version, source_spec, version = max(version) OVER (PARTITION BY entity) AS current FROM store""")
def version_history(t: Tables) -> DataFrame:
    """Every version, the current one marked."""
    return knowledge.history(store(t)).select("entity", "version", "source_spec", "current")


@query("SRC10", f"""
WITH {STORE}, p AS (SELECT DISTINCT 'table:' || source AS entity FROM documents UNION SELECT 'metric:new_' || n_nationkey FROM nation),
m AS (SELECT entity, max(version) AS v FROM store GROUP BY 1)
SELECT p.entity, p.entity || ':v' || (coalesce(v, 0) + 1) AS entry_id, CAST(coalesce(v, 0) + 1 AS INTEGER) AS version FROM p LEFT JOIN m USING (entity)""")
def next_version(t: Tables) -> DataFrame:
    """Proposed entries with their next version."""
    proposed = (
        t.documents.select(F.concat(F.lit("table:"), "source").alias("entity")).distinct()
        .unionByName(t.nation.select(F.concat(F.lit("metric:new_"), F.col("n_nationkey").cast("string")).alias("entity")))
        .withColumns({"definition_md": F.lit("d"), "change_note": F.lit("n")})
    )
    rows = versions.append_versions(store(t), proposed, F.lit("2025-01-01").cast("timestamp"), "spec_x", "run_x")
    return rows.select("entity", "entry_id", "version")


@query("KNO2 HYG11", f"""
WITH {STORE}, l AS (SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY entity ORDER BY version DESC) = 1)
SELECT entity, version FROM l WHERE split_part(entity, ':', 1) IN ('overview', 'convention', 'guide', 'join_map', 'entity', 'metric')
 OR contains(lower(entity || ' ' || definition_md), 'token') OR contains(lower(entity || ' ' || definition_md), 'license')""")
def context_selection(t: Tables) -> DataFrame:
    """Core and included categories plus entries that mention a topic term."""
    return knowledge.select_context(store(t), include=["metric"], topic="is a Token, or license").select("entity", "version")


@query("KNO3", f"""
WITH {STORE}, l AS (SELECT DISTINCT entity FROM store WHERE entity LIKE 'metric:%'), r AS (SELECT 'metric:' || source AS required FROM documents UNION SELECT 'guide' UNION SELECT 'metric' UNION SELECT 'metric:zz')
SELECT required FROM r WHERE CASE WHEN contains(required, ':') THEN required NOT IN (SELECT entity FROM l) ELSE required NOT IN (SELECT split_part(entity, ':', 1) FROM l) END""")
def missing_required(t: Tables) -> DataFrame:
    """Required entities and categories a bundle lacks."""
    bundle = store(t).filter(category(F.col("entity")) == "metric").select("entity").distinct()
    k = F.col("n_nationkey")
    extra = F.when(k % 3 == 0, "guide").when(k % 3 == 1, "metric").otherwise("metric:zz")
    needs = t.documents.select(F.concat(F.lit("metric:"), "source").alias("required")).distinct()
    needs = needs.unionByName(t.nation.select(extra.alias("required")))
    return knowledge.missing_required(bundle, needs)


@query("KNO5", f"""
WITH {STORE}, l AS (SELECT entity, max(version) AS version FROM store GROUP BY 1),
b AS (SELECT sum(('0x' || substr(md5(entity || '@' || version), 1, 15))::BIGINT) AS a, sum(('0x' || substr(md5(entity || '@' || version), 16, 15))::BIGINT) AS b, count(*) AS n FROM l)
SELECT substr(sha1(a || '|' || b || '|' || n), 1, 10) AS stamp, n AS entities_n FROM b""")
def version_stamp(t: Tables) -> DataFrame:
    """Digest of every definition in force."""
    return knowledge.version_stamp(store(t).select("entity", "version"))


@query("KNO5", """
WITH t AS (SELECT count(*) AS rows, max(o_orderdate) AS m FROM orders UNION ALL SELECT count(*), max(l_shipdate) FROM lineitem UNION ALL SELECT count(*), max(ts) FROM events)
SELECT CAST(sum(rows) AS BIGINT) AS rows, strftime(max(m), '%Y-%m-%d') AS changed, substr(sha1(CAST(CAST(sum(rows) AS BIGINT) AS VARCHAR) || '|' || strftime(max(m), '%Y-%m-%d')), 1, 10) AS stamp FROM t""")
def data_stamp(t: Tables) -> DataFrame:
    """Stamp of what the tables hold."""
    facts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("modified_at"))
        for df, ts in ((t.orders, "o_orderdate"), (t.lineitem, "l_shipdate"), (t.events, "ts"))
    ]
    return knowledge.data_stamp(facts[0].unionByName(facts[1]).unionByName(facts[2])).withColumnRenamed("modified_at", "changed")


@query("KNO6", r"""
WITH h AS (SELECT conv_id, substr(sha1(string_agg(role || ':' || text, '|' ORDER BY turn)), 1, 10) AS hd FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12) GROUP BY 1)
SELECT conv_id, turn, substr(sha256('v4::' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || '::ctx:data::' || CAST(conv_id AS VARCHAR) || '::' || hd || '::'), 1, 32) AS cache_key FROM conversations JOIN h USING (conv_id)""")
def cache_keys(t: Tables) -> DataFrame:
    """Answer-cache keys of every turn."""
    from evidencelake.operators.conversations import history_digest

    messages = t.conversations.withColumnRenamed("turn", "seq")
    keyed = messages.join(history_digest(messages), "conv_id")
    key = knowledge.cache_key(F.col("text"), F.lit("ctx:data"), F.col("conv_id").cast("string"), F.col("history_digest"), F.lit(""))
    return keyed.select("conv_id", F.col("seq").alias("turn"), key.alias("cache_key"))


@query("KNO6 SRC11", r"""
WITH c AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS cache_key, doc_id, CAST(doc_id AS VARCHAR) AS insight_json FROM (SELECT doc_id, text FROM documents UNION ALL SELECT item_id, upper(text) FROM benchmark)),
n AS (SELECT cache_key, arg_max(insight_json, doc_id) AS insight_json FROM c GROUP BY 1)
SELECT DISTINCT b.item_id, n.insight_json FROM benchmark b JOIN n ON n.cache_key = trim(regexp_replace(lower(b.text), '\s+', ' ', 'g'))""")
def cache_lookup(t: Tables) -> DataFrame:
    """The newest stored answer per key."""
    key = knowledge.cache_key(F.col("text"), F.lit("ctx:data"), F.lit("c"), F.lit(""), F.lit("")).alias("cache_key")
    # asked before in other letters: the key folds case and white space
    answered = t.documents.select("doc_id", "text").unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"), F.upper("text").alias("text")))
    cache = answered.select(key, F.col("doc_id").cast("string").alias("insight_json"), F.col("doc_id").alias("created_at"))
    return knowledge.cached_answers(t.benchmark.select("item_id", key), cache).select("item_id", "insight_json")


@query("KNO7 AGG8 JON9", f"""
WITH {STORE} SELECT substr(entity, 7) AS "table", CASE WHEN arg_min(source_spec, version) = 'base_context.md' THEN 'base' ELSE 'agent' END AS origin FROM store WHERE starts_with(entity, 'table:') GROUP BY entity""")
def table_origins(t: Tables) -> DataFrame:
    """Base or agent-made, by the source of an entity's first version."""
    return knowledge.table_origins(store(t))


@query("KNO8 HYG12 AGG16", f"""
WITH {STORE}, p AS (SELECT *, source_spec IN ('base_context.md', 'data_audit') OR starts_with(source_spec, 'base_context.md_') OR starts_with(source_spec, 'data_audit_') AS prot FROM store)
SELECT source_spec, count(*) AS rows_n FROM p WHERE prot OR source_spec != 'spec_3' GROUP BY 1""")
def source_removal(t: Tables) -> DataFrame:
    """The store without one spec's rows; protected sources stay even when named."""
    s = store(t)
    gone = s.filter(F.col("source_spec").isin("spec_3", "data_audit_1")).select("source_spec")
    return knowledge.remove_sources(s, gone).groupBy("source_spec").agg(F.count(F.lit(1)).alias("rows_n"))


@query("KNO8", f"""WITH {STORE} SELECT DISTINCT source_spec FROM store WHERE source_spec LIKE 'spec%'""")
def removable_sources(t: Tables) -> DataFrame:
    """Sources a reset may remove."""
    return knowledge.removable_sources(store(t))


@query("KNO9", f"""
WITH {STORE}, prop AS (SELECT DISTINCT substr(entity, 7) AS t FROM store WHERE entity LIKE 'table:%' AND version % 2 = 0), made AS (SELECT DISTINCT source AS t FROM documents UNION SELECT 'extra_' || n_nationkey FROM nation),
known AS (SELECT DISTINCT substr(entity, 7) AS t FROM store WHERE entity LIKE 'table:%' AND version < 3)
SELECT t AS "table", 'missing' AS problem FROM made WHERE t NOT IN (SELECT t FROM prop)
UNION ALL SELECT t, 'phantom' FROM prop WHERE t NOT IN (SELECT t FROM made) AND t NOT IN (SELECT t FROM known)""")
def proposal_coverage(t: Tables) -> DataFrame:
    """Created tables without an entry, entries without a table."""
    s = store(t)
    made = t.documents.select(F.col("source").alias("table")).unionByName(t.nation.select(F.concat(F.lit("extra_"), F.col("n_nationkey").cast("string")).alias("table")))
    return knowledge.coverage_problems(s.filter("version % 2 = 0"), made, s.filter("version < 3"))


@query("CHG1", f"""
WITH {STORE}, b AS (SELECT run_id, min(updated_at) AS t0 FROM store GROUP BY 1), o AS (SELECT run_id, row_number() OVER (ORDER BY t0, run_id) - 1 AS i FROM b)
SELECT run_id, CAST(i AS BIGINT) AS ordinal, 'v' || (1 + i // 10) || '.' || (i % 10) AS version_label FROM o""")
def version_labels(t: Tables) -> DataFrame:
    """Global version label of every write batch."""
    return changelog.batch_versions(store(t)).select("run_id", F.col("ordinal").cast("bigint").alias("ordinal"), "version_label")


@query("CHG2", f"""
WITH {STORE}, s2 AS (SELECT *, CASE WHEN version % 3 = 0 THEN 1 ELSE version END AS v FROM store),
n AS (SELECT run_id, entity, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN v > 1 THEN 0 ELSE 1 END, updated_at, entity, v) AS i FROM s2),
c AS (SELECT run_id, count(*) FILTER (WHERE v = 1) AS cr, count(*) FILTER (WHERE v > 1) AS su FROM s2 GROUP BY 1), m AS (SELECT run_id, string_agg(entity, ', ' ORDER BY i) AS names FROM n WHERE i <= 3 GROUP BY 1)
SELECT run_id, cr AS created_n, su AS superseded_n, concat_ws(' · ', CASE WHEN cr > 0 THEN '+' || cr || CASE WHEN cr = 1 THEN ' entry added' ELSE ' entries added' END END,
 CASE WHEN su > 0 THEN su || CASE WHEN su = 1 THEN ' definition replaced' ELSE ' definitions replaced' END END, names) AS description, su > 0 AS warn FROM c JOIN m USING (run_id)""")
def batch_descriptions(t: Tables) -> DataFrame:
    """What each batch added and replaced."""
    s = store(t).withColumn("version", F.when(F.col("version") % 3 == 0, 1).otherwise(F.col("version")))
    return changelog.batch_descriptions(s).select("run_id", "created_n", "superseded_n", "description", "warn")


RUNS = """
runs AS (SELECT 'run_' || user_id AS run_id, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'spec_' || (user_id % 9) END AS spec, CAST(event_id AS INTEGER) AS seq, ts,
 CASE event_type WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_end' WHEN 'error' THEN 'step_error' WHEN 'signup' THEN 'approval_result' ELSE 'status' END AS type,
 CASE WHEN event_type = 'purchase' THEN ['running', 'succeeded', 'failed'][event_id % 3 + 1] WHEN event_type = 'signup' THEN 'ddl' ELSE ['profile', 'context_load', 'dry_run_1', 'ddl_execution_attempt_1', 'instrumentation'][event_id % 5 + 1] END AS name,
 CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN '{"traceUrl":"' || CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE '' END || '"}'
      WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN '{"tables":[{"name":"ta_' || (event_id % 7) || '","rowsLoaded":' || event_id || '},{"name":"tb","rowsLoaded":' || user_id || '}]}'
      WHEN event_type = 'signup' THEN '{"identity":"u' || (event_id % 3) || '"}' WHEN event_id % 5 = 4 THEN '{"input":{"specDir":"/x/uploads/0' || (event_id % 6) || '_thing_msagtujv"}}' ELSE '{}' END AS payload FROM events)
"""


def runs_log(t: Tables) -> DataFrame:
    """Run events derived from ``events``: one run per user."""
    i, k, u = F.col("event_id"), F.col("event_type"), F.col("user_id")
    s = lambda c: c.cast("string")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (i % n).cast("int"))
    kind = F.when(k == "view", "step_start").when(k == "click", "step_end").when(k == "error", "step_error").when(k == "signup", "approval_result").otherwise("status")
    name = (
        F.when(k == "purchase", pick(["running", "succeeded", "failed"], 3)).when(k == "signup", "ddl")
        .otherwise(pick(["profile", "context_load", "dry_run_1", "ddl_execution_attempt_1", "instrumentation"], 5))
    )
    payload = (
        F.when((k == "purchase") & (i % 3 == 0), F.concat(F.lit('{"traceUrl":"'), F.when(i % 2 == 0, F.concat(F.lit("t"), s(i))).otherwise(""), F.lit('"}')))
        .when((k == "purchase") & (i % 3 == 1), F.concat(F.lit('{"tables":[{"name":"ta_'), s(i % 7), F.lit('","rowsLoaded":'), s(i), F.lit('},{"name":"tb","rowsLoaded":'), s(u), F.lit("}]}")))
        .when(k == "signup", F.concat(F.lit('{"identity":"u'), s(i % 3), F.lit('"}')))
        .when((i % 5 == 4) & (k != "purchase"), F.concat(F.lit('{"input":{"specDir":"/x/uploads/0'), s(i % 6), F.lit('_thing_msagtujv"}}')))
        .otherwise("{}")
    )
    return t.events.select(
        F.concat(F.lit("run_"), s(u)).alias("run_id"), F.when(u % 4 == 0, "").otherwise(F.concat(F.lit("spec_"), s(u % 9))).alias("spec"),
        i.cast("int").alias("seq"), "ts", kind.alias("type"), name.alias("name"), payload.alias("payload"), F.lit("").alias("phase"),
    )


@query("CHG3 AGG9", f"""
WITH {RUNS}
SELECT run_id, arg_max(json_extract_string(payload, '$.traceUrl'), seq) FILTER (WHERE type = 'status' AND name = 'running' AND json_extract_string(payload, '$.traceUrl') != '') AS trace_url,
 arg_max(json_extract_string(payload, '$.identity'), seq) FILTER (WHERE type = 'approval_result') AS identity,
 coalesce(arg_max(spec, seq) FILTER (WHERE spec != ''), arg_max(regexp_extract(json_extract_string(payload, '$.input.specDir'), '(0[0-9]_thing)_', 1), seq) FILTER (WHERE type = 'step_start' AND name = 'instrumentation')) AS spec,
 CAST(floor(epoch(max(ts) FILTER (WHERE type = 'status' AND name = 'succeeded'))) AS BIGINT) AS succeeded_at FROM runs GROUP BY run_id""")
def run_facts(t: Tables) -> DataFrame:
    """Trace, approver, spec and success time of every run."""
    return changelog.run_facts(runs_log(t)).withColumn("succeeded_at", F.unix_timestamp("succeeded_at"))


@query("CHG3", f"""
WITH {RUNS}, l AS (SELECT run_id, arg_max(payload, seq) AS p FROM runs WHERE type = 'status' AND name = 'succeeded' GROUP BY 1)
SELECT run_id, CAST(0 AS INTEGER) AS position, json_extract_string(p, '$.tables[0].name') AS "table", CAST(json_extract_string(p, '$.tables[0].rowsLoaded') AS BIGINT) AS rows FROM l
UNION ALL SELECT run_id, 1, json_extract_string(p, '$.tables[1].name'), CAST(json_extract_string(p, '$.tables[1].rowsLoaded') AS BIGINT) FROM l""")
def run_tables(t: Tables) -> DataFrame:
    """Tables each run created."""
    return changelog.run_tables(runs_log(t))


@query("CHG4 SET2 JON9 TOP8", f"""
WITH {STORE}, {RUNS}, ev AS (SELECT * FROM runs WHERE (type = 'status' AND name IN ('running', 'succeeded', 'failed')) OR type = 'approval_result' OR (type = 'step_start' AND name = 'instrumentation')),
b AS (SELECT run_id, min(updated_at) AS t0, max(updated_at) AS last FROM store GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY t0, run_id) - 1 AS i, row_number() OVER (ORDER BY last DESC, run_id) AS r, count(*) OVER () AS c FROM b),
rb AS (SELECT run_id, max(ts) AS last FROM ev GROUP BY 1), ro AS (SELECT *, row_number() OVER (ORDER BY last DESC, run_id) AS r, count(*) OVER () AS c FROM rb),
su AS (SELECT run_id, max(ts) AS t0, arg_max(payload, seq) AS p FROM ev WHERE type = 'status' AND name = 'succeeded' GROUP BY 1)
SELECT 'ctx:' || run_id AS id, 'context' AS kind, 'context v' || (1 + i // 10) || '.' || (i % 10) AS title, false AS truncated FROM o
UNION ALL SELECT 'tables:' || ro.run_id, 'table', json_extract_string(p, '$.tables[0].name') || ' + 1 more created', false FROM ro JOIN su USING (run_id)""")
def changelog_entries(t: Tables) -> DataFrame:
    """The merged changelog of all batches and runs."""
    return changelog.changelog(store(t), runs_log(t)).select("id", "kind", "title", "truncated")


@query("TOP8", """
WITH g AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), r AS (SELECT conv_id, row_number() OVER (ORDER BY last DESC, conv_id) AS i, count(*) OVER () AS c FROM g)
SELECT conv_id, turn, role, c > 30 AS truncated FROM conversations JOIN r USING (conv_id) WHERE i <= 30""")
def whole_group_cap(t: Tables) -> DataFrame:
    """Thirty whole conversations, never a partial one, and whether more exist."""
    return topk.newest_groups(t.conversations, "conv_id", "turn", 30).select("conv_id", "turn", "role", "truncated")


@query("AGG11", """
WITH c AS (SELECT source AS "table", lang AS name, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT "table", '- ' || "table" || ': ' || string_agg(name || ' ' || n, ', ' ORDER BY name) AS line FROM c GROUP BY "table\"""")
def schema_lines(t: Tables) -> DataFrame:
    """One line per table listing its columns."""
    c = t.documents.groupBy(F.col("source").alias("table"), F.col("lang").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("type"))
    return table_sources.schema_lines(c.withColumn("position", F.col("name")))
