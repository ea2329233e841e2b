"""The append-only definition store: selection, reconciliation, stamps and cache keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.text import category, collapse, entity_name, mentions_any, question_terms
from evidencelake.operators.topk import latest_version

# Fixed values.
CORE_CATEGORIES = ("overview", "convention", "guide", "join_map", "entity")
SEED_SOURCE = "base_context.md"
PROTECTED_SOURCES = ("base_context.md", "data_audit")
INTERNAL_TABLES = (
    "context_store", "runs_log", "conversations", "messages", "dashboards",
    "optimization_suggestions", "schema_changelog", "trace_summaries", "insight_cache", "run_summary",
)
ANSWER_FORMAT = "v4"
STAMP_CHARS, KEY_CHARS = 10, 32


def history(store: DataFrame) -> DataFrame:
    """Every version of every entity with whether it is the one in force."""
    latest = store.groupBy("entity").agg(F.max("version").alias("_latest"))
    return store.join(latest, "entity").withColumn("current", F.col("version") == F.col("_latest")).drop("_latest")


def select_context(
    store: DataFrame, core: Sequence[str] = CORE_CATEGORIES, include: Sequence[str] = (), topic: Column | str | None = None
) -> DataFrame:
    """Latest entries that are core, in an included category (``*`` for all), or mention a topic term."""
    latest = latest_version(store)
    if "*" in include:
        return latest
    wanted = category(F.col("entity")).isin(*core, *include)
    if topic is not None:
        terms = question_terms(F.lit(topic) if isinstance(topic, str) else topic, longer_than=2)
        wanted = wanted | mentions_any(F.concat_ws(" ", "entity", "definition_md"), terms)
    return latest.filter(wanted)


def missing_required(bundle: DataFrame, required: DataFrame) -> DataFrame:
    """Required entities (``a:b``) or categories (``a``) the bundle does not hold."""
    names = bundle.select(F.explode(F.array("entity", category(F.col("entity")))).alias("required")).distinct()
    return required.select("required").distinct().join(names, "required", "left_anti")


def version_stamp(store: DataFrame, entity: str = "entity", version: str = "version") -> DataFrame:
    """One short digest of every (entity, version) in force.

    Each entry's digest is cut into two numbers whose sums do not depend on any order, so nothing is gathered; any
    added, removed or revised entry changes them.
    """
    digest = F.md5(F.concat_ws("@", F.col(entity), F.col(version).cast("string")))
    number = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = latest_version(store, entity, version).agg(number(1).alias("a"), number(16).alias("b"), F.count(F.lit(1)).alias("entities_n"))
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("a", "b", "entities_n")])
    return sums.select(F.left(F.sha1(text), F.lit(STAMP_CHARS)).alias("stamp"), "entities_n")


def data_stamp(tables: DataFrame) -> DataFrame:
    """Stamp of what the tables hold: ``tables(rows, modified_at)`` -> rows, latest change, digest."""
    facts = tables.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("modified_at").alias("modified_at"))
    text = F.concat_ws("|", F.col("rows").cast("string"), F.coalesce(F.col("modified_at").cast("string"), F.lit("")))
    return facts.withColumn("stamp", F.left(F.sha1(text), F.lit(STAMP_CHARS)))


def cache_key(question: Column, context_key: Column, conv: Column, history_digest: Column, related_digest: Column) -> Column:
    """What must be unchanged for a stored answer to be a replay."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.lit(ANSWER_FORMAT), collapse(F.lower(question)), context_key, blank(conv), blank(history_digest), blank(related_digest)]
    return F.left(F.sha2(F.concat_ws("::", *parts), 256), F.lit(KEY_CHARS))


def cached_answers(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """The newest stored answer per cache key, for the questions that have one."""
    newest = cache.groupBy("cache_key").agg(F.max_by("insight_json", "created_at").alias("insight_json"))
    return questions.join(newest, "cache_key")


def table_origins(store: DataFrame) -> DataFrame:
    """``(table, origin)``: base when the entity's first version came from the seed, internal by name, else agent."""
    first = (
        store.filter(F.startswith("entity", F.lit("table:")))
        .groupBy("entity")
        .agg(F.min_by("source_spec", "version").alias("first_source"))
    )
    table = entity_name(F.col("entity"))
    return first.select(table.alias("table"), origin(table, F.col("first_source") == SEED_SOURCE).alias("origin"))


def origin(table: Column, is_base: Column) -> Column:
    return (
        F.when(table.isin(*INTERNAL_TABLES), "internal")
        .when(F.coalesce(is_base, F.lit(False)), "base")
        .otherwise("agent")
    )


def is_protected(source: Column) -> Column:
    """Sources that survive every reset: an exact name, or one extended with ``_``."""
    hit = F.lit(False)
    for p in PROTECTED_SOURCES:
        hit = hit | (source == p) | F.startswith(source, F.lit(f"{p}_"))
    return hit


def removable_sources(store: DataFrame) -> DataFrame:
    return store.select("source_spec").distinct().filter(~is_protected(F.col("source_spec")))


def remove_sources(store: DataFrame, sources: DataFrame) -> DataFrame:
    """The store without the rows of the given sources; protected ones are never removed."""
    gone = sources.select("source_spec").distinct().filter(~is_protected(F.col("source_spec")))
    return store.join(gone, "source_spec", "left_anti")


def coverage_problems(proposed: DataFrame, created: DataFrame, existing: DataFrame) -> DataFrame:
    """``(table, problem)``: created tables without an entry, and table entries naming nothing created or known."""
    proposed_tables = (
        proposed.filter(F.startswith("entity", F.lit("table:"))).select(entity_name(F.col("entity")).alias("table")).distinct()
    )
    made = created.select("table").distinct()
    documented = existing.filter(F.startswith("entity", F.lit("table:"))).select(entity_name(F.col("entity")).alias("table"))
    missing = made.join(proposed_tables, "table", "left_anti").withColumn("problem", F.lit("missing"))
    phantom = proposed_tables.join(made.unionByName(documented).distinct(), "table", "left_anti").withColumn(
        "problem", F.lit("phantom")
    )
    return missing.unionByName(phantom)
