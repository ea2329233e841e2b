"""Newline-delimited JSON events with a schema that may differ on every line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_EVENT = "unknown_event"
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_lines(lines: DataFrame, mode: str = "skip", text: str = "value") -> DataFrame:
    """Add ``record map<string, variant>`` and ``event`` to a frame of text lines; blank lines go.

    ``mode="skip"`` drops malformed lines, ``"fail"`` raises on the first one, ``"keep"`` leaves their record NULL.
    """
    if mode not in ("skip", "fail", "keep"):
        raise ValueError(f"unknown mode {mode!r}")
    # read as the only element of a list: text after the object then breaks the list instead of being ignored
    listed = F.from_json(F.concat(F.lit("["), F.col(text), F.lit("]")), "array<map<string,variant>>", STRICT_JSON)
    record = F.transform(F.array(listed), lambda r: F.when(F.size(r) == 1, last_of_repeated(F.get(r, F.lit(0)))))
    # taken out by a generator, which filters are not pushed through: the text is made and parsed once
    read = F.explode_outer(F.array(F.struct(F.col(text).rlike(r"\S").alias("written"), F.get(record, F.lit(0)).alias("record"))))
    parsed = lines.select("*", read.alias("_read")).filter("_read.written").select(*lines.columns, "_read.record")
    if mode == "skip":
        parsed = parsed.filter(F.col("record").isNotNull())
    elif mode == "fail":
        broken = F.raise_error(F.concat(F.lit("malformed line: "), F.left(F.col(text), F.lit(200))))
        parsed = parsed.withColumn("record", F.when(F.col("record").isNull(), broken.cast("map<string,variant>")).otherwise(F.col("record")))
    return parsed.withColumn("event", event_name(F.col("record")))


def last_of_repeated(record: Column) -> Column:
    """A key written twice keeps its place and takes its last value."""
    keys = F.map_keys(record)
    last = lambda k: F.element_at(F.filter(F.map_entries(record), lambda e: e["key"] == k), -1)
    rebuilt = F.map_from_entries(F.transform(F.array_distinct(keys), last))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), rebuilt).otherwise(record)


def event_name(record: Column) -> Column:
    """The discriminator as text; a missing or null one is ``unknown_event``."""
    return F.coalesce(F.try_variant_get(F.element_at(record, F.lit("event")), "$", "string"), F.lit(UNKNOWN_EVENT))


def read_ndjson(spark: SparkSession, path: str, mode: str = "skip") -> DataFrame:
    """``(file, value, record, event)`` per line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_lines(lines, mode)


def _flat_pairs(record: Column) -> Column:
    """``array<struct<name, v>>``: one level of nesting joined with ``_``, the discriminator dropped."""
    entries = F.filter(F.map_entries(record), lambda e: e["key"] != "event")
    pair = lambda name, v: F.struct(name.alias("name"), v.alias("v"))
    # NULL unless the value is an object
    members = lambda e: F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))
    nested = F.transform(
        entries,
        lambda e: F.coalesce(
            F.transform(members(e), lambda c: pair(F.concat(e["key"], F.lit("_"), c["key"]), c["value"])),
            F.array(pair(e["key"], e["value"])),
        ),
    )
    return F.flatten(nested)


def _unique_names(names: Column) -> Column:
    """A name already taken gets the first free ``__2``, ``__3``, ... suffix."""

    def free_name(taken: Column, name: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(taken) + 2), lambda i: F.concat(name, F.lit("__"), i.cast("string"))
        )
        free = F.get(F.filter(numbered, lambda c: ~F.array_contains(taken, c)), F.lit(0))
        return F.when(F.array_contains(taken, name), free).otherwise(name)

    def suffixed(ns: Column) -> Column:
        one_by_one = F.aggregate(
            ns, F.array().cast("array<string>"), lambda taken, name: F.concat(taken, F.array(free_name(taken, name)))
        )
        # no written name can be a numbered one: the number is how often the name came before
        before = lambda name, i: F.size(F.filter(F.slice(ns, 1, i), lambda n: n == name))
        counted = F.transform(
            ns, lambda name, i: F.when(F.array_position(ns, name) <= i, F.concat(name, F.lit("__"), (before(name, i) + 1).cast("string"))).otherwise(name)
        )
        return F.when(F.exists(ns, lambda n: F.contains(n, F.lit("__"))), one_by_one).otherwise(counted)

    # bound as a variable: the names are taken out once
    bound = F.transform(F.array(names), lambda ns: F.when(F.size(F.array_distinct(ns)) < F.size(ns), suffixed(ns)).otherwise(ns))
    return F.get(bound, F.lit(0))


def _zero_one(v: Column) -> Column:
    as_number = F.when(F.try_variant_get(v, "$", "boolean"), F.parse_json(F.lit("1"))).otherwise(F.parse_json(F.lit("0")))
    return F.when(F.schema_of_variant(v) == "BOOLEAN", as_number).otherwise(v)


def flatten_events(records: DataFrame) -> DataFrame:
    """Replace ``record`` with ``fields map<string, variant>``: one level flattened, booleans as 0/1, arrays kept."""
    flat = records.withColumn("_flat", _flat_pairs(F.col("record"))).drop("record")
    named = flat.withColumn("_names", _unique_names(F.transform("_flat", lambda x: x["name"])))
    values = F.transform("_flat", lambda x: _zero_one(x["v"]))
    return named.withColumn("fields", F.map_from_arrays("_names", values)).drop("_flat", "_names")


def source_facts(lines: DataFrame) -> DataFrame:
    """Rows and distinct event types per file; a bad line counts as a row, not as a type.

    ``lines`` come from :func:`parse_lines` with ``mode="keep"`` and carry ``file``.
    """
    name = F.coalesce(F.try_variant_get(F.element_at("record", F.lit("event")), "$", "string"), F.lit(""))
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("events_n"),
        F.count_distinct(F.when(F.col("record").isNotNull(), name)).alias("event_types_n"),
    )
