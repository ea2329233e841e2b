"""Field profiles of schemaless events, and the types and layout they recommend.

Values are folded to distinct (event, field, text) first; every statistic is then a sum over that, so a field
with one value in every row of a huge event costs one row per task.

A profile can also be kept as a state of each file (:func:`save_profile_states`): sums and least texts per field, and a digest of every different value.
States merge to the very profile of all files together (:func:`read_profile`), so that a new file is profiled alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.functions.names import IDENTIFIER_NAME, MONEY_NAME
from evidencelake.functions.stats import ratio
from evidencelake.operators.joins import first_per_key
from evidencelake.session import materialise

# Fixed values.
SAMPLES = 5
LOW_CARDINALITY = 1000
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
HEX_ID = r"(?i)^[0-9a-f]{32}$"
NULL_TEXT = "__null__"
DIMENSIONS = ("device_type", "os", "geoip_country_code", "destination")
JOIN_KEYS = ("application_id", "share_id", "group_id", "user_id")
ENVELOPE = (
    "id", "timestamp", "user_id", "application_id", "app_session_id", "device", "device_type", "os", "app_version",
    "client_lib", "geoip_country_code", "geoip_subdivision_1_code", "city", "client_ip", "latitude", "longitude",
    "locale", "language", "funnel_type", "co_travelers", "citizenship", "destination", "is_guest", "is_referral",
    "is_enterprise", "is_guest_browse", "gclid", "fbclid", "gad_source", "is_back_filled", "duplicate_id",
)


def value_text(v: Column, kind: Column) -> Column:
    """A value of a variant type as it would be printed: numbers without a trailing ``.0``, objects and arrays as JSON."""
    text = F.try_variant_get(v, "$", "string")
    whole = F.regexp_replace(text, r"\.0$", "")
    return F.when(kind.isin("DOUBLE", "FLOAT"), whole).otherwise(text)


def explode_fields(events: DataFrame, by: str = "event", fields: str = "fields", *also: str) -> DataFrame:
    """``(by, position, field, json_type, text)`` per present field, after the columns ``also``; a missing key yields no row.

    A record without any field yields one row with a NULL field, so records stay countable.
    """
    kind = F.col("kind")
    json_type = (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), "json").otherwise("number")
    )
    return (
        events.select(*also, by, F.posexplode_outer(F.map_entries(fields)).alias("position", "e"))
        .select(*also, by, "position", F.col("e.key").alias("field"), F.col("e.value").alias("v"), F.schema_of_variant("e.value").alias("kind"))
        .withColumn("json_type", F.when(F.col("field").isNotNull(), json_type))
        .select(
            *also, by, "position", "field", "json_type", value_text(F.col("v"), kind).alias("text"),
        )
    )


SUMS = ("nullish_n", "present_n", "booleans", "numbers", "timestamps", "objects", "fraction_n", "hex_n", "records")


def fold_values(cells: DataFrame, *keys: str) -> DataFrame:
    """One row per key, field and different value ``t``, with what a profile adds up of it."""
    text, json_type = F.col("text"), F.col("json_type")
    nullish = (json_type == "null") | (text == "")
    # NULL is a value too; the same printed text under two JSON types is one value
    value = F.when(json_type != "null", text).otherwise(NULL_TEXT).alias("t")
    of = lambda condition: F.count_if(condition & ~nullish)
    counted = cells.groupBy(*keys, "field", value).agg(
        F.min("position").alias("position"), F.count_if(nullish).alias("nullish_n"), of(F.lit(True)).alias("present_n"),
        of(json_type == "boolean").alias("booleans"), of(json_type == "number").alias("numbers"),
        of(json_type == "string").alias("strings"), of(json_type == "json").alias("objects"),
        # the first field of a record, or the stand-in of an empty one, counts the record
        F.count_if(F.coalesce("position", F.lit(0)) == 0).alias("records"),
    )
    # what a text looks like is asked once for each different one
    number = F.when(F.col("numbers") > 0, F.col("t").try_cast("double"))
    return counted.withColumn("number", number).select(
        "*", F.when(F.col("t").rlike(TIMESTAMP_TEXT), F.col("strings")).otherwise(0).alias("timestamps"),
        F.when(F.col("number") != F.floor("number"), F.col("numbers")).otherwise(0).alias("fraction_n"),
        F.when(F.col("t").rlike(HEX_ID), F.col("present_n")).otherwise(0).alias("hex_n"),
        F.when(F.col("present_n") > 0, F.length("t")).alias("longest"), F.col("number").alias("lowest"), F.col("number").alias("highest"),
    )


def _totals() -> list[Column]:
    return [F.min("position").alias("position"), *[F.sum(c).alias(c) for c in SUMS], F.max("longest").alias("longest"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest")]


def _least_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest of the different texts ``t`` per key, as an array."""
    return first_per_key(texts, keys, [F.col("t")], SAMPLES).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("samples"))


def profile_cells(cells: DataFrame, by: str = "event") -> DataFrame:
    """Profile from :func:`explode_fields` rows. Every statistic covers all values; samples are the smallest texts."""
    folded = fold_values(cells, by)
    stats = folded.groupBy(by, "field").agg(*_totals(), F.count(F.lit(1)).alias("distinct_n"))
    present = folded.filter("present_n > 0 AND field IS NOT NULL").select(by, "field", "t")
    return _described(stats, _least_texts(present, [by, "field"]), by)


def _described(stats: DataFrame, samples: DataFrame, by: str) -> DataFrame:
    """The profile of (by, field) totals and samples."""
    # as many rows per event as it has fields
    stats = stats.withColumn("rows_n", F.sum("records").over(Window.partitionBy(by))).filter(F.col("field").isNotNull())
    n = F.col("present_n")
    kind = (
        F.when(n == 0, "string").when(F.col("booleans") == n, "boolean").when(F.col("numbers") == n, "number")
        .when(F.col("timestamps") == n, "timestamp").when(F.col("objects") == n, "json").otherwise("string")
    )
    null_rate = F.floor(ratio(F.col("nullish_n"), F.col("rows_n")) * 1000 + 0.5) / 1000
    return (
        stats.join(samples, [by, "field"], "left")
        .withColumn("inferred_type", kind)
        .select(
            by, "field", "position", "inferred_type", null_rate.alias("null_rate"),
            "distinct_n", "present_n", "fraction_n", "hex_n", "rows_n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
            F.when(F.col("inferred_type").isin("string", "timestamp"), F.coalesce("longest", F.lit(0))).alias("max_length"),
            F.when(F.col("inferred_type") == "number", F.col("lowest")).alias("min_value"),
            F.when(F.col("inferred_type") == "number", F.col("highest")).alias("max_value"),
        )
    )


def profile_events(events: DataFrame, by: str = "event", fields: str = "fields") -> DataFrame:
    """Whole profile per event type (or per file): one row per (by, field).

    ``fields`` is the flattened map, or the raw ``record`` to profile before flattening. Samples are the five
    smallest texts, which does not depend on file order.
    """
    return profile_cells(explode_fields(events, by, fields), by)


def save_profile_states(events: DataFrame, folder: str, part: str = "file", by: str = "event", fields: str = "fields") -> None:
    """Add to the states in ``folder`` one for each ``part`` of ``events``, from these events alone. A part that is saved again replaces its own state.

    ``fields/`` holds a row per (part, by, field): totals and the least texts. ``values/`` holds the MD5 digest of each of its different values, so that different
    values are counted exactly over parts without keeping texts. Without events nothing is written. NULL is a part of its own.
    """
    keys = [part, by, "field"]
    folded = materialise(fold_values(explode_fields(events, by, fields, part), part, by), "folded")
    samples = _least_texts(folded.filter("present_n > 0 AND field IS NOT NULL").select(*keys, "t"), keys)
    named = lambda c: c.withColumnRenamed("field", "_f").withColumnRenamed(part, "_p").withColumnRenamed(by, "_b")
    same = F.col(part).eqNullSafe(F.col("_p")) & F.col(by).eqNullSafe(F.col("_b")) & (F.col("field") == F.col("_f"))
    totals = folded.groupBy(*keys).agg(*_totals()).join(named(samples), same, "left").drop("_p", "_b", "_f")
    values = folded.filter("field IS NOT NULL").select(*keys, F.unhex(F.md5("t")).alias("digest"))
    # values first: a part counts by its fields
    for rows, name in ((values, "values"), (totals, "fields")):
        laid = rows.repartitionByRange(*[F.col(c) for c in rows.columns if c in (*keys, "digest")])
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{folder}/{name}")


def merged_profile(totals: DataFrame, values: DataFrame, by: str = "event") -> DataFrame:
    """The profile of all parts together from their states; the same as :func:`profile_events` over all their events."""
    keys = [by, "field"]
    stats = totals.groupBy(*keys).agg(*_totals())
    different = values.select(*keys, "digest").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_n"))
    texts = totals.select(*keys, F.explode("samples").alias("t")).distinct()
    matched = stats.alias("s").join(different.alias("d"), F.col(f"s.{by}").eqNullSafe(F.col(f"d.{by}")) & (F.col("s.field") == F.col("d.field")), "left")
    return _described(matched.select("s.*", "distinct_n"), _least_texts(texts, keys), by)


def read_profile(spark: SparkSession, folder: str, by: str = "event") -> DataFrame:
    """The profile of all parts whose states are in ``folder``; a folder without any raises."""
    return merged_profile(spark.read.parquet(f"{folder}/fields"), spark.read.parquet(f"{folder}/values"), by)


def new_fields(profile: DataFrame, envelope: DataFrame | None = None, by: str = "event") -> DataFrame:
    """Fields outside the known envelope."""
    if envelope is None:
        return profile.filter(~F.col("field").isin(*ENVELOPE)).select(by, "field")
    return profile.select(by, "field").join(envelope.select("field").distinct(), "field", "left_anti").select(by, "field")


def recommend_types(profile: DataFrame) -> DataFrame:
    """Add ``source_type`` (the narrowest logical type), ``spark_type`` and ``type_note``."""
    field, t = F.col("field"), F.col("inferred_type")
    low, high = F.coalesce("min_value", F.lit(0.0)), F.coalesce("max_value", F.lit(0.0))
    money = field.rlike(MONEY_NAME)
    fractional = (F.col("fraction_n") > 0) | money
    identifier = field.rlike(IDENTIFIER_NAME)
    hex_id = (F.col("present_n") > 0) & (F.col("hex_n") == F.col("present_n"))
    small = F.col("distinct_n") < LOW_CARDINALITY
    positive = low >= 0
    base = (
        F.when(t == "timestamp", "DateTime64(3)").when(t == "boolean", "UInt8")
        .when((t == "number") & fractional & money, "Decimal64(2)").when((t == "number") & fractional, "Float64")
        .when((t == "number") & positive & (high < 256), "UInt8").when((t == "number") & positive & (high < 65536), "UInt16")
        .when((t == "number") & positive & (high < 4294967296), "UInt32").when(t == "number", "Int64")
        .when(t == "json", "String")
        .when(identifier & hex_id, "FixedString(32)").when(identifier, "String")
        .when(small, "LowCardinality(String)").otherwise("String")
    )
    defaulted = (t == "string") & (F.col("null_rate") > 0) & (base != "FixedString(32)")
    source_type = F.when(defaulted, F.concat(base, F.lit(" DEFAULT ''"))).otherwise(base)
    spark_type = (
        F.when(base == "DateTime64(3)", "timestamp").when(base == "UInt8", "smallint").when(base == "UInt16", "int")
        .when(base.isin("UInt32", "Int64"), "bigint").when(base == "Decimal64(2)", "decimal(18,2)")
        .when(base == "Float64", "double").otherwise("string")
    )
    whole = F.regexp_replace(high.cast("string"), r"\.0$", "")
    note = (
        F.when(t == "boolean", F.concat(field, F.lit(": a flag, kept as 0 or 1")))
        .when(base == "Decimal64(2)", F.concat(field, F.lit(": money, so Decimal64(2)")))
        .when((t == "number") & F.startswith(base, F.lit("UInt")), F.concat(field, F.lit(": largest "), whole, F.lit(", fits "), base))
        .when(base == "FixedString(32)", F.concat(field, F.lit(": always 32 hex digits, so FixedString(32)")))
        .when(base == "LowCardinality(String)", F.concat(field, F.lit(": "), F.col("distinct_n").cast("string"), F.lit(" values, so LowCardinality")))
    )
    return profile.select("*", source_type.alias("source_type"), spark_type.alias("spark_type"), note.alias("type_note"))


def recommend_layout(profile: DataFrame, by: str = "event") -> DataFrame:
    """Sort key per event: the never-null dimension with fewest values, the first never-null join key, the time.

    With neither, any never-null identifier leads. ``partition_by`` is monthly when there is a timestamp.
    """
    never_null = F.col("null_rate") == 0
    rank = lambda names: sum((F.when(F.col("field") == n, i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    pick = lambda condition, order: F.min(F.when(condition, F.struct(*order, F.col("field").alias("field"), F.col("distinct_n").alias("d"))))
    facts = profile.groupBy(by).agg(
        pick(F.col("field").isin(*DIMENSIONS) & never_null, [F.col("distinct_n"), rank(DIMENSIONS)]).alias("dim"),
        pick(F.col("field").isin(*JOIN_KEYS) & never_null, [rank(JOIN_KEYS)]).alias("key"),
        pick(F.col("field").rlike(IDENTIFIER_NAME) & never_null, [F.col("position")]).alias("id"),
        F.max(F.col("field") == "timestamp").alias("has_ts"),
    )
    ts = F.when(F.col("has_ts"), F.lit("timestamp"))
    lead, key, any_id = F.col("dim.field"), F.col("key.field"), F.col("id.field")
    # a key of the time alone is still a key: the identifier steps in only when nothing else is there
    standard = F.array_compact(F.array(lead, key, ts))
    fallback = F.when(any_id.isNotNull(), F.array(any_id))
    order_by = F.when(F.size(standard) > 0, standard).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))
    reasons = F.concat_ws(
        "; ",
        F.concat(lead, F.lit(" ("), F.col("dim.d").cast("string"), F.lit(" values) comes first to skip data")),
        F.concat(key, F.lit(" joins and is never empty")),
        F.when(F.col("has_ts"), "timestamp narrows time ranges"),
    )
    reason = (
        F.when(F.size(standard) > 0, reasons)
        .when(any_id.isNotNull(), F.concat(F.lit("none of the usual keys; "), any_id, F.lit(" is never empty and stands in")))
        .otherwise("no field is always there; time alone orders it")
    )
    return facts.select(
        by, order_by.alias("order_by"), F.when(F.col("has_ts"), "month(timestamp)").otherwise("").alias("partition_by"),
        reason.alias("reason"),
    )


def column_notes(typed: DataFrame, by: str = "event") -> DataFrame:
    """What a reader must know about each column, from its measurements."""
    t, low_card = F.col("inferred_type"), F.startswith("source_type", F.lit("LowCardinality"))
    whole = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    fact = (
        F.when(t == "timestamp", "when it happened, to the millisecond").when(t == "boolean", "0 or 1")
        .when(low_card, F.concat(F.col("distinct_n").cast("string"), F.lit(" different values")))
        .when(F.col("min_value").isNotNull(), F.concat(F.lit("range "), whole("min_value"), F.lit("–"), whole("max_value")))
        .when(F.col("field").rlike(IDENTIFIER_NAME), "an identifier, nearly unique")
    )
    empty = F.when(
        F.col("null_rate") > 0,
        F.concat(F.format_string("%.1f", F.col("null_rate") * 100), F.lit("% are empty: count them as 'unknown'")),
    )
    currency = F.when(F.col("field").rlike("(?i)currency"), "amounts of different currencies do not add up")
    text = F.concat_ws("; ", fact, empty, currency)
    return typed.select(by, "field", F.when(text != "", text).otherwise("no remark from its values").alias("note"))


def table_gotchas(typed: DataFrame, by: str = "event") -> DataFrame:
    """``(by, gotcha)`` rows: defaulted empties, missing hygiene columns, no session, several currencies."""
    has = lambda name: F.max(F.col("field") == name)
    defaulted = F.contains("source_type", F.lit("DEFAULT ''"))
    facts = typed.groupBy(by).agg(
        # at most one name per column of a table
        F.array_sort(F.collect_list(F.when(defaulted, F.struct("position", "field")))).alias("empties"),
        has("duplicate_id").alias("dup"), has("app_session_id").alias("session"),
        F.max(F.col("field").rlike("currency")).alias("currency"),
    )
    texts = F.array(
        F.when(
            F.size("empties") > 0,
            F.concat(F.lit("blanks occur in "), F.array_join(F.col("empties.field"), ", "),
                     F.lit(": report them as 'unknown', they are no group of their own")),
        ),
        F.when(~F.col("dup"), F.lit("without duplicate_id and is_back_filled there is nothing for the hygiene rules to filter")),
        F.when(~F.col("session"), F.lit("without app_session_id it has no sessions: use the join key")),
        F.when(F.col("currency"), F.lit("amounts come in several currencies: group by currency first")),
    )
    return facts.select(by, F.explode(F.array_compact(texts)).alias("gotcha"))


def schema_coverage(profile: DataFrame, declared: DataFrame, by: str = "event") -> DataFrame:
    """Measured fields a table lacks and declared columns never measured: ``declared(by, field)``."""
    m = profile.select(by, "field").distinct().withColumn("_m", F.lit(True))
    d = declared.select(by, "field").distinct().withColumn("_d", F.lit(True))
    return (
        m.join(d, [by, "field"], "full_outer")
        .filter(F.col("_m").isNull() | F.col("_d").isNull())
        .select(by, "field", F.when(F.col("_d").isNull(), "missing").otherwise("invented").alias("status"))
    )


def type_conflicts(typed: DataFrame, type_column: str = "spark_type") -> DataFrame:
    """Fields recommended more than one type across events, with the types (few by construction)."""
    kinds = typed.select("field", type_column).distinct()
    return (
        kinds.groupBy("field").agg(F.count(F.lit(1)).alias("types_n"), F.array_sort(F.collect_list(type_column)).alias("types"))
        .filter("types_n > 1")
    )
