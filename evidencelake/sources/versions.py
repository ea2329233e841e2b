"""Append-only stores and last-writer-wins tables on plain files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RUN_EVENT_COLUMNS = ("run_id", "spec", "seq", "ts", "type", "name", "payload", "phase")


def append_versions(store: DataFrame, proposed: DataFrame, now: Column, source_spec: str, run_id: str) -> DataFrame:
    """Proposed entries as rows to append: each entity's next version, bookkeeping filled in.

    ``proposed(entity, definition_md, change_note)``. The store is reduced to its maximum version per entity
    before the join.
    """
    current = (
        store.join(proposed.select("entity").distinct(), "entity", "left_semi")
        .groupBy("entity")
        .agg(F.max("version").alias("_v"))
    )
    version = F.coalesce(F.col("_v"), F.lit(0)) + 1
    return proposed.join(current, "entity", "left").select(
        F.concat(F.col("entity"), F.lit(":v"), version.cast("string")).alias("entry_id"),
        "entity", "definition_md", version.cast("int").alias("version"), now.alias("updated_at"),
        F.lit(source_spec).alias("source_spec"), "change_note", F.lit(run_id).alias("run_id"),
    )


def latest_rows(df: DataFrame, keys: Sequence[str], version: str, deleted: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The last write per key; a key whose last write is a tombstone is gone.

    A maximum over structs is combined map-side, so a key rewritten very often costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c != version and c not in ties]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(version, *ties, *rest), F.struct(version, *ties)).alias("_r"))
    out = packed.select(*keys, "_r.*").select(*df.columns)
    return out.filter(F.col(deleted) == 0) if deleted else out


RUN_EVENT_SCHEMA = "run_id string, spec string, seq int, ts timestamp, type string, name string, payload string, phase string, day date"


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path``; without rows while nothing was appended."""
    try:
        return spark.read.schema(RUN_EVENT_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_EVENT_SCHEMA)


def append_run_events(events: DataFrame, path: str) -> None:
    """Append run events that the log does not hold yet, one partition per day.

    An event is known by (run_id, seq): a batch that is sent again, wholly or in part, leaves no double, nor does one that repeats
    an event. Only the days of the batch are read of the log. One writer at a time. Runs jobs.
    """
    spark = events.sparkSession
    dated = events.withColumn("seq", F.col("seq").cast("int")).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    batch = dated.select(*RUN_EVENT_COLUMNS, "day").dropDuplicates(["run_id", "seq"])
    days = batch.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    held = read_run_events(spark, path).filter(F.col("day").between(F.lit(days["first"]), F.lit(days["last"])) | F.col("day").isNull())
    new = batch.join(held.select("run_id", "seq"), ["run_id", "seq"], "left_anti").select(*batch.columns)
    new.write.mode("append").partitionBy("day").parquet(path)


def sink_run_events(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The continuous form: each micro-batch is appended once, even when it is replayed after a failure.

    ``trigger`` is passed on; by default everything there is is taken, then the query ends.
    """
    write = lambda batch, _: append_run_events(batch, path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
