"""Continuous forms of the file intake and of the hourly log counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidencelake.sources.ndjson import flatten_events, parse_lines
from evidencelake.sources.tables import load_events


def stream_events(
    spark: SparkSession, path: str, out: str, checkpoint: str, mode: str = "fail", typed: Mapping[str, Sequence[tuple[str, str]]] | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in event files as they arrive, split by discriminator, each batch written once.

    A batch lands in its own directory and overwrites it, so a batch replayed after a failure replaces itself; files taken in are
    remembered in ``checkpoint``, so a second start reads only new ones. ``mode="fail"`` stops at a malformed line before anything
    of its batch is written; ``"keep"`` puts such lines into quarantine beside the others, ``"skip"`` drops them. ``typed`` names
    events that are also loaded into typed tables, and their planned columns. What was written is read by :func:`staged_lines`
    and :func:`typed_rows`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_lines(batch, mode)
        staged = f"{out}/staged/batch={batch_id}"
        parsed.select("event", F.col("record").isNull().alias("malformed"), "value").write.mode("overwrite").partitionBy("malformed", "event").parquet(staged)
        lines = batch.sparkSession.read.schema(STAGED).parquet(staged)
        for event, columns in (typed or {}).items():
            records = flatten_events(parse_lines(lines.filter(~F.col("malformed") & (F.col("event") == event)).select("value"), "fail"))
            load_events(records, event, columns).write.mode("overwrite").parquet(f"{out}/typed/{event}/batch={batch_id}")

    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return reader.text(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STAGED = "value string, malformed boolean, event string"


def staged_lines(spark: SparkSession, out: str) -> DataFrame:
    """batch, event, malformed and value of all lines taken in."""
    return spark.read.schema(f"{STAGED}, batch long").parquet(f"{out}/staged")


def typed_rows(spark: SparkSession, out: str, event: str) -> DataFrame:
    """The typed rows of an event that were taken in, with their batch."""
    return spark.read.parquet(f"{out}/typed/{event}")


def hourly_counts(log_stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Queries and slowest duration per hour of an append stream; an exact p95 needs the batch form.

    As a stream, an hour is given out once, when the latest event time seen is ``lateness`` past its end; a row that comes
    after that is not counted.
    """
    return (
        log_stream.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", "1 hour"))
        .agg(F.count(F.lit(1)).alias("queries"), F.max("query_duration_ms").alias("max_ms"))
        .select(F.unix_timestamp("window.start").alias("hour_ts"), "queries", "max_ms")
    )


def sink_hourly_counts(log_stream: DataFrame, out: str, checkpoint: str, lateness: str = "1 hour") -> StreamingQuery:
    """Append the hours that are complete to a table at ``out``, each exactly once over any number of starts."""
    return (
        hourly_counts(log_stream, lateness).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
