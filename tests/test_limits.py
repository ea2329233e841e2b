"""Limits are arguments: without one, nothing is left out."""

from pyspark.sql import functions as F

from evidencelake.operators import changelog, conversations
from tests.test_logs import run_rows, store_rows


def test_related_answers_by_any_term(spark):
    asked = spark.createDataFrame([(1, "c", "alpha bravo charlie delta echo1 foxtrot")], "question_id int, conv_id string, question string")
    cache = spark.createDataFrame([(7, "c", "the foxtrot steps", 1)], "answer_id int, conv_id string, question string, created_at int")
    assert [r.answer_id for r in conversations.related_answers(asked, cache).collect()] == [7]
    assert conversations.related_answers(asked, cache, terms=5).count() == 0


def test_changelog_keeps_every_run_and_batch(spark):
    many = spark.range(501).select(F.col("id").cast("string").alias("_k"))
    again = lambda df: df.join(many).withColumn("run_id", F.concat("run_id", F.lit("-"), "_k")).drop("_k")
    store, log = again(store_rows(spark)), again(run_rows(spark))
    batches, runs = store.select("run_id").distinct().count(), 501
    got = changelog.changelog(store, log).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("truncated").alias("cut")).collect()
    assert {r.kind: (r.n, r.cut) for r in got} == {"context": (batches, False), "table": (runs, False)} and batches > 300
    got = changelog.changelog(store, log, batches=300, runs=500).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("truncated").alias("cut")).collect()
    assert {r.kind: (r.n, r.cut) for r in got} == {"context": (300, True), "table": (500, True)}
