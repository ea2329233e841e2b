"""Conversations: the list, the turns, what was already said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.text import question_terms
from evidencelake.operators.joins import first_per_key
from evidencelake.operators.topk import history_window

LISTED = 100
RELATED = 3


def conversation_list(conversations: DataFrame, messages: DataFrame, n: int = LISTED) -> DataFrame:
    """The newest live conversations with their message count and last user text.

    ``conversations(conv_id, title, starred, deleted, updated_at)`` holds upserts, ``messages(conv_id, seq, role,
    question)``. Messages are pruned to the listed conversations before they are aggregated.
    """
    latest = conversations.groupBy("conv_id").agg(
        F.max(F.struct("updated_at", "title", "starred", "deleted")).alias("c")
    )
    recent = (
        latest.filter("c.deleted = 0")
        .select("conv_id", F.col("c.title").alias("title"), F.col("c.starred").alias("starred"), F.col("c.updated_at").alias("updated_at"))
        .orderBy(F.col("updated_at").desc(), "conv_id")
        .limit(n)
    )
    from_user = F.col("role") == "user"
    stats = (
        messages.join(recent.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.max_by(F.when(from_user, F.col("question")), F.when(from_user, F.col("seq"))).alias("preview"),
        )
    )
    return (
        recent.join(stats, "conv_id", "left")
        .fillna({"messages": 0, "preview": ""})
        .orderBy(F.col("updated_at").desc(), "conv_id")
    )


def turns(messages: DataFrame, conv_id: Column | str | int) -> DataFrame:
    """One conversation in order."""
    wanted = conv_id if isinstance(conv_id, Column) else F.lit(conv_id)
    return messages.filter(F.col("conv_id") == wanted).orderBy("seq")


def related_answers(questions: DataFrame, cache: DataFrame, n: int = RELATED, terms: int | None = None) -> DataFrame:
    """Earlier answers of the same conversation whose question contains a term of this one (of its first ``terms``, if given), the newest ``n``.

    ``questions(question_id, conv_id, question)``, ``cache(answer_id, conv_id, question, created_at)``. Questions and
    stored answers are never paired directly: per (conversation, term) only the answers that can be among the
    newest ``n`` of any question survive - ``n`` each of the ``n + 1`` newest question texts, since a question
    skips just its own text.
    """
    own = F.xxhash64("question")
    asked = questions.select(
        "question_id", "conv_id", own.alias("own"),
        F.explode(question_terms(F.col("question"), longer_than=3, first=terms)).alias("term"),
    ).distinct()
    # a term is a run of letters and digits, so it occurs inside one such run of the stored text; texts stay behind
    words = cache.select(
        "conv_id", "answer_id", own.alias("stored"), "created_at",
        F.explode(F.array_distinct(F.split(F.lower("question"), "[^a-z0-9]+"))).alias("word"),
    )
    hits = (
        words.join(_containing(asked.select("term").distinct(), words.select("word").distinct()), "word")
        .join(asked.select("conv_id", "term").distinct(), ["conv_id", "term"], "left_semi")
        .select("conv_id", "term", "answer_id", "stored", "created_at")
        .distinct()
    )
    newest = [F.col("created_at").desc(), F.col("answer_id")]
    per_text = first_per_key(hits, ["conv_id", "term", "stored"], newest, n)
    texts = per_text.groupBy("conv_id", "term", "stored").agg(
        F.max("created_at").alias("_at"), F.min_by("answer_id", F.struct(-F.col("created_at").cast("double"), F.col("answer_id"))).alias("_id")
    )
    kept_texts = first_per_key(texts, ["conv_id", "term"], [F.col("_at").desc(), F.col("_id")], n + 1)
    kept = per_text.join(kept_texts.select("conv_id", "term", "stored"), ["conv_id", "term", "stored"], "left_semi")
    candidates = (
        asked.join(kept, ["conv_id", "term"])
        .filter("stored <> own")
        .select("question_id", "conv_id", "answer_id", "created_at")
        .distinct()
    )
    found = first_per_key(candidates, ["question_id"], newest, n)
    stored = cache.select("conv_id", "answer_id", F.col("question").alias("stored_question"))
    return found.join(stored, ["conv_id", "answer_id"]).select("question_id", "conv_id", "answer_id", "stored_question", "created_at")


def _containing(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``(term, word)`` with the term inside the word; they meet on the term's rarest three letters."""
    grams = lambda c: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))
    )
    by_gram = words.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    frequency = by_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    anchors = (
        terms.select("term", F.explode(grams(F.col("term"))).alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy("term")
        .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram")).alias("a"))
        .select("term", F.col("a.gram").alias("gram"))
    )
    return anchors.join(by_gram, "gram").filter(F.contains("word", F.col("term"))).select("term", "word")


def mentioned_tables(sql: Column) -> Column:
    """Distinct table names after FROM, lower-cased, in order of appearance."""
    names = F.regexp_extract_all(F.lower(sql), F.lit(r"\bfrom\s+([a-z_][a-z0-9_]*)"), 1)
    return F.array_distinct(F.filter(names, lambda t: t != "select"))


def history(messages: DataFrame) -> DataFrame:
    """The history each next question sees: twelve turns, the last four in full, with the tables they used."""
    windowed = history_window(messages, "conv_id", "seq")
    return windowed.withColumn("tables", mentioned_tables(F.col("text"))) if "text" in messages.columns else windowed


def history_digest(messages: DataFrame) -> DataFrame:
    """A short digest of the turns a question is asked after; at most twelve turns meet per conversation."""
    rows = history_window(messages, "conv_id", "seq")
    line = F.concat_ws(":", "role", "text")
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("h")
    )
    return grouped.select("conv_id", F.left(F.sha1(F.array_join(F.col("h.line"), "|")), F.lit(10)).alias("history_digest"))
