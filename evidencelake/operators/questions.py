"""What a question pins down: the stored metrics it names and the assumptions it already states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.session import materialise

# Fixed values.
FILLER = (
    "the", "and", "for", "all", "any", "with", "from", "into", "over", "per", "are", "was", "were", "use", "used", "using", "only", "both", "each",
    "that", "this", "than", "then", "data", "rows", "row", "value", "values", "applied", "apply", "assumed", "assume", "set", "include", "included",
    "including",
)
EXCLUDE_FORMS = (
    "excludes", "excluded", "excluding", "omits", "omitted", "omitting", "ignores", "ignored", "ignoring", "without", "drops", "dropping",
)
DIMENSION_MENU = r"(?i)\b(cut|split|slice|segment|grouped?|break)\s+(it\s+)?by\b"


def named_metrics(questions: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(question_id, metric)`` for every stored metric a question names, the most specific only.

    ``questions(question_id, question)``, ``metrics(entity)`` with ``metric:<id>`` entities. A metric is named
    when all words of its id occur as whole words, or the id itself does. The metrics are an inverted index: each is looked up by one
    word - the one fewest metrics use, the longest among those - and then checked against the other words of the question.
    The index is written to the shared folder. Runs jobs.
    """
    ids = (
        metrics.filter(F.startswith(F.lower("entity"), F.lit("metric:")))
        .select(F.lower(F.substring("entity", 8, 1 << 20)).alias("metric"))
        .filter(F.col("metric") != "")
        .distinct()
        .withColumn("words", F.array_distinct(F.filter(F.split("metric", "_"), lambda w: w != "")))
        .filter(F.size("words") > 0)
        .withColumn("plain", F.col("metric").rlike("^[a-z0-9_]+$"))
    )
    index = materialise(metric_index(ids), "metrics")
    found = index.filter("plain").drop("plain")

    pieces = lambda c: F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != ""))
    entry = lambda word, spelled: F.struct(word.alias("word"), spelled.cast("string").alias("spelled"))
    # one pass over the texts: their tokens, and the pieces of those that hold an underscore, in which an id may be spelled out; texts stay behind
    entries = F.transform(
        F.array(F.array_distinct(F.split(F.lower("question"), "[^a-z0-9_]+"))),
        lambda tokens: F.concat(
            F.transform(tokens, lambda t: entry(t, F.lit(None))),
            F.flatten(F.transform(F.filter(tokens, lambda t: F.contains(t, F.lit("_"))), lambda t: F.transform(pieces(t), lambda p: entry(p, t)))),
        ),
    )
    asked = questions.select("question_id", F.inline(F.get(entries, F.lit(0)))).join(found, "word")
    # what meets per question are the words of it that some metric uses
    gathered = asked.groupBy("question_id").agg(
        F.collect_set(F.when(F.col("spelled").isNull(), F.col("word"))).alias("known"),
        F.collect_list(F.when(F.size("anchored") > 0, F.struct("spelled", "anchored"))).alias("candidates"),
    )
    named = gathered.select("question_id", F.expr(r"""array_distinct(flatten(transform(candidates, c -> filter(c.anchored, m ->
        if(c.spelled is null, forall(m.words, w -> array_contains(known, w)), regexp(c.spelled, concat('(^|[^a-z0-9])\\Q', m.metric, '\\E(?![a-z0-9])')))))))""").alias("named"))
    odd = index.filter("not plain").drop("plain")
    if not odd.isEmpty():  # ids with other characters are sought in the text itself
        texts = questions.select("question_id", F.lower("question").alias("q"))
        delimited = F.expr(r"forall(m.words, w -> regexp(q, concat('(^|[^a-z0-9_])\\Q', w, '\\E(?![a-z0-9_])')))")
        literally = F.expr(r"regexp(q, concat('(^|[^a-z0-9])\\Q', m.metric, '\\E(?![a-z0-9])'))")
        others = (
            texts.select("question_id", F.explode(pieces(F.col("q"))).alias("word")).join(odd, "word").select("question_id", F.explode("anchored").alias("m")).distinct()
            .join(texts, "question_id").filter(delimited | literally).select("question_id", "m")
        )
        named = others.unionByName(named.select("question_id", F.explode("named").alias("m"))).groupBy("question_id").agg(F.collect_set("m").alias("named"))
    # a metric whose words another named one holds and exceeds is covered by it
    specific = F.expr("filter(named, m -> not exists(named, o -> size(o.words) > size(m.words) and size(array_except(m.words, o.words)) = 0))")
    return named.select("question_id", F.explode(specific).alias("m")).select("question_id", "m.metric")


def metric_index(ids: DataFrame) -> DataFrame:
    """(word, plain, anchored): for each word of a metric's id, the metrics that are looked up by it, the others none."""
    pieces = F.array_distinct(F.filter(F.split("metric", "[^a-z0-9]+"), lambda w: w != ""))
    parts = ids.select("metric", "words", "plain", F.explode(pieces).alias("word"))
    frequency = parts.groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    anchors = (
        parts.join(frequency, "word").groupBy("metric", "words", "plain")
        .agg(F.min(F.struct("f", (-F.length("word")).alias("l"), "word")).alias("a"))
        .select(F.col("a.word").alias("word"), "plain", F.struct("metric", "words").alias("m"))
    )
    every = parts.select("word", "plain", F.lit(None).cast("struct<metric:string,words:array<string>>").alias("m"))
    return anchors.unionByName(every).groupBy("word", "plain").agg(F.collect_list("m").alias("anchored"))


def clean_assumptions(raw: Column) -> Column:
    """A list of assumptions, or one text split at ``;`` and line breaks: trimmed, blanks dropped."""
    return F.filter(F.transform(raw, lambda a: F.trim(a)), lambda a: a != "")


def split_assumptions(text: Column) -> Column:
    return clean_assumptions(F.split(text, "[;\n]"))


def _tokens(text: Column) -> Column:
    """Different runs of letters, digits, ``_``, ``.`` and ``-`` without the dots and dashes at their ends."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_](?:[a-z0-9_.-]*[a-z0-9_])?"), 0))
    return F.transform(words, lambda w: F.when(w.isin(*EXCLUDE_FORMS), "exclude").otherwise(w))


def _without_menu(definition: Column) -> Column:
    """Sentences listing the dimensions a metric can be cut by pin no slice."""
    sentences = F.split(definition, r"(?<=[.!?])\s+|\n+")
    return F.array_join(F.filter(sentences, lambda s: ~s.rlike(DIMENSION_MENU)), " ")


def unstated_assumptions(question: Column, assumptions: Column, definitions: Column | None = None) -> Column:
    """The assumptions that still cost something: some distinctive word of theirs is stated nowhere.

    Stated words come from the question and the definitions of the metrics it names (arrays of texts).
    """
    stated_text = F.coalesce(question, F.lit(""))
    if definitions is not None:
        pinned = F.array_join(F.transform(F.coalesce(definitions, F.array().cast("array<string>")), _without_menu), " ")
        stated_text = F.concat_ws(" ", stated_text, pinned)

    def with_affixes(tokens: Column) -> Column:
        """The tokens, and what stands before or after each underscore of one."""
        parts = lambda t: F.sequence(F.lit(1), F.length(t) - F.length(F.replace(t, F.lit("_"))))
        joined = F.filter(tokens, lambda t: F.contains(t, F.lit("_")))
        before = F.flatten(F.transform(joined, lambda t: F.transform(parts(t), lambda i: F.call_function("substring_index", t, F.lit("_"), i))))
        after = F.flatten(F.transform(joined, lambda t: F.transform(parts(t), lambda i: F.call_function("substring_index", t, F.lit("_"), -i))))
        return F.concat(tokens, before, after)

    def is_stated(stated: Column, word: Column) -> Column:
        plural = F.endswith(word, F.lit("s")) & (F.length(word) >= 5)
        return F.array_contains(stated, word) | (plural & F.array_contains(stated, F.regexp_replace(word, "s$", "")))

    def charged(stated: Column, assumption: Column) -> Column:
        at = F.instr(assumption, F.lit(" = "))
        claim = F.when(at > 0, F.substr(assumption, at + 3)).otherwise(assumption)
        words = F.filter(_tokens(claim), lambda w: (F.length(w) >= 3) & ~w.isin(*FILLER))
        return (F.size(words) == 0) | ~F.forall(words, lambda w: is_stated(stated, w))

    listed = F.coalesce(assumptions, F.array().cast("array<string>"))
    # bound as a lambda variable, the stated words are split from the text once per row
    kept = F.transform(F.transform(F.array(_tokens(stated_text)), with_affixes), lambda stated: F.filter(listed, lambda a: charged(stated, a)))
    return F.get(kept, F.lit(0))


def suggested_questions(docs: DataFrame, first: int = 12) -> DataFrame:
    """Bullets of each document's Questions section, cleaned and deduplicated case-insensitively.

    ``docs(spec, body)``; the first ``first`` in document order are kept, as many as a reader is offered.
    """
    section = F.regexp_extract("body", r"(?i)##\s*Questions[^\n]*\n([\s\S]*?)(\n##|$)", 1)
    lines = docs.select("spec", F.posexplode(F.split(section, "\n")).alias("line_no", "line"))
    bullet = F.regexp_extract("line", r"^\s*[-*]\s+(.+)$", 1)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bullet, "`", ""), r"\*\*", ""), r"\s+", " "))
    kept = lines.select("spec", "line_no", cleaned.alias("question")).filter(F.length("question").between(15, 200))
    # reduced to the first mention map-side; a window would gather every copy of a popular question
    unique = kept.groupBy(F.lower("question").alias("_k")).agg(F.min(F.struct("spec", "line_no", "question")).alias("q"))
    return unique.select("q.*").orderBy("spec", "line_no").limit(first)


def event_purposes(docs: DataFrame) -> DataFrame:
    """``(spec, event, purpose)`` from bullets of the form "- `event` — text (columns)"; the last mention wins."""
    lines = docs.select("spec", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    pattern = r"^\s*[-*]\s*`([A-Za-z][A-Za-z0-9_]*)`\s*[—–-]\s*(.+)$"
    event, text = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, "`", ""), r"\s*\([^)]*\)\s*$", ""))
    found = lines.select("spec", "line_no", event.alias("event"), cleaned.alias("purpose")).filter(
        (F.col("event") != "") & (F.length("purpose") > 3)
    )
    return found.groupBy("spec", "event").agg(F.max_by("purpose", "line_no").alias("purpose"))
