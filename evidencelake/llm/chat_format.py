"""Chat formatting by prefix-target expansion: one training example per assistant turn, with all turns before it as context.

A turn is ``### role: text</turn>`` and a line feed. The template's control strings cannot occur inside a turn: a backslash is
written ``\\b``, ``###`` is ``\\h``, ``</turn>`` is ``\\t`` and, in roles, a colon is ``\\c``. Every backslash of the output then starts
one of these, so reading back is exact. Only the reply of the last turn, without its control strings, is under the loss mask.

All of it is DataFrame and SQL expressions. A conversation's turns are gathered into one row, as its last example holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is escaped, in this order, and how. Undone in the opposite order.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def prefix_examples(turns: DataFrame, trained: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, formatted, loss_start, loss_end (code points): one row for each turn of role ``trained``.

    Turns are ordered by number; those of equal number by role and text. Null texts and roles are empty. Turns after a conversation's last reply make one
    more row with an empty mask, so that the output holds every turn; so does a conversation without a reply. Rows of null conv_id are one conversation. Other columns are ignored.
    The output grows with the square of a conversation's turns: that is what the expansion is.
    """
    own = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    opening = F.concat(F.lit("### "), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    own = own.withColumns({"opening": opening, "body": escape(F.col("text"))})
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "opening", "body"))).alias("t"))
    whole = whole.select(
        "conv_id",
        F.expr("transform(t, x -> concat(x.opening, x.body, '</turn>\\n'))").alias("pieces"),
        F.expr("transform(t, x -> length(x.opening))").alias("openings"),
        F.expr("transform(t, x -> length(x.body))").alias("bodies"),
        F.filter(F.expr("transform(t, (x, i) -> named_struct('i', i, 'role', x.role))"), lambda x: x["role"] == trained).alias("replies"),
    )
    whole = whole.withColumn("at", F.expr("transform(replies, x -> x.i)"))
    whole = whole.withColumn("at", F.expr("if(array_max(at) is null or array_max(at) < size(pieces) - 1, concat(at, array(size(pieces))), at)"))
    each = whole.select("conv_id", "pieces", "openings", "bodies", F.explode("at").alias("i"))
    tail = F.expr("i >= size(pieces)")
    before = F.expr("array_join(slice(pieces, 1, i), '')")
    each = each.select("conv_id", F.col("i").alias("position"), before.alias("before"), F.expr("if(i < size(pieces), pieces[i], '')").alias("last"), F.expr("if(i < size(pieces), openings[i], 0)").alias("opening"), F.expr("if(i < size(pieces), bodies[i], 0)").alias("body"), tail.alias("tail"))
    start = F.length("before") + F.col("opening")
    return each.select("conv_id", "position", F.concat("before", "last").alias("formatted"), start.cast("long").alias("loss_start"), (start + F.col("body")).cast("long").alias("loss_end"))


def parsed_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted example."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    name = lambda p: F.substring_index(F.substr(p, F.lit(5)), ":", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(name(p), ROLE_ESCAPES).alias("role"), unescape(F.substr(p, F.length(name(p)) + 7)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (all examples together)."""
    reply = unescape(F.expr("substr(formatted, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))"))
    parts = examples.select("conv_id", "position", "formatted", reply.alias("reply"))
    whole = parts.groupBy("conv_id").agg(
        F.max_by("formatted", "position").alias("formatted"), F.sort_array(F.collect_list(F.struct("position", "reply"))).alias("replies"), F.sum(F.length("formatted")).alias("formatted_chars")
    )
    whole = whole.select("conv_id", "formatted_chars", parsed_turns(F.col("formatted")).alias("turns"), F.expr("array_join(transform(replies, r -> r.reply), '')").alias("loss"))
    digest = F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256)
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
