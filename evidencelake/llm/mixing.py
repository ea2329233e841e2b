"""Mix sources to target weights: exact word targets, drawn as blocks through a splitting tree over the output shards.

1. A source's target is its weight's share of the budget, at most ``most`` times its own words; what a full source
   leaves over is shared again among the others by weight. The fixed point of that is a level: target = min(cap, weight * level).
2. Each source's documents stand in a fixed random order, ``most`` passes over it in turn. The mix takes the documents whose
   middle lies before the target, so a source misses it by at most half a document.
3. That stretch is cut into blocks of equal words. A tree halves the shards; at each node the blocks for the left half
   are a draw without replacement from the node's blocks, so their counts by source follow the multivariate
   hypergeometric law and every quota comes out exactly. A source's blocks are permuted and dealt to its shards' quotas in turn.
4. A copy of a document goes to its block's shard and has a place there, drawn anew.

Everything is DataFrame and SQL expressions, and draws are md5 orders, so any engine gets the same mix. Only step 2 orders
documents, by ranges, so a source with a third of them is many ranges. The tree's work follows ``blocks_per_shard * shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import WORD, running_sums
from evidencelake.session import materialise

WEIGHTS = (3, 1, 2)


def document_sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", mark: Column | None = None) -> DataFrame:
    """doc_id, source, size (words of the whole text, null: 0) and mark (default: a hash of the text)."""
    text = F.col(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.xxhash64(text) if mark is None else mark).alias("mark"),
    )


def _by_source() -> list[Column]:
    """Sources by code point, null last."""
    return [F.col("source").isNull().cast("int"), F.col("source")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source: source_size, rank, source_start (words of the sources before it), weight and target.

    ``weights`` are given to the sources by rank, over and over; ``share`` of all words is the budget. Sources without
    words have target 0. Two aggregates of one row each are read by the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(sources, _by_source(), {"rank": F.lit(1).cast("long"), "source_start": "source_size"})
    by_rank = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(by_rank, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    filled = running_sums(ranked, [F.col("cap") / F.col("weight"), F.col("rank")], {"caps_before": "cap", "weights_before": "weight"})
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    budget, all_weights = share * (whole.words or 0), whole.weights or 0
    full = F.col("cap") * (F.lit(all_weights) - F.col("weights_before")).cast("double") <= F.col("weight") * (F.lit(budget) - F.col("caps_before"))
    filled = filled.withColumn("full", full)
    rest = filled.agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("caps"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weights")).first()
    level = (budget - (rest.caps or 0)) / rest.weights if rest.weights else 0.0
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))
    return filled.select("source", "source_size", "rank", "source_start", "weight", target.alias("target"))


def drawn_by(*parts: str | Column) -> Column:
    """The order in which things are drawn: the md5 of the parts with colons between; nulls are empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """From (rank, q), the number of blocks of each source, to (shard, rank, token): the tree's leaves, one row for each block a shard gets of a source.

    A node stands for ``width`` shards from ``lo`` on. Its left half gets its share of the node's blocks, rounded down, drawn without replacement: all of them in the
    order of an md5, the first ones to the left. That makes the counts of all sources together multivariate hypergeometric, and every quota exact. A level's work is a window over the node's blocks,
    whose number follows shards and blocks a shard, not documents.
    """
    nodes = quotas.filter("q > 0").select("rank", F.explode(F.sequence(F.lit(1).cast("long"), "q")).alias("token"), F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("width"))
    for _ in range(max(0, (shards - 1).bit_length())):
        node = Window.partitionBy("lo")
        nodes = nodes.withColumns({
            "left": F.expr("width div 2"), "total": F.count(F.lit(1)).over(node),
            "place": F.row_number().over(node.orderBy(drawn_by(F.lit(seed), "lo", "width", "rank", "token"), "rank", "token")),
        })
        left = F.col("place") <= F.expr("total * left div width")
        nodes = nodes.select(
            "rank", "token", F.when((F.col("left") == 0) | left, F.col("lo")).otherwise(F.col("lo") + F.col("left")).alias("lo"),
            F.when(F.col("left") == 0, F.col("width")).when(left, F.col("left")).otherwise(F.col("width") - F.col("left")).alias("width"),
        )
    return nodes.select(F.col("lo").alias("shard"), "rank", "token")


def deal_blocks(targets: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(rank, block, shard): each source's blocks, in a permutation of their own, dealt to the shards' quotas in turn."""
    quotas = targets.select("rank", F.ceil(F.col("target") / block).cast("long").alias("q"))
    source = Window.partitionBy("rank")
    leaves = split_quotas(quotas, shards, seed).withColumn("turn", F.row_number().over(source.orderBy("shard", "token")))
    blocks = quotas.filter("q > 0").select("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("block"))
    permuted = blocks.withColumn("turn", F.row_number().over(source.orderBy(drawn_by(F.lit(seed), "rank", "block"), "block")))
    return permuted.join(leaves, ["rank", "turn"]).select("rank", "block", "shard")


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, shards: int | None = None, blocks_per_shard: int = 64, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", mark: Column | None = None,
) -> DataFrame:
    """Per document: doc_id, source, size, mark, source_size, target (its source's), and shards and places: one of each for each time that it is taken.

    A block is the documents that begin in one of the equal stretches of a source's target; the tree decides which shard it goes to, and so do all copies of its documents. A copy's place orders it within
    its shard. ``shards`` defaults to the session's number of shuffle partitions. ``mark`` tells rows of equal id and source apart (default: the text's hash). The same rows give the same mix in every run.
    Null texts and texts without words have size 0 and are taken when their place is before the target; a null source is a source; repeated rows are rows of their own; other columns are ignored.
    No rows give no rows.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(document_sizes(docs, id_column, text_column, source_column, mark), "sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "targets")
    taken = targets.agg(F.round(F.sum("target"), 3)).first()[0] or 0.0
    block = max(1, -int(-taken // (shards * blocks_per_shard)))
    dealt = deal_blocks(targets, block, shards, seed).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("block", "shard"))).alias("b")).select("rank", F.col("b.shard").alias("shard_of_block"))
    sources = targets.join(dealt, "rank", "left").select(source_key(F.col("source")).alias("key"), "source_start", "source_size", "target", "shard_of_block")
    placed = running_sums(sizes, [*_by_source(), drawn_by("doc_id", F.lit(seed)), F.col("doc_id"), F.col("size"), F.col("mark")], {"place": "size"})
    placed = placed.withColumn("key", source_key(F.col("source"))).join(materialise(sources, "mixture"), "key")
    start = "(place - source_start + e * source_size)"
    copies = F.expr(f"transform(filter(sequence(0, {most - 1}), e -> {start} + size / 2 < target), e -> named_struct('e', e, 'shard', shard_of_block[cast({start} div {block} as int)]))")
    placed = placed.select("doc_id", "source", "size", "mark", "source_size", "target", copies.alias("copies"))
    places = F.transform("copies", lambda c: drawn_by(F.lit(seed), c["shard"], "doc_id", c["e"]))
    return placed.select("doc_id", "source", "size", "mark", "source_size", "target", F.col("copies.shard").alias("shards"), places.alias("places"))


def source_key(source: Column) -> Column:
    """A source as a text that joins, null too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **plan) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, dealt to the shards and shuffled within each: partitions, and files written from them, hold the shards in order.

    All columns stay, whatever their names. Rows alike in all columns share their copies between them. What null, empty and repeated rows do is said at :func:`plan_mix`; an empty table stays empty.
    """
    every = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    drawn = plan_mix(docs, id_column=id_column, text_column=text_column, source_column=source_column, mark=every, **plan)
    copies = drawn.select(F.col("doc_id").cast("string").alias("id"), "mark", F.explode(F.arrays_zip("shards", "places")).alias("c"))
    counted = copies.groupBy(F.coalesce("id", F.lit("")).alias("id"), "mark", F.col("c.shards").alias("shard"), F.col("c.places").alias("place")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = counted.groupBy("id", "mark").agg(F.collect_list(F.struct("shard", "place", "n")).alias("copies"))
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), every.alias("mark"))
    # of rows alike in all columns, one carries the copies of all: each task hands on one of them at most
    one = own.withColumn("first", F.row_number().over(Window.partitionBy("id", "mark").orderBy("mark"))).filter("first = 1")
    taken = one.join(lists, ["id", "mark"]).select("row", F.explode("copies").alias("c"))
    taken = taken.select("row", F.col("c.shard").alias("shard"), F.col("c.place").alias("place"), F.explode(F.sequence(F.lit(1), F.col("c.n"))).alias("i"))
    return taken.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select(*[F.col("row")[c].alias(c) for c in docs.columns])
