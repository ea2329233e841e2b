"""Ranked lexical search turned round: the items are indexed, the documents stream through.

1. Items are cut into terms by Spark and dealt, in order, to blocks of about ``BLOCK_TERMS`` terms. A block's inverted index (term to items) is what a task holds; it is bounded, however
   many items there are, and so is what the driver passes on.
2. A first pass over the documents counts how many hold each term of the block, how many have a term at all, and all their terms.
3. A second pass streams each document's term counts through the index, adds up its scores for all items that share a term with it, and keeps a heap of the best ``best`` documents per item.
   Each task hands out its heaps at its end; the heaps of an item are merged by rank.

No document leaves its task, and the shuffles carry sums per term and ``best`` rows per item and task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import batches_of, running_sums
from evidencelake.llm.line_dedup import ASCII_LOWER, ASCII_UPPER

#: A term is a run of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of items in one block; each block takes two passes over the documents.
BLOCK_TERMS = 200_000
_FOLD = bytes((b if b >= 0x80 or chr(b).isalnum() else 0x20) for b in bytes(range(256)).lower())
_PIECE, _CELLS, _ENTRIES = 4 << 20, 4_000_000, 500_000
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of some megabytes."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """block, item (its number), item_id and terms (different ones) of each item that has a term."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_column), ASCII_UPPER, ASCII_LOWER), F.lit(TERM), 0))
    own = items.select(F.col(id_column).cast("long").alias("item_id"), terms.alias("terms")).filter("size(terms) > 0")
    placed = running_sums(own, ["item_id", F.xxhash64("terms")], {"item": F.lit(1).cast("long"), "place": F.size("terms").cast("long")})
    return placed.select((F.col("place") / BLOCK_TERMS).cast("long").alias("block"), "item", "item_id", "terms")


class Index:
    """The inverted index of a block: a number for each term, and for each number the items that hold the term."""

    def __init__(self, rows) -> None:
        self.items, self.ids = [r.item for r in rows], [r.item_id for r in rows]
        self.terms: dict[bytes, int] = {}
        numbers = [self.terms.setdefault(t.encode(), len(self.terms)) for r in rows for t in r.terms]
        holder = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        order = np.argsort(numbers, kind="stable")
        self.holders = holder[order]
        self.ends = np.searchsorted(np.array(numbers)[order], np.arange(len(self.terms)), "right")
        self.lengths = np.diff(self.ends, prepend=0)


def count_terms(texts, index: Index) -> tuple[int, int, Counter]:
    """(texts with a term, all their terms, texts that hold each term of the index)."""
    with_terms, all_terms, holding, known = 0, 0, Counter(), index.terms.keys()
    for text in texts:
        n, found = 0, set()
        for piece in terms_of(text or b""):
            n += len(piece)
            found.update(t for t in piece if t in known)
        with_terms += n > 0
        all_terms += n
        holding.update(found)
    return with_terms, all_terms, holding


class Heaps:
    """The best documents of each item: by score, equal ones by smaller id, null last."""

    def __init__(self, items: int, best: int) -> None:
        self.best, self.heaps = best, [[] for _ in range(items)]
        self.floor, self.worst = np.ones(items, np.int64), np.full(items, _LAST)

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores`` has a row for each document."""
        of = np.array([_LAST if i is None else i for i in ids], np.int64)
        good = (scores > self.floor) | ((scores == self.floor) & ((of[:, None] < self.worst) | (self.floor == 1)))
        for doc, item in zip(*(x.tolist() for x in np.nonzero(good))):
            heap, i = self.heaps[item], ids[doc]
            entry = (int(scores[doc, item]), i is not None, -(i or 0))
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.best:
                self.floor[item], self.worst[item] = heap[0][0], -heap[0][2] if heap[0][1] else _LAST


def search_block(batches, index: Index, weights: np.ndarray, with_terms: int, all_terms: int, best: int) -> Heaps:
    """Stream (ids, texts) through the index; ``weights`` belong to the index's term numbers."""
    heaps, n_items, get = Heaps(len(index.ids), best), len(index.ids), index.terms.get
    ids, term, tf, lengths, counts, entries, holders = [], [], [], [], [], 0, index.lengths.tolist()

    def score() -> None:
        if not ids:
            return
        number, often = np.array(term, np.int64), np.array(tf, np.int64)
        doc = np.repeat(np.arange(len(ids)), counts)
        m = np.array(lengths, np.int64)[doc]
        part = weights[number] * ((1_000_000_000 * often) // (1000 * often + 8 * m))
        n = index.lengths[number]
        held = np.repeat(index.ends[number] - np.cumsum(n), n) + np.arange(n.sum())
        scores = np.zeros(len(ids) * n_items, np.int64)
        np.add.at(scores, np.repeat(doc * n_items, n) + index.holders[held], np.repeat(part, n))
        heaps.offer(scores.reshape(len(ids), n_items), ids)
        for kept in (ids, term, tf, lengths, counts):
            kept.clear()

    for some_ids, texts in batches:
        for i, text in zip(some_ids, texts):
            found, n = Counter(), 0
            for piece in terms_of(text or b""):
                n += len(piece)
                found.update(map(get, piece))
            found.pop(None, None)
            if not found:
                continue
            ids.append(i)
            term += found.keys()
            tf += found.values()
            counts.append(len(found))
            lengths.append(10 + (90 * n * with_terms) // all_terms)
            entries += sum(map(holders.__getitem__, found))
            if len(ids) * n_items >= _CELLS or entries >= _ENTRIES:
                score()
                entries = 0
    score()
    return heaps


def ranked_documents(
    docs: DataFrame, items: DataFrame, best: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``best`` documents of score above 0, equal scores by smaller doc_id, null last.

    A term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and adds that times ``(10**9 tf) div (1000 tf + 8m)``, m being 10 plus 90 times the text's length over the mean; all but the logarithm is
    integer arithmetic. N and the mean are those of texts with a term. Null, empty and term-less texts and items find and are found by nothing. Repeated rows, and rows of equal or null id, are documents
    and items of their own. Very long texts are cut into terms piece by piece. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    blocks = item_blocks(items, item_column, item_text)
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    last = blocks.agg(F.max("block")).first()[0]
    schema = "item long, item_id long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for block in range(0 if last is None else last + 1):
        index = Index(blocks.filter(F.col("block") == block).orderBy("item").collect())
        if index.terms:
            found = found.unionByName(_best_of_block(own, index, best, schema))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def _best_of_block(docs: DataFrame, index: Index, best: int, schema: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(index)

    def count(batches) -> Iterator:
        import pyarrow as pa

        with_terms, all_terms, holding = count_terms((t for b in batches for t in batches_of(b.column("text"))), sent.value)
        numbers = [sent.value.terms[t] for t in holding]
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *numbers], pa.int64()), "n": pa.array([with_terms, all_terms, *holding.values()], pa.int64())})

    # one number for each term of the block
    counts = dict(map(tuple, docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    with_terms, all_terms = counts.get(-2, 0), counts.get(-1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * with_terms + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(index.terms))], np.int64)

    def search(batches) -> Iterator:
        import pyarrow as pa

        own = sent.value
        heaps = search_block(((b.column("id").to_pylist(), batches_of(b.column("text"))) for b in batches), own, weights, with_terms, all_terms, best)
        rows = [(own.items[k], own.ids[k], -i if known else None, score) for k, heap in enumerate(heaps.heaps) for score, known, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "item_id", "doc_id", "score"])

    return docs.mapInArrow(search, schema)
