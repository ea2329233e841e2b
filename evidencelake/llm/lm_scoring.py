"""Cross-entropy difference: how much more like a target set than like the rest a text is, by two matched n-gram models.

Both models are bigram models over one shared vocabulary, the pieces of a public tokenizer: P(w | v) = (c(v, w) + k * P(w)) / (c(v) + k) with
P(w) = (c(w) + a) / (c + a * vocabulary). One counts the target texts, the other all other texts. They are matched: the background's k and a are greater by as much as
it has more pieces, so both trust their counts alike, as if the background had been scaled to the target's size. No text is scored by its own counts: they are taken out of
its model first. A text's score is the mean over its pieces of target loss - background loss, in bits: the lower, the more like the target.

Neither model is ever in one place. Texts are taken apart once and dealt to batches. A batch sends each of its different n-grams once, with its own
counts, to buckets of the n-gram hash; a bucket adds up what all batches sent and answers every batch, in the order asked; then the batch scores its texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.bitpack import encoder
from evidencelake.llm.common import batches_of, hash_bits, mix64
from evidencelake.llm.ngram_join import from_planes, table_bytes, to_planes

#: Bytes of the text table for each batch of texts and each bucket of n-grams: each is handled in memory. A batch sends a row to each bucket, so there are fewer buckets.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: At least so many for each shuffle partition, and batches that texts of one id are spread over.
BATCHES, BUCKETS, SPREAD = 4, 0.25, 8
_BITS = 20
_CONTEXT, _WORD, _ALL = (np.uint64(k << 2 * _BITS) for k in (1, 2, 3))
#: A key's bits, and the most that its bucket may have beside them and the kind of text.
_WIDTH, _KEY, _MOST = np.uint64(2 * _BITS + 2), np.uint64((1 << 2 * _BITS + 2) - 1), 20


def encoded(own: DataFrame, file: str, direct: bool, kind: str) -> DataFrame:
    """(id, pieces, batch) of (id, text, batch): each text is taken apart once, before it is dealt to its batch. Null texts have no pieces."""

    def encode(tables):
        import pyarrow as pa

        words = encoder(file, direct)
        for t in tables:
            pieces = [np.frombuffer(words.of(text), "<u4").astype(kind).tobytes() for text in batches_of(t.column("text"))]
            yield pa.RecordBatch.from_arrays([t.column("id"), pa.array(pieces, pa.binary()), t.column("batch")], names=["id", "pieces", "batch"])

    return own.mapInArrow(encode, "id long, pieces binary, batch int")


def keys_of(rows, kind: str, opening: int):
    """The texts of a batch: (ids, pieces in each, which are target, and for all pieces on end: text, bigram, context, word)."""
    ids, pieces = rows.column("id").to_pylist(), rows.column("pieces").to_pylist()
    wanted = {i for i, p in zip(ids, pieces) if p is None}
    at = [k for k, p in enumerate(pieces) if p is not None]
    parts = [np.frombuffer(pieces[k], kind) for k in at]
    sizes = np.array([len(p) for p in parts], np.int64)
    words = np.concatenate(parts).astype(np.uint64) if parts else np.empty(0, np.uint64)
    before = np.roll(words, 1)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[starts] = opening
    owner = np.repeat(np.arange(len(at)), sizes)
    return [ids[k] for k in at], sizes, np.array([ids[k] in wanted for k in at], bool), owner, (before << np.uint64(_BITS)) | words, before | _CONTEXT, words | _WORD


def asked(rows, kind: str, opening: int, bits: int):
    """A batch's n-grams, contexts, words and the total by bucket and key, what the batch's target and other texts hold of each, and where the buckets' parts begin.

    One sort of bucket, key and kind of text counts them all.
    """
    _, _, target, owner, *keys = keys_of(rows, kind, opening)
    flags = np.tile(target[owner].astype(np.uint64), 3)
    marked = np.sort((placed(np.concatenate(keys), bits) << np.uint64(1)) | flags)
    every = marked >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    sizes = np.diff(np.append(starts, len(every)))
    hits = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    whole, mine = placed(np.array([_ALL]), bits), int(target[owner].sum())
    every, at = every[starts], np.searchsorted(every[starts], whole)
    every, hits, others = np.insert(every, at, whole), np.insert(hits, at, mine), np.insert(sizes - hits, at, len(owner) - mine)
    return every & _KEY, hits.astype(np.uint64), others.astype(np.uint64), np.searchsorted(every >> _WIDTH, np.arange((1 << bits) + 1, dtype=np.uint64))


def numbered(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the different keys in order, the number of each piece's key among them, how often the piece's text holds it), by one sort of key and text together."""
    bits = np.uint64(max(1, texts.bit_length()))
    both = (keys << bits) | owner.astype(np.uint64)
    order = np.argsort(both)
    both = both[order]
    pairs = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
    both >>= bits
    fresh = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
    number, own = np.empty(len(both), np.int64), np.empty(len(both), np.int64)
    number[order] = np.cumsum(fresh) - 1
    runs = np.diff(np.append(np.flatnonzero(pairs), len(both)))
    own[order] = np.repeat(runs, runs)
    return both[fresh], number, own


def placed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys with their bucket before them, so that they sort by both."""
    return ((mix64(keys) >> np.uint64(64 - bits)) << _WIDTH) | keys


def cross_entropy_difference(
    docs: DataFrame, targets: DataFrame, tokenizer_file: str, vocabulary: int, opening: int, direct: bool = False, id_column: str = "doc_id", text_column: str = "text", prior: float = 5.0, add: float = 0.5
) -> DataFrame:
    """Per text: doc_id, n_tokens, target_bits and background_bits (mean loss per piece) and score, their difference.

    ``targets`` has the ids of the target texts in ``id_column``; ids that no text has, nulls and repeats do nothing. ``opening`` is the piece before a text's first; ``prior`` is k and ``add`` is a above. Whole texts
    are counted and scored, each without its own counts. Null texts and texts without pieces have 0 tokens and null figures. Repeated rows count as often as they occur and are texts of their own. Without
    target texts the target model is even; without any or without others, the models are not matched. Other columns are ignored. An empty table gives no rows.
    """
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    size, kind = table_bytes(own), "<u2" if max(vocabulary, opening + 1) <= 1 << 16 else "<u4"
    batches = max(1 << hash_bits(docs.sparkSession, BATCHES), size // BATCH_BYTES)
    bits = min(_MOST, max(hash_bits(docs.sparkSession, BUCKETS), (size // BUCKET_BYTES).bit_length()))
    # a target id is told to all batches that texts of this id may be in
    parts, spread = max(1, batches // SPREAD), F.pmod(F.xxhash64("text"), F.lit(SPREAD))
    part = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text", F.lit("part")), F.lit(parts))).otherwise(F.pmod(F.xxhash64("id"), F.lit(parts)))
    dealt = (part * SPREAD + F.col("spread")).cast("int").alias("batch")
    marked = targets.select(F.col(id_column).cast("long").alias("id"), F.lit(None).cast("binary").alias("pieces")).filter("id is not null").distinct()
    marked = marked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("spread"), F.lit("").alias("text")).select("id", "pieces", dealt)
    rows = encoded(own.withColumn("spread", spread).select("id", "text", dealt), tokenizer_file, direct, kind).unionByName(marked)

    def send(key, table):
        import pyarrow as pa

        keys, hits, others, cuts = asked(table, kind, opening, bits)
        out = [(b, key[0].as_py(), to_planes(keys[i:j]), hits[i:j].tobytes(), others[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if i < j]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "batch", "keys", "hits", "others"])

    def answer(key, table):
        import pyarrow as pa

        parts = [from_planes(x) for x in table.column("keys").to_pylist()]
        found, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums = []
        for name in ("hits", "others"):
            held = np.zeros(len(found), np.uint64)
            np.add.at(held, at, np.concatenate([np.frombuffer(x, np.uint64) for x in table.column(name).to_pylist()]))
            sums.append(held[at])
        ends = np.cumsum([len(p) for p in parts])
        cut = lambda x: pa.array([x[e - len(p) : e].tobytes() for e, p in zip(ends.tolist(), parts)], pa.binary())
        return pa.Table.from_arrays([table.column("batch").combine_chunks(), pa.array([key[0].as_py()] * len(parts), pa.int32()), cut(sums[0]), cut(sums[1])], names=["batch", "bucket", "hits", "others"])

    def score(table, replies):
        import pyarrow as pa

        ids, sizes, target, owner, bigram, context, word = keys_of(table, kind, opening)
        parts = [numbered(k, owner, len(ids)) for k in (bigram, context, word)]
        keys = np.concatenate([*(p[0] for p in parts), np.array([_ALL])])
        order = np.argsort(placed(keys, bits))
        replies = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        totals, held = [], []
        for name in ("hits", "others"):
            counts = np.zeros(len(keys))
            counts[order] = np.concatenate([np.frombuffer(r[name], np.uint64) for r in replies]) if replies else 0
            totals.append(counts[-1])
            held.append(np.split(counts[:-1], np.cumsum([len(p[0]) for p in parts])[:-1]))
        matched = totals[1] / totals[0] if min(totals) > 0 else 1.0
        means = []
        for side, scale in ((True, 1.0), (False, matched)):
            mine = target == side
            flags, found = mine[owner], held[not side]
            pair, before, single = (h[number] for h, (_, number, _) in zip(found, parts))
            if flags.any():
                for counts, (_, _, own) in zip((pair, before, single), parts):
                    counts -= own * flags
            total = (totals[not side] - sizes * mine + add * scale * vocabulary)[owner]
            single += add * scale
            single *= prior * scale / total
            pair += single
            before += prior * scale
            pair /= before
            means.append(np.bincount(owner, -np.log2(pair), len(ids)) / np.maximum(sizes, 1))
        empty = sizes == 0
        figures = [pa.array(m, pa.float64(), mask=empty) for m in (means[0], means[1], means[0] - means[1])]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *figures], names=["doc_id", "n_tokens", "target_bits", "background_bits", "score"])

    messages = rows.groupBy("batch").applyInArrow(send, "bucket int, batch int, keys binary, hits binary, others binary")
    replies = messages.groupBy("bucket").applyInArrow(answer, "batch int, bucket int, hits binary, others binary")
    return rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(score, "doc_id long, n_tokens long, target_bits double, background_bits double, score double")
