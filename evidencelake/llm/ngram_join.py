"""Which texts share at least three quarters of their word n-grams: a prefix-tree similarity join.

1. Each text becomes the set of its n-grams (64-bit hashes). Tasks send a batch's sorted hashes, packed, to buckets of the hash range; a bucket counts in how many texts each
   n-gram is and sends back only those that are in several. All n-grams are thus ordered by (number of texts, hash), rarest first.
2. Two sets with Jaccard similarity t or more share one of the first ``n - ceil(t * n) + 1`` n-grams of either. A text whose own, unshared n-grams fill that prefix has no partner;
   that settles nearly all texts. The others are grouped into candidate components by the shared n-grams of their prefixes.
3. A component's different sets go into a trie in the global order and are looked up in it one by one, smallest first. The walk counts the overlap along a path once for all
   sets below, and leaves a subtree when even all remaining n-grams would not do, or when its sets are already in the same class as the set looked up.
4. The links found span the classes; equal sets share one node throughout.

No pair of equal texts is ever made, and within a class only as many links as join it up. A candidate component of more than ``BLOCK_TOKENS`` n-grams is cut into blocks that meet two by two, each
pair a group of its own: no link is lost, and a task holds two blocks at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import WORD, batches_of, mix64, rolling, word_hashes
from evidencelake.llm.components import components
from evidencelake.session import materialise

BATCH_TOKENS, BATCH_TEXTS = 1_000_000, 60_000
BLOCK_TOKENS = 2_000_000
#: Bytes of text table for each bucket of the hash range.
BUCKET_BYTES = 4 << 20
#: Tasks that the copies of one text are spread over when they learn their class, and what stands for a missing doc_id there.
SALTS, NO_ID = 8, (1 << 63) - 1


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words, A-Z lower-cased; a shorter text is one run, one without words none."""
    words = word_hashes().of((text or b"").lower())
    if len(words) >= width:
        return np.unique(rolling(words, width))
    return mix64(rolling(words, len(words)) + np.uint64(len(words))) if len(words) else np.empty(0, np.uint64)


def to_planes(ascending: np.ndarray) -> bytes:
    """Differences of ascending 64-bit values, byte by byte, so that their leading zeros compress."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


class Classes:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class _Node:
    __slots__ = ("run", "kids", "ends", "least", "most", "rest", "one")

    def __init__(self, run: list[int], rest: int, least: int, most: int, one: int | None) -> None:
        self.run, self.rest, self.least, self.most, self.one = run, rest, least, most, one
        self.kids: dict[int, _Node] = {}
        self.ends: list[int] = []


class Trie:
    """Sets as paths of n-grams in the global order. A node knows, of the sets below it, the least and greatest size, the most n-grams from its start, and one of them while all are of one class."""

    def __init__(self, sets: list[list[int]], sizes: list[int], num: int, den: int) -> None:
        self.sets, self.sizes, self.num, self.den = sets, sizes, num, den
        self.classes, self.roots = Classes(len(sets)), set()
        self.top = _Node([], 0, 1 << 60, 0, None)

    def add(self, x: int) -> None:
        path, size, node, at = self.sets[x], self.sizes[x], self.top, 0
        self.roots = {self.classes.of(r) for r in self.roots} | {self.classes.of(x)}
        fresh = not node.kids and not node.ends
        while True:
            node.rest, node.least, node.most = max(node.rest, len(path) - at), min(node.least, size), max(node.most, size)
            if fresh:
                node.one, fresh = x, False
            elif node.one is not None and self.classes.of(node.one) != self.classes.of(x):
                node.one = None
            k, run = 0, node.run
            while k < len(run) and at < len(path) and run[k] == path[at]:
                k, at = k + 1, at + 1
            if k < len(run):
                below = _Node(run[k:], 0, node.least, node.most, node.one)
                below.kids, below.ends = node.kids, node.ends
                below.rest = max([len(below.run) if below.ends else 0, *(len(below.run) + c.rest for c in below.kids.values())])
                node.run, node.kids, node.ends = run[:k], {run[k]: below}, []
            if at == len(path):
                node.ends.append(x)
                return
            child = node.kids.get(path[at])
            if child is None:
                child = node.kids[path[at]] = _Node(path[at:], len(path) - at, size, size, x)
                child.ends.append(x)
                return
            node = child

    def link(self, x: int) -> Iterator[tuple[int, int]]:
        """Links of ``x`` that join its class with others in the trie."""
        place = {t: i for i, t in enumerate(self.sets[x])}
        size, length, of = self.sizes[x], len(place), self.classes.of
        num, both, den = self.num, self.num + self.den, self.den
        stack = [(self.top, 0, -1)]
        while stack:
            node, overlap, last = stack.pop()
            if node.one is not None and of(node.one) == of(x):
                continue
            if node.most * den < num * size or node.least * num > den * size:
                continue
            need, rest, alive = -(-num * (size + node.least) // both), node.rest, True
            if overlap + min(length - 1 - last, rest) < need:
                continue
            for t in node.run:
                rest -= 1
                i = place.get(t)
                if i is not None:
                    overlap, last = overlap + 1, i
                elif overlap + min(length - 1 - last, rest) < need:
                    alive = False
                    break
            if not alive:
                continue
            for m in node.ends:
                if overlap * both >= num * (size + self.sizes[m]) and of(m) != of(x):
                    self.classes.up[of(x)] = of(m)
                    yield x, m
            if len(self.roots) > 1 or of(next(iter(self.roots), x)) != of(x):
                self.roots = {of(r) for r in self.roots}
            if len(self.roots) == 1 and of(x) in self.roots:
                return
            stack.extend((c, overlap, last) for c in node.kids.values())


def joined(sets: list[list[int]], sizes: list[int], first: list[bool], within: bool, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one group: among all its sets, or only between those that are ``first`` and the others."""
    trie = Trie(sets, sizes, num, den)
    order = sorted(range(len(sets)), key=lambda x: (sizes[x], x))
    if within:
        for x in order:
            yield from trie.link(x)
            trie.add(x)
        return
    for x in order:
        if first[x]:
            trie.add(x)
    for x in order:
        if not first[x]:
            yield from trie.link(x)


def table_bytes(df: DataFrame) -> int:
    """Spark's estimate for the scan, 0 where there is none (Spark then names a size beyond any table, a remote session nothing); it only chooses how many buckets there are."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, PySparkException):
        return 0
    return size if size < 1 << 56 else 0


def shared_sets(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per text: doc_id, text_hash, n (n-grams), node (hash of its set, null if empty) and, if it may have a partner, tokens (its shared n-grams, rarest first) and prefix (those that a partner must share one of)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table_bytes(own) // BUCKET_BYTES)
    bits = max(1, min(20, (least - 1).bit_length()))

    def send(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        of_text = [pa.list_(pa.int64())] * 4

        part, seq, ids, marks, sets, held = TaskContext.get().partitionId() << 24, 0, [], [], [], 0
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *of_text]
        names = ["bucket", "batch", "hashes", "texts", "ids", "marks", "sizes", "nodes"]

        def flush():
            batch = part + seq
            every, sizes = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            rows = [(batch % (1 << bits), batch, None, None, ids, marks, sizes.tolist(), nodes)]
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            cuts = np.searchsorted(every >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append((k, batch, to_planes(every[cuts[k] : cuts[k + 1]]), owner[cuts[k] : cuts[k + 1]].tobytes(), None, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for doc_id, mark, text in zip(b.column("id").to_pylist(), b.column("text_hash").to_pylist(), batches_of(b.column("text"))):
                s = shingle_set(text, width)
                ids.append(doc_id)
                marks.append(mark)
                sets.append(s)
                held += len(s)
                if held >= BATCH_TOKENS or len(ids) >= BATCH_TEXTS:
                    yield flush()
                    seq, ids, marks, sets, held = seq + 1, [], [], [], 0
        if ids:
            yield flush()

    def count(rows):
        """One bucket: which n-grams are in several texts, and in how many; sent back to their batches."""
        import pyarrow as pa

        of_text = [pa.list_(pa.int64())] * 4
        rows = rows.to_pylist()
        out = [(r["batch"], None, None, None, r["ids"], r["marks"], r["sizes"], r["nodes"]) for r in rows if r["ids"] is not None]
        rows = [r for r in rows if r["ids"] is None]
        if rows:
            parts = [from_planes(r["hashes"]) for r in rows]
            sizes = np.array([len(p) for p in parts])
            every, of = np.concatenate(parts), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
            order = np.argsort(every, kind="stable")
            ordered = every[order]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            starts = np.flatnonzero(fresh)
            counts = np.empty(len(every), np.uint32)
            counts[order] = np.repeat(np.diff(np.append(starts, len(every))), np.diff(np.append(starts, len(every))))
            ends = np.cumsum(sizes)
            for r, a, z in zip(rows, ends - sizes, ends):
                shared = np.flatnonzero(counts[a:z] > 1)
                if len(shared):
                    texts = np.frombuffer(r["texts"], np.uint16)[shared]
                    out.append((r["batch"], to_planes(every[a:z][shared]), texts.tobytes(), counts[a:z][shared].tobytes(), None, None, None, None))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *of_text]
        names = ["batch", "hashes", "texts", "counts", "ids", "marks", "sizes", "nodes"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)

    def assemble(rows):
        """One batch: its texts with their shared n-grams in the global order."""
        import pyarrow as pa

        rows = rows.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        parts = [r for r in rows if r["ids"] is None]
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        every = cat([from_planes(r["hashes"]) for r in parts], np.uint64)
        texts = cat([np.frombuffer(r["texts"], np.uint16) for r in parts], np.uint16)
        counts = cat([np.frombuffer(r["counts"], np.uint32) for r in parts], np.uint32)
        order = np.lexsort((every, counts, texts))
        every, texts = every[order].view(np.int64), texts[order]
        cuts = np.searchsorted(texts, np.arange(len(own["ids"]) + 1))
        tokens, prefix = [], []
        for i, n in enumerate(own["sizes"]):
            mine = every[cuts[i] : cuts[i + 1]]
            ask = prefix_size(n, num, den) - (n - len(mine)) if n else 0
            tokens.append(mine.tobytes() if ask > 0 else None)
            prefix.append(mine[:ask].tolist() if ask > 0 else None)
        return pa.Table.from_arrays([
            pa.array(own["ids"], pa.int64()), pa.array(own["marks"], pa.int64()), pa.array(own["sizes"], pa.int64()), pa.array(own["nodes"], pa.int64()), pa.array(tokens, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))
        ], names=["doc_id", "text_hash", "n", "node", "tokens", "prefix"])

    carried = "ids array<long>, marks array<long>, sizes array<long>, nodes array<long>"
    sent = own.mapInArrow(send, f"bucket int, batch long, hashes binary, texts binary, {carried}")
    replies = sent.groupBy("bucket").applyInArrow(count, f"batch long, hashes binary, texts binary, counts binary, {carried}")
    return replies.groupBy("batch").applyInArrow(assemble, "doc_id long, text_hash long, n long, node long, tokens binary, prefix array<long>")


def trie_links(sets: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """From (node, n, tokens, prefix), one row per different set: links (a, b) that span the classes."""
    asked = sets.select("node", F.explode("prefix").alias("token"))
    hubs = asked.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    candidates = components(asked.join(hubs, "token").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = materialise(sets.join(candidates, "node").select("label", "node", "n", "tokens"), "members")
    blocks = members.groupBy("label").agg(F.ceil(F.sum(F.octet_length("tokens")) / (8 * BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "tokens"
    )
    pairs = pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def walk(batches) -> Iterator:
        import pyarrow as pa

        key, rows = None, []

        def links():
            flat = np.concatenate([np.frombuffer(r["tokens"], np.int64) for r in rows])
            ends = np.cumsum([len(r["tokens"]) // 8 for r in rows])
            short = np.unique(flat, return_inverse=True)[1]
            sets = [p.tolist() for p in np.split(short, ends[:-1])]
            i, j = key[1], key[2]
            found = list(joined(sets, [r["n"] for r in rows], [r["block"] == i for r in rows], i == j, num, den))
            return pa.RecordBatch.from_pydict({"a": pa.array([rows[x]["node"] for x, _ in found], pa.int64()), "b": pa.array([rows[y]["node"] for _, y in found], pa.int64())})

        for b in batches:
            for r in b.to_pylist():
                k = (r["label"], r["i"], r["j"])
                if k != key:
                    if len(rows) > 1:
                        yield links()
                    key, rows = k, []
                rows.append(r)
        if len(rows) > 1:
            yield links()

    return pairs.mapInArrow(walk, "a long, b long")


def similarity_classes(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per text: doc_id, text_hash, n_shingles, component_id, the smallest doc_id that links lead to (itself included), and class_id, the class's own number (null without words).

    Texts of Jaccard similarity ``num / den`` or more over their distinct runs of ``width`` words are linked. Texts with fewer words are one run and link only with equal ones; null texts and
    texts without words are linked with nothing. Rows are texts of their own even when their ids are equal; a null doc_id stays and is nobody's component_id. Other columns are ignored.
    """
    every = materialise(shared_sets(docs, width, num, den, id_column, text_column), "sets")
    sets = every.filter("tokens is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
    links = trie_links(materialise(sets, "candidates"), num, den)
    # a set goes by its smallest doc_id (null last) and its hash, so that a component's label names its smallest doc_id
    own = every.filter("node is not null").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("least"), F.count(F.lit(1)).alias("texts"))
    named = own.select("node", F.struct("least", "node").alias("name"))
    ends = links.join(named.withColumnsRenamed({"node": "a", "name": "of_a"}), "a").join(named.withColumnsRenamed({"node": "b", "name": "of_b"}), "b")
    classes = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select("node.node", "label")
    # sets of one text without links are their own class: nothing to look up. The others are there for each salt, so that many copies of a text are several tasks
    shared = own.join(classes, "node", "left").filter("texts > 1 or label is not null").select("node", F.coalesce("label", F.struct("least", "node")).alias("label"))
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = every.select("doc_id", "text_hash", "n", "node", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt"))
    found = salted.join(materialise(shared, "classes"), ["node", "salt"], "left")
    return found.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.expr(f"if(label is null, doc_id, nullif(label.least, {NO_ID}))").alias("component_id"), F.coalesce("label.node", "node").alias("class_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class of ``similarity_classes`` keeps only its smallest doc_id (of rows alike in that, one). Texts without words all stay."""
    classes = materialise(similarity_classes(docs, width, num, den, id_column, text_column), "classes")
    kept = classes.filter("class_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    kept = kept.select("r.doc_id", "r.text_hash").unionByName(classes.filter("class_id is null").select("doc_id", "text_hash")).distinct()
    words = F.regexp_like(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD))
    own = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("hash"), F.when(words, 0).otherwise(F.monotonically_increasing_id() + 1).alias("apart"))
    own = own.join(kept, F.col("hash").eqNullSafe(F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    # of rows alike in id and text one stays: each task hands on one of them at most
    first = F.row_number().over(Window.partitionBy("hash", "id", "apart").orderBy("hash"))
    return own.withColumn("place", first).filter("place = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
