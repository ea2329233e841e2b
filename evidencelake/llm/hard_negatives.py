"""Hard negatives by an inverted multi-index over embeddings.

1. Components become integers. Two codebooks are fitted, one for each half of the dimensions, by k-means on a sample of at most ``SAMPLE_ROWS`` rows drawn by a hash.
2. All rows are dealt evenly to shards of about ``SHARD_BYTES``. Within a shard, a row belongs to the cell of its two nearest codewords; each codeword knows its radius there, the greatest distance
   of one of its rows' halves. For an anchor half ``a`` no row of codeword ``c`` scores more than ``a.c + |a| radius``.
3. An anchor visits a shard's cells in the order of their summed half bounds, which a heap over the two sorted lists of half bounds gives (the multi-sequence walk). It stops when the next cell's bound
   cannot better what it holds: first for the best rows of its own label, then for the window below each of those positives. Results are thus exact; the codebooks only decide how soon it stops.
4. Anchors meet the shards in blocks; what the shards found is merged by rank. First all positives are merged, then their windows are searched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.session import materialise


SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
CODES, ROUNDS = 16, 12
SHARD_BYTES, BLOCK_ANCHORS = 16 << 20, 64
#: Components are held between these, so that scores stay 64-bit integers.
LIMIT = 1 << 27


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """From (id, label, vector, anchor): the rows with a label and finite components only, with ``codes``: each component times ``scale``, rounded down, as packed 32-bit integers."""

    def pack(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column("vector")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (odd[ends] == odd[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False) & b.column("label").is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                codes = np.clip(np.floor(np.nan_to_num(flat) * scale), -LIMIT, LIMIT).astype("<i4")
            kept = np.flatnonzero(good)
            own = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), own.column("label"), own.column("anchor"), pa.array(sizes[kept], pa.int32()), pa.array([codes[z - n : z].tobytes() for z, n in zip(ends[kept], sizes[kept])], pa.binary())],
                names=["id", "label", "anchor", "dims", "codes"],
            )

    return rows.mapInArrow(pack, "id long, label long, anchor boolean, dims int, codes binary")


def matrix(codes: list[bytes], dims: int) -> np.ndarray:
    """Packed rows as a matrix; a shorter row ends in zeros."""
    out = np.zeros((len(codes), dims), "<i4")
    for row, code in zip(out, codes):
        row[: len(code) // 4] = np.frombuffer(code, "<i4")
    return out


def codebook(points: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords by k-means, from points spread over the sample as a start."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    points = np.unique(points.astype(np.float64), axis=0)
    words = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, words)
        sums, counts = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * (points @ words.T), axis=1)


def codewords(book: bytes, width: int) -> np.ndarray:
    return np.frombuffer(book, np.float64).reshape(-1, width) if width else np.zeros((1, 0))


def halves(dims: int) -> tuple[int, int]:
    return dims // 2, dims - dims // 2


class Shard:
    """Rows in the order of their cells."""

    def __init__(self, row) -> None:
        self.dims, self.words = row["dims"], [codewords(row[f"words{h}"], n) for h, n in enumerate(halves(row["dims"]))]
        self.keys, self.ids, self.labels = (np.array(row[k], dtype) for k, dtype in (("keys", np.int64), ("ids", object), ("labels", np.int64)))
        self.codes = np.frombuffer(row["codes"], "<i4").reshape(-1, self.dims)
        self.starts, self.radii = np.array(row["starts"], np.int64), [np.array(row["radii0"]), np.array(row["radii1"])]
        self.most = int(np.abs(self.codes).max(initial=0))
        self.wide = self.codes.astype(np.float64) if self.most * self.most * self.dims < 1 << 52 else self.codes.astype(np.int64)

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, end) of the cells with rows, by falling bound: the multi-sequence walk over the two lists of half bounds."""
        lists, at = [], 0
        for words, radii in zip(self.words, self.radii):
            half = anchor[at : at + words.shape[1]].astype(np.float64)
            at += words.shape[1]
            bounds = words @ half + np.linalg.norm(half) * radii
            bounds[radii < 0] = -np.inf
            order = np.argsort(-bounds, kind="stable")
            lists.append((bounds[order].tolist(), order.tolist()))
        (u, of_u), (v, of_v) = lists
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                return
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            cell = of_u[i] * len(v) + of_v[j]
            if self.starts[cell] < self.starts[cell + 1]:
                yield -bound, int(self.starts[cell]), int(self.starts[cell + 1])

    def scores(self, anchor: np.ndarray, first: int, end: int) -> np.ndarray:
        if self.wide.dtype == np.float64 and self.most * int(np.abs(anchor).max(initial=0)) * self.dims < 1 << 52:
            return (self.wide[first:end] @ anchor.astype(np.float64)).astype(np.int64)
        return self.codes[first:end].astype(np.int64) @ anchor.astype(np.int64)

    def entry(self, row: int, score: int) -> tuple:
        """Greater is better: by score, then smaller id, null last."""
        i = self.ids[row]
        return (score, i is not None, -(i or 0), row)

    def positives(self, key: int, label: int, anchor: np.ndarray, best: int) -> list[tuple]:
        """The shard's best rows of the label, other than the row ``key``."""
        heap: list[tuple] = []
        for bound, first, end in self.visits(anchor):
            if len(heap) == best and bound + 1 < heap[0][0]:
                break
            scores = self.scores(anchor, first, end)
            fit = (self.labels[first:end] == label) & (self.keys[first:end] != key)
            if len(heap) == best:
                fit &= scores >= heap[0][0]
            for k in np.flatnonzero(fit).tolist():
                (heapq.heappush if len(heap) < best else heapq.heappushpop)(heap, self.entry(first + k, int(scores[k])))
        return heap

    def negatives(self, label: int, anchor: np.ndarray, tops: list[int], best: int, low: int, high: int, of: int) -> list[list[tuple]]:
        """For each score in ``tops``, the shard's best rows of other labels between ``low`` and ``high`` parts in ``of`` of it."""
        heaps: list[list[tuple]] = [[] for _ in tops]
        open_ = [k for k, top in enumerate(tops) if low * top <= high * top]
        for bound, first, end in self.visits(anchor):
            open_ = [k for k in open_ if of * (bound + 1) >= low * tops[k] and (len(heaps[k]) < best or bound + 1 >= heaps[k][0][0])]
            if not open_:
                break
            scores = self.scores(anchor, first, end)
            least, most = min(low * tops[k] for k in open_), max(high * tops[k] for k in open_)
            fit = np.flatnonzero((self.labels[first:end] != label) & (of * scores >= least) & (of * scores <= most))
            if not len(fit):
                continue
            values = scores[fit]
            for k in open_:
                heap = heaps[k]
                mine = (of * values >= low * tops[k]) & (of * values <= high * tops[k])
                if len(heap) == best:
                    mine &= values >= heap[0][0]
                for x in np.flatnonzero(mine).tolist():
                    (heapq.heappush if len(heap) < best else heapq.heappushpop)(heap, self.entry(first + int(fit[x]), int(values[x])))
        return heaps


def build_shards(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, codes: int = CODES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The multi-index of quantised rows: a row per shard with its rows in the order of their cells, the cells' starts and the codewords' radii (-1: no rows)."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).first()
    dims = size.dims or 0
    wanted = max(1, min(sample_rows, SAMPLE_BYTES // max(1, 4 * dims)))
    sample = rows.select("codes").orderBy(F.xxhash64("id", "codes"), "codes").limit(wanted).coalesce(1)

    def fit(batches) -> Iterator:
        import pyarrow as pa

        points = matrix([c for b in batches for c in b.column("codes").to_pylist()], dims)
        if len(points):
            left = halves(dims)[0]
            yield pa.RecordBatch.from_pydict({f"words{h}": pa.array([codebook(part, codes).tobytes()], pa.binary()) for h, part in enumerate((points[:, :left], points[:, left:]))})

    # two times ``codes`` codewords: bounded
    words = sample.mapInArrow(fit, "words0 binary, words1 binary").collect()
    books = [bytes(w) for w in words[0]] if words else [b"", b""]
    names = ["shard", "dims", "words0", "words1", "keys", "ids", "labels", "anchors", "codes", "starts", "radii0", "radii1"]

    def pack(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        ids, labels, anchors, packed = [], [], [], []
        for b in batches:
            for held, name in ((ids, "id"), (labels, "label"), (anchors, "anchor"), (packed, "codes")):
                held += b.column(name).to_pylist()
        if not ids:
            return
        own, cell, radii, at = matrix(packed, dims), np.zeros(len(ids), np.int64), [], 0
        for book, width in zip(books, halves(dims)):
            points, at = own[:, at : at + width].astype(np.float64), at + width
            vocabulary = codewords(book, width)
            near = nearest(points, vocabulary)
            far = np.full(len(vocabulary), -1.0)
            # a little more than measured, for what floating point rounds off
            np.maximum.at(far, near, np.linalg.norm(points - vocabulary[near], axis=1) * (1 + 1e-9) + 1e-6)
            radii.append(far.tolist())
            cell = cell * len(vocabulary) + near
        order = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[order], np.arange(np.prod([len(r) for r in radii]) + 1))
        pick = lambda xs: [xs[k] for k in order.tolist()]
        keys = ((shard << 32) + np.arange(len(ids))).tolist()
        row = [shard, dims, *books, keys, pick(ids), pick(labels), pick([bool(a) for a in anchors]), own[order].tobytes(), starts.tolist(), *radii]
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), longs, longs, longs, pa.list_(pa.bool_()), pa.binary(), longs, doubles, doubles]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    shards = max(1, -(-(size.n or 0) * max(1, dims) * 4 // shard_bytes))
    packed = rows.repartition(shards).mapInArrow(
        pack, "shard long, dims int, words0 binary, words1 binary, keys array<long>, ids array<long>, labels array<long>, anchors array<boolean>, codes binary, starts array<long>, radii0 array<double>, radii1 array<double>"
    )
    return materialise(packed, "shards")


def anchors_of(shards: DataFrame) -> DataFrame:
    """key, id, label, codes of the anchors."""

    def unpack(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                at, width = np.flatnonzero(row["anchors"]).tolist(), 4 * row["dims"]
                pick = [[row[k][x] for x in at] for k in ("keys", "ids", "labels")] + [[row["codes"][x * width : (x + 1) * width] for x in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(pick, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "id", "label", "codes"])

    return shards.select("keys", "ids", "labels", "anchors", "codes", "dims").mapInArrow(unpack, "key long, id long, label long, codes binary")


def _meet(anchors: DataFrame, shards: DataFrame) -> DataFrame:
    """The shards beside each block of at most ``BLOCK_ANCHORS`` rows of ``anchors`` (as arrays named ``a_...``).

    A shard goes to one task; with fewer shards than twice the shuffle partitions, to several that share its blocks. The two meet by a merge join: as a broadcast, the
    blocks would all be searched by the few tasks that read the shards.
    """
    names, kinds = anchors.columns, dict(anchors.dtypes)
    partitions = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    spread = max(1, -(-2 * partitions // count))

    def pack(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ANCHORS):
                some, part = b.slice(at, BLOCK_ANCHORS), part + 1
                yield pa.RecordBatch.from_arrays([pa.array([part % spread], pa.int64()), *(pa.array([c.to_pylist()], pa.list_(c.type)) for c in some.columns)], names=["part", *(f"a_{n}" for n in names)])

    blocks = anchors.mapInArrow(pack, ", ".join(["part long", *(f"a_{n} array<{kinds[n]}>" for n in names)]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocks = blocks.withColumn("shard", every(count)).repartition(partitions, "shard", "part").hint("merge")
    return blocks.join(shards.drop("anchors").withColumn("part", every(spread)), ["shard", "part"])


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, of: int = 100,
    sample_rows: int = SAMPLE_ROWS, codes: int = CODES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors (null: not), ``label`` is the label to go by. Scores are inner products of components times ``scale``, rounded down. An anchor's positives are its first
    ``positives`` other rows of its label, the negatives of each the first ``negatives`` rows of other labels with ``low * positive <= of * negative <= high * positive``; higher scores come first, ties by
    smaller id, null last. A positive without negatives has no row.

    Rows with a null label, a null vector or a component that is null or not finite take no part. A row of null or repeated id is a row of its own; a vector shorter than the longest ends in zeros, an empty
    one scores 0; components beyond 2**27 count as that. Other columns are ignored. Empty tables give no rows.
    """
    own = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    index = build_shards(materialise(quantised(own, scale), "vectors"), sample_rows, codes, shard_bytes)
    asking = materialise(anchors_of(index), "anchors")

    def near(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                shard, out = Shard(row), []
                for key, i, mark, anchor_codes in zip(row["a_key"], row["a_id"], row["a_label"], matrix(row["a_codes"], row["dims"])):
                    out += [(key, i, shard.ids[x], score, int(shard.keys[x])) for score, _, _, x in shard.positives(key, mark, anchor_codes, positives)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out) or ()] if out else [pa.array([], pa.int64())] * 5, names=["key", "anchor_id", "positive_id", "positive_score", "positive_key"])

    first = Window.partitionBy("key").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_key")
    found = _meet(asking, index).mapInArrow(near, "key long, anchor_id long, positive_id long, positive_score long, positive_key long")
    found = materialise(found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives).drop("positive_key"), "positives")
    windows = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("w")).select("key", F.col("w.positive_score").alias("tops"))

    def between(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                shard, out = Shard(row), []
                for key, mark, anchor_codes, tops in zip(row["a_key"], row["a_label"], matrix(row["a_codes"], row["dims"]), row["a_tops"]):
                    for place, heap in enumerate(shard.negatives(mark, anchor_codes, tops, negatives, low, high, of), 1):
                        out += [(key, place, shard.ids[x], score) for score, _, _, x in heap]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["key", "place", "negative_id", "negative_score"])

    below = _meet(asking.join(windows, "key").select("key", "label", "codes", "tops"), index).mapInArrow(between, "key long, place long, negative_id long, negative_score long")
    next_ = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    below = below.withColumn("rank", F.row_number().over(next_)).filter(F.col("rank") <= negatives)
    return found.join(below, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
