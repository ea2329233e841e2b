"""Benchmark decontamination by greedy string tiling.

Seeds are the Karp-Rabin hashes of all windows of ``tile`` words. A document's different windows are joined with the benchmark's; items of which enough is seeded are
tiled: the longest run of words that both hold and that touches no marked word is marked, again and again. An item's coverage is the share of its
words under tiles, so a passage counts however its parts are reordered.

The benchmark is the query set. It goes to the tasks in blocks of about ``BLOCK_WORDS`` words, each with one pass over the documents; a document never leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import WordHashes, batches_of, rolling, running_sums, word_hashes
from evidencelake.session import materialise

#: Words of the benchmark that one pass over the documents looks for (about 50 MB in each task).
BLOCK_WORDS = 2_000_000
_SIGNS = re.compile(r"[\W_]+")
_TABLE_BITS = 22


def folded(word: bytes) -> bytes:
    """A word in lower case without its signs."""
    if word.isalpha():
        return word.lower()
    return _SIGNS.sub("", word.decode().lower()).encode()


class Block:
    """Some items and the table of their seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]], tile: int) -> None:
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        seeds = [rolling(w, tile) for w in self.words]
        every = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds = every[order]
        self.item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order]
        self.at = np.concatenate([np.arange(len(s)) for s in seeds])[order] if seeds else np.empty(0, np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.seeds >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def hits(self, windows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place in the item) of every seed that a text holds, however often it does."""
        maybe = np.flatnonzero(self.table[(windows >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        windows, owner = windows[maybe], owner[maybe]
        order = np.lexsort((windows, owner))
        windows, owner = windows[order], owner[order]
        fresh = np.concatenate([[True], (windows[1:] != windows[:-1]) | (owner[1:] != owner[:-1])])[: len(windows)]
        windows, owner = windows[fresh], owner[fresh]
        low, high = np.searchsorted(self.seeds, windows, "left"), np.searchsorted(self.seeds, windows, "right")
        n = high - low
        found = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(owner, n), self.item[found], self.at[found]


class Automaton:
    """The suffix automaton of an item: read a text word by word, and it knows the longest run of words up to there that the item holds, and where that run first ends in the item."""

    def __init__(self, words: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for place, word in enumerate(words):
            new = self._state({}, self.size[last] + 1, place)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state < 0:
                self.link[new] = 0
            else:
                after = self.next[state][word]
                if self.size[after] == self.size[state] + 1:
                    self.link[new] = after
                else:
                    copy = self._state(dict(self.next[after]), self.size[state] + 1, self.end[after])
                    self.link[copy] = self.link[after]
                    while state >= 0 and self.next[state].get(word) == after:
                        self.next[state][word] = copy
                        state = self.link[state]
                    self.link[after] = self.link[new] = copy
            last = new

    def _state(self, after: dict[int, int], size: int, end: int) -> int:
        self.next.append(after)
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def read(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: the length of the longest run that ends there, and the place in the item where that run first ends."""
        sizes, ends = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        state, size, after, link, most, end = 0, 0, self.next, self.link, self.size, self.end
        for k, word in enumerate(words):
            step = after[state].get(word)
            while step is None and state:
                state = link[state]
                size = most[state]
                step = after[state].get(word)
            if step is not None:
                state, size = step, size + 1
            sizes[k], ends[k] = size, end[state]
        return sizes, ends


def free_run(marked: np.ndarray) -> np.ndarray:
    """How many unmarked words in a row end at each place."""
    places = np.arange(len(marked))
    return places - np.maximum.accumulate(np.where(marked, places, -1))


class Item:
    """An item's words, for asking how far the runs that end at two of its places agree."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.levels = words, [np.unique(words, return_inverse=True)[1]]
        while 1 << len(self.levels) <= len(words):
            half, ids = 1 << len(self.levels) - 1, self.levels[-1]
            both = np.stack([ids[half:], ids[:-half]], axis=1)
            names = np.unique(both, axis=0, return_inverse=True)[1].ravel()
            # places before a whole window have names of their own
            self.levels.append(np.concatenate([-1 - np.arange(half, dtype=np.int64), names]))

    def agree(self, end: int) -> np.ndarray:
        """For each place, the length of the longest run that ends both there and at ``end``."""
        places, size = np.arange(len(self.words)), np.zeros(len(self.words), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            width, ids = 1 << level, self.levels[level]
            fits = (places - size >= width - 1) & (end - size >= width - 1)
            same = fits & (ids[np.maximum(places - size, 0)] == ids[np.maximum(end - size, 0)])
            size += np.where(same, width, 0)
        return size


def tiles(doc: np.ndarray, item: np.ndarray, tile: int, seeds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The greedy tiling: (document, item, words), longest first; ties by place in the document, then the item.

    Memory is linear in the document, whatever repeats. The automaton gives each place of the document the longest run of the item that ends there; marks only shorten those, so that a round looks at the
    longest and measures it anew against the item's unmarked words, once for all places where the same run ends. ``seeds`` (hashes of all windows of the document) leaves out what holds none of the item's.
    """
    automaton, own = Automaton(item.tolist()), Item(item)
    longest, ends = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
    held = np.ones(max(0, len(doc) - tile + 1), bool) if seeds is None else np.isin(seeds, rolling(item, tile))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        sizes, where = automaton.read(doc[a : b + tile - 1].tolist())
        # stretches overlap by less than a window: keep what is longer
        better = sizes > longest[a : b + tile - 1]
        longest[a : b + tile - 1][better], ends[a : b + tile - 1][better] = sizes[better], where[better]
    places = np.flatnonzero(longest >= tile)
    longest, ends = longest[places].astype(np.int64), ends[places]
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while len(places):
        free = free_run(in_item)
        bound = np.minimum(np.minimum(longest, int(free.max(initial=0))), free_run(in_doc)[places])
        most = int(bound.max(initial=0))
        if most < tile:
            break
        asked = np.flatnonzero(bound == most)
        while len(asked):
            k = int(asked[0])
            runs = np.minimum(own.agree(int(ends[k])), free)
            real = min(int(runs.max()), int(longest[k]))
            if real >= most:
                i, j = int(places[k]), int(np.flatnonzero(runs >= most)[0])
                in_doc[i - most + 1 : i + 1] = in_item[j - most + 1 : j + 1] = True
                out.append((i - most + 1, j - most + 1, most))
                break
            longest[(ends == ends[k]) & (longest == longest[k])] = real
            asked = asked[longest[asked] >= most]
        keep = longest >= tile
        if not keep.all():
            places, longest, ends = places[keep], longest[keep], ends[keep]
    return out


def tiled_items(texts: list[bytes | None], block: Block, hashes: WordHashes, tile: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words under tiles, tiles, longest tile) of each pair that reaches the coverage."""
    own = [w[w != 0] for w in map(hashes.of, texts)]
    starts = np.cumsum([0, *map(len, own)])
    if starts[-1] < tile:
        return
    windows = rolling(np.concatenate(own), tile)
    owner = np.searchsorted(starts, np.arange(len(windows)), "right") - 1
    inside = np.arange(tile, len(windows) + tile) <= starts[owner + 1]
    text, item, at = block.hits(windows[inside], owner[inside])
    # no tiling covers more of an item than all its seeds found together do
    pair, index = np.unique(text * len(block.ids) + item, return_inverse=True)
    order = np.lexsort((at, index))
    same = np.concatenate([[False], index[order][1:] == index[order][:-1]])[: len(order)]
    gap = np.concatenate([[tile], np.minimum(np.diff(at[order]), tile)])[: len(order)]
    most = np.bincount(index[order], np.where(same, gap, tile), len(pair))
    for k in np.flatnonzero(most >= coverage * block.sizes[pair % len(block.ids)]).tolist() if len(pair) else ():
        text, which = divmod(int(pair[k]), len(block.ids))
        found = tiles(own[text], block.words[which], tile, windows[starts[text] : starts[text + 1] - tile + 1])
        words = sum(size for _, _, size in found)
        if words >= coverage * block.sizes[which]:
            yield text, which, words, len(found), found[0][2]


def benchmark_blocks(benchmark: DataFrame, tile: int, id_column: str, text_column: str) -> Iterator[Block]:
    """The items of at least ``tile`` words in blocks of about ``BLOCK_WORDS`` words, hashed by tasks and written first; one block at a time is read."""

    def hash_words(batches) -> Iterator:
        import pyarrow as pa

        hashes = word_hashes(folded)
        for b in batches:
            words = [w[w != 0] for w in map(hashes.of, batches_of(b.column("text")))]
            rows = [(i, w.tobytes(), len(w)) for i, w in zip(b.column("id").to_pylist(), words) if len(w) >= tile]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["id", "words", "n"])

    items = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(hash_words, "id long, words binary, n long")
    placed = running_sums(items, ["id", "words"], {"place": "n"})
    placed = materialise(placed.withColumn("block", (F.col("place") / BLOCK_WORDS).cast("long")), "benchmark")
    last = placed.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        rows = placed.filter(F.col("block") == block).orderBy("place").collect()
        if rows:
            yield Block([(r.id, np.frombuffer(r.words, np.uint64)) for r in rows], tile)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, tile: int = 5, coverage: float = 0.5, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest_tile of every document and item of which at least ``coverage`` is tiled in the whole text.

    Words are compared in lower case without signs. Items with fewer than ``tile`` such words have no seed and match nothing; null and empty texts match nothing. Repeated rows
    are judged one by one, other columns are ignored. An empty benchmark or an empty table gives no rows. With several blocks, each one's rows are written before the next is read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, tiles long, longest_tile long"
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    out, pending = spark.createDataFrame([], schema), None
    for block in benchmark_blocks(benchmark, tile, item_column, item_text):
        if pending is not None:
            out = out.unionByName(_written(pending))
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent) -> Iterator:
            import pyarrow as pa

            hashes, block = word_hashes(folded), sent.value
            for b in batches:
                ids = b.column("id").to_pylist()
                rows = [(ids[t], block.ids[i], words / int(block.sizes[i]), n, longest) for t, i, words, n, longest in tiled_items(batches_of(b.column("text")), block, hashes, tile, coverage)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "coverage", "tiles", "longest_tile"])

        pending = (own.mapInArrow(search, schema), sent)
    return out if pending is None else out.unionByName(pending[0])


def _written(pending) -> DataFrame:
    """A block's rows as a written table; its broadcast is let go."""
    rows, sent = pending
    table = materialise(rows, "block")
    sent.unpersist()
    return table


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = 5, coverage: float = 0.5, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``benchmark_matches`` finds nothing, with all their columns and without a join.

    Null, empty and short texts stay, and so does everything when the benchmark is empty; repeated rows stay or go alike; an empty table stays empty. With several blocks, what one leaves is written before the
    next is read.
    """
    at, pending = docs.columns.index(text_column), None
    for block in benchmark_blocks(benchmark, tile, item_column, item_text):
        left = docs if pending is None else _written(pending)
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, sent=sent) -> Iterator:
            import pyarrow as pa

            hashes, block = word_hashes(folded), sent.value
            for b in batches:
                stay = np.ones(b.num_rows, bool)
                stay[[t for t, *_ in tiled_items(batches_of(b.column(at)), block, hashes, tile, coverage)]] = False
                yield b.filter(pa.array(stay))

        pending = (left.mapInArrow(clean, docs.schema), sent)
    return docs if pending is None else pending[0]
