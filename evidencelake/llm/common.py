"""What the operators share: intermediate tables, running sums over a total order, words and hashes of texts."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.session import materialise

#: A word is a run of anything but ASCII space and the ASCII controls 9 to 13 - what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"


def hash_bits(spark: SparkSession, times: float) -> int:
    """Leading bits of a hash that deal it to at least ``times`` buckets per shuffle partition of the session."""
    return min(24, max(1, (math.ceil(times * int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()))


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str | Column]) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of that column over all rows before it in the order.

    Rows are dealt by ranges of the order, so no key is held by one task; the only un-partitioned window runs over
    one row per range. ``order`` should be unique, else the order among ties is arbitrary (but each row is counted once).
    The frame is written once, because the ranges must not be drawn anew between the two passes over it.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.withColumns({f"_o{i}": k for i, k in enumerate(keys)} | {f"_v{n}": F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(0)) for n, v in sums.items()})
    named = [f"_o{i}" for i in range(len(keys))]
    ranged = materialise(ranged.repartitionByRange(*named).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_v{n}").alias(f"_t{n}") for n in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_t{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*named).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"_v{n}": F.coalesce(F.sum(f"_v{n}").over(within), F.lit(0)) for n in sums})
    return placed.join(totals, "_range").select(*df.columns, *[(F.col(f"_v{n}") + F.col(f"_t{n}")).alias(n) for n in sums])


def hash64(*parts: str | Column) -> Column:
    """A 64-bit hash that is the same in every run."""
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts])


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last; ``key`` may fold a word first, and None drops it to 0."""

    def __init__(self, key=None, most: int = 300_000) -> None:
        super().__init__()
        self.key, self.most = key, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        folded = self.key(word) if self.key else word
        value = self[word] = (xxhash.xxh3_64_intdigest(folded) or 1) if folded else 0
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_HELD: dict = {}


def held(kind, make):
    """What ``make`` gives, kept in this worker process until another kind is asked for: stages that follow one another do not add up their caches."""
    if kind not in _HELD:
        _HELD.clear()
        _HELD[kind] = make()
    return _HELD[kind]


def word_hashes(key=None) -> WordHashes:
    """The worker's cache for this folding function."""
    return held(("words", key), lambda: WordHashes(key))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` hashes, by Horner's rule in 64 bits."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _MIX
        out += hashes[k : k + n]
    return mix64(out)


def batches_of(column) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
