"""Quality rules on repetition inside a text, from suffix arrays over its words.

A chunk of texts gets one suffix array by prefix doubling: every level tells which stretches of 1, 2, 4 ... words are equal, and only
suffixes that are still tied are sorted again. Adjacent suffixes' longest common prefixes follow from the levels. A suffix whose longer
neighbour shares L words with it starts a repeat of L words; the union of these spans is what repeated substrings cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import batches_of, mix64, word_hashes

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words of texts that are sorted together; a longer text is sorted alone.
CHUNK_WORDS = 400_000


@dataclass(frozen=True)
class Limits:
    """A text is rejected when repeats of at least ``least`` words cover more than ``share`` of its words, or one is longer than ``longest`` words."""

    least: int = 8
    share: float = 0.4
    longest: int = 100


def repeat_lengths(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position the length in words of the longest stretch from there that its text holds once more.

    ``words`` are hashes of the words of some texts on end, ``owner`` numbers the text that each belongs to, ascending.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    key = mix64(words ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    array = np.argsort(key, kind="stable")
    ordered = key[array]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)).astype(np.int32)
    rank = np.full(n + 1, -1, np.int32)
    rank[array] = first
    levels, step = [rank.copy()], 1
    tied = np.zeros(n, bool)
    tied[:-1] |= ~fresh[1:]
    tied[1:] |= ~fresh[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = array[slots]
        ahead = np.minimum(at + step, n)
        # past the end of its text a suffix is unlike all others there: ranks differ between texts
        pair = rank[at].astype(np.int64) * (n + 1) + (rank[ahead].astype(np.int64) + 1)
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        array[slots] = at
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)).astype(np.int32)
        step *= 2
        levels.append(rank.copy())
        tied = np.zeros(len(slots), bool)
        tied[:-1] |= ~fresh[1:]
        tied[1:] |= ~fresh[1:]
        slots = slots[tied]
    same = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    left, right = array[same].copy(), array[same + 1].copy()
    length = np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        equal = levels[level][left] == levels[level][right]
        length[equal] += 1 << level
        left[equal] += 1 << level
        right[equal] += 1 << level
    out = np.zeros(n, np.int64)
    np.maximum.at(out, array[same], length)
    np.maximum.at(out, array[same + 1], length)
    return out


def covered(lengths: np.ndarray, least: int, at_most: int | None = None) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words; ``at_most`` shortens the repeats to their first words."""
    start = np.flatnonzero(lengths >= least)
    span = lengths[start] if at_most is None else np.minimum(lengths[start], at_most)
    edges = np.zeros(len(lengths) + 1, np.int64)
    edges[start] += 1
    np.subtract.at(edges, start + span, 1)
    return np.cumsum(edges[:-1]) > 0


def plain_counts(text: str) -> tuple[int, int, int]:
    """Code points in words, symbol characters, lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def measured(texts: list[bytes | None], least: int) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` for some texts."""
    hashes = word_hashes()
    rows: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        sizes = np.array([len(w) for w in held], np.int64)
        owner = np.repeat(np.arange(len(held)), sizes)
        lengths = repeat_lengths(np.concatenate(held), owner)
        base, cover = covered(lengths, 3, 3), covered(lengths, least)
        longest = np.zeros(len(held), np.int64)
        np.maximum.at(longest, owner, lengths)
        rows.append(np.stack([sizes, np.bincount(owner, base, len(held)).astype(np.int64), np.bincount(owner, cover, len(held)).astype(np.int64), longest]))
        held.clear()

    count = 0
    for t in texts:
        words = hashes.of(t)
        if held and count + len(words) > CHUNK_WORDS:
            flush()
            count = 0
        held.append(words)
        count += len(words)
    if held:
        flush()
    n_words, repeats, cover, longest = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
    plain = np.array([plain_counts((t or b"").decode()) for t in texts], np.int64).reshape(-1, 3)
    return [n_words, plain[:, 0], plain[:, 1], plain[:, 2], repeats, cover, longest]


def judged(counts: list[np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    n_words, repeats, cover, longest = counts[0], counts[4], counts[5], counts[6]
    base = (n_words < 50) | (repeats * 100 > n_words * 50)
    return base, ~base & (cover <= n_words * limits.share) & (longest <= limits.longest)


def repetition(docs: DataFrame, text_column: str = "text", limits: Limits = Limits(), columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or only ``columns`` of it) with the counts of ``SCHEMA``, base_failed and kept; one pass, no shuffle.

    Whole texts are measured. Null and empty texts have no words and fail the base rule of 50 words; repeated rows are judged alike; columns of the new names are replaced.
    """
    schema = f"{SCHEMA}, base_failed boolean, kept boolean"
    made = [c.split()[0] for c in schema.split(", ")]
    keep = [c for c in (columns if columns is not None else docs.columns) if c not in made]
    carried = docs.select(*keep, F.col(text_column).alias("_text"))

    def measure(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            counts = measured(batches_of(b.column(len(keep))), limits.least)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *map(pa.array, [*counts, *judged(counts, limits)])], names=[*keep, *made])

    return carried.mapInArrow(measure, _extended(carried, len(keep), schema))


def drop_repetitive(docs: DataFrame, text_column: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that ``repetition`` keeps, with their columns as they are."""
    at = docs.columns.index(text_column)

    def clean(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(judged(measured(batches_of(b.column(at)), limits.least), limits)[1]))

    return docs.mapInArrow(clean, docs.schema)


def _extended(df: DataFrame, n: int, schema: str):
    """The first ``n`` fields of ``df`` and those of ``schema``."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields[:n], *StructType.fromDDL(schema).fields])
