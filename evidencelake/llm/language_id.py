"""Language identification by unigram piece models, summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. The likelihood of a word is the sum over all ways to cut it into pieces
of the product of their probabilities - the forward algorithm - and a text's is the product over its words. Piece probabilities come from expected counts
over the same segmentations (two rounds of expectation and maximisation), gathered by Spark from the word counts of a sample of labelled texts.

A word is taken in lower case without its signs, behind the vocabulary's word mark. A character that is no piece counts as one unknown piece.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import batches_of, held
from evidencelake.llm.decontaminate import folded
from evidencelake.session import materialise

#: Labelled texts of each language to learn from, about: the sample is drawn by a hash of the id.
TRAIN_TEXTS = 20_000
_RESCALE = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a sentencepiece model, as an index of strings."""

    def __init__(self, file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.names = [n for n in names if n.strip("▁")] + ["▁"]
        self.index = {n: i for i, n in enumerate(self.names)}
        self.longest = max(map(len, self.names))
        self.unknown = len(self.names)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for length in range(1, self.longest + 1):
            own = [n for n in self.names if len(n) == length]
            keys = next(h for k, h in self.hashes(own) if k == length).ravel() if own else np.empty(0, np.uint64)
            order = np.argsort(keys)
            self.by_length.append((keys[order], np.array([self.index[n] for n in own], np.int32)[order]))

    def hashes(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """For words of one length, by length of substring: [word, start] -> 64-bit hash."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
        out = codes
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            if length > 1:
                out = out[:, :-1] * _BASE + codes[:, length - 1 :]
            yield length, out

    def cuts(self, words: list[str]) -> np.ndarray:
        """For words of one length: [word, end - 1, length - 1] -> piece, or -1."""
        n = len(words[0])
        out = np.full((len(words), n, self.longest), -1, np.int32)
        for length, hashes in self.hashes(words):
            keys, pieces = self.by_length[length - 1]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out[:, length - 1 :, length - 1] = np.where(keys[at] == hashes, pieces[at], -1)
        single = out[:, :, 0]
        single[single < 0] = self.unknown
        return out


@functools.cache
def pieces_of(file: str) -> Pieces:
    """One index per worker and file."""
    return Pieces(file)


def forward(cuts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Log-likelihoods [word, language]: sums over all segmentations, rescaled every few characters."""
    many, n, k = cuts.shape
    padded = np.concatenate([probs, np.zeros((1, probs.shape[1]))])  # piece -1
    sums = np.zeros((many, n + 1, probs.shape[1]))
    sums[:, 0] = 1
    scale = np.zeros((many, probs.shape[1]))
    for j in range(1, n + 1):
        for length in range(1, min(k, j) + 1):
            piece = cuts[:, j - 1, length - 1]
            if (piece >= 0).any():
                sums[:, j] += sums[:, j - length] * padded[piece]
        if j % _RESCALE == 0:
            by = sums[:, j].copy()
            scale += np.log(by)
            sums[:, max(0, j - k) : j + 1] /= by[:, None]
    return np.log(sums[:, n]) + scale


def log_sums(cuts: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """[word, end, language]: logs of the sums over all segmentations of the first ``end`` characters, rescaled as in ``forward``."""
    many, n, k = cuts.shape
    sums = np.zeros((many, n + 1, padded.shape[1]))
    sums[:, 0] = 1
    scale = np.zeros_like(sums)
    for j in range(1, n + 1):
        scale[:, j] = scale[:, j - 1]
        for length in range(1, min(k, j) + 1):
            piece = cuts[:, j - 1, length - 1]
            if (piece >= 0).any():
                sums[:, j] += sums[:, j - length] * padded[piece]
        if j % _RESCALE == 0:
            by = sums[:, j].copy()
            sums[:, max(0, j - k) : j + 1] /= by[:, None]
            scale[:, max(0, j - k) : j + 1] += np.log(by)[:, None]
    return np.log(sums) + scale


def expected(cuts: np.ndarray, probs: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """Add the expected piece counts of words [word, language] to ``out`` [piece, language]."""
    _, n, k = cuts.shape
    padded = np.concatenate([probs, np.zeros((1, probs.shape[1]))])
    mirrored = np.full_like(cuts, -1)
    for length in range(1, min(k, n) + 1):
        mirrored[:, length - 1 :, length - 1] = cuts[:, length - 1 :, length - 1][:, ::-1]
    ahead, behind = log_sums(cuts, padded), log_sums(mirrored, padded)[:, ::-1]
    whole, logs = ahead[:, n], np.log(probs)
    for j in range(1, n + 1):
        for length in range(1, min(k, j) + 1):
            piece = cuts[:, j - 1, length - 1]
            at = np.flatnonzero(piece >= 0)
            if len(at):
                np.add.at(out, piece[at], np.exp(ahead[at, j - length] + logs[piece[at]] + behind[at, j] - whole[at]) * counts[at])


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and words of equal length, in parts that keep the tables small."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        step = max(1, 200_000 // (n + 1))
        for k in range(0, len(at), step):
            yield at[k : k + step], [words[i] for i in at[k : k + step].tolist()]


class Scorer(dict):
    """Likelihoods of words, kept for the words seen last: word -> row of ``table``; words without a letter have none (-1)."""

    def __init__(self, pieces: Pieces, probs: np.ndarray, most: int = 600_000) -> None:
        super().__init__()
        self.pieces, self.probs, self.most = pieces, probs, most
        self.rows: dict[str, int] = {}  # of the words' folded forms, which many of them share
        self.table, self.filled = np.zeros((1024, probs.shape[1])), 0

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most and self:
            self.clear()
            self.rows.clear()
            self.filled, new = 0, list(words)
        fresh: list[str] = []
        for w in new:
            text = folded(w).decode()
            row = self.rows.get(text)
            if row is None:
                row = -1
                if text.isalpha() or any(map(str.isalpha, text)):
                    row = self.filled + len(fresh)
                    fresh.append("▁" + text)
                self.rows[text] = row
            self[w] = row
        start, self.filled = self.filled, self.filled + len(fresh)
        if self.filled > len(self.table):
            grown = np.zeros((2 * self.filled, self.table.shape[1]))
            grown[:start] = self.table[:start]
            self.table = grown
        for at, part in by_length(fresh):
            self.table[start + at] = forward(self.pieces.cuts(part), self.probs)

    def of(self, words: list[bytes]) -> np.ndarray | None:
        """The text's log-likelihood in each language; None without a letter."""
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        rows = rows[rows >= 0]
        return self.table[rows].sum(axis=0) if len(rows) else None


def scorer(key: str, file: str, probs: np.ndarray) -> Scorer:
    """The worker's scorer for this model."""
    return held(("languages", key), lambda: Scorer(pieces_of(file), probs))


def stretches(word: str, longest: int) -> list[str]:
    """The word behind its mark; a word over ``longest`` characters in consecutive stretches of about equal length, the first behind the mark."""
    n = len(word)
    parts = max(1, -(-n // longest))
    first, *others = (word[i * n // parts : (i + 1) * n // parts] for i in range(parts))
    return ["▁" + first, *others]


def word_counts(labelled: DataFrame, longest: int) -> DataFrame:
    """(lang, word, count) from (lang, text): words with a letter, as the models see them, long ones in stretches."""

    def count(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), batches_of(b.column("text"))):
                for word, n in Counter((text or b"").split()).items():
                    found[lang, word] += n
            rows: Counter = Counter()
            for (lang, word), n in found.items():
                text = folded(word).decode()
                if any(map(str.isalpha, text)):
                    for part in stretches(text, longest):
                        rows[lang, part] += n
            if rows:
                keys = list(rows)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "count": pa.array(list(rows.values()), pa.int64())})

    return labelled.mapInArrow(count, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))


def fit(labelled: DataFrame, file: str, smoothing: float = 0.1, rounds: int = 2, longest: int = 32) -> tuple[list[str], np.ndarray]:
    """Languages in order and [piece, language] probabilities, from (lang, text).

    Tasks add up expected counts of their share of the words; what comes to the driver is a number for each piece and language: the vocabulary times
    the languages of the sample. Words over ``longest`` characters, as in scripts without spaces, are learned from in consecutive stretches of at most that length. A language none
    of whose texts has a letter has no model: an even one would win all texts of rare pieces.
    """
    words = materialise(word_counts(labelled, longest), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, 0))
    vocabulary = pieces_of(file).unknown + 1
    probs = np.full((vocabulary, len(langs)), 1 / vocabulary)
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((langs, probs))

        def add(batches, sent=sent) -> Iterator:
            import pyarrow as pa

            langs, probs = sent.value
            pieces, out = pieces_of(file), np.zeros_like(probs)
            place = {x: i for i, x in enumerate(langs)}
            for b in batches:
                counts: dict[str, np.ndarray] = {}
                for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "count"))):
                    counts.setdefault(word, np.zeros(len(langs)))[place[lang]] += n
                names = list(counts)
                table = np.array(list(counts.values())).reshape(len(names), len(langs))
                for at, part in by_length(names):
                    expected(pieces.cuts(part), probs, table[at], out)
            piece, lang = np.nonzero(out)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int64()), "lang": pa.array(lang, pa.int64()), "mass": pa.array(out[piece, lang])})

        found = words.mapInArrow(add, "piece long, lang long, mass double").groupBy("piece", "lang").agg(F.sum("mass").alias("mass")).toPandas()
        mass = np.full((vocabulary, len(langs)), smoothing)
        mass[found.piece, found.lang] += found.mass
        probs = mass / mass.sum(axis=0)
    return langs, probs


def sampled(docs: DataFrame, wanted: int, id_column: str, lang_column: str = "lang") -> DataFrame:
    """About ``wanted`` rows of each language of ``docs`` (all, if it has fewer), chosen by a hash of their id: other languages do not change what is drawn of one."""
    # the hash's upper 62 bits as a number below 2**62, so that no share is too small to name
    scale = 1 << 62
    large = [(r[lang_column], wanted * scale // r["count"]) for r in docs.groupBy(lang_column).count().filter(F.col("count") > wanted).collect()]
    share = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(id_column)), 2)
    most = F.lit(scale)
    for lang, bound in large:
        most = F.when(F.col(lang_column).eqNullSafe(F.lit(lang)), F.lit(bound)).otherwise(most)
    return docs.filter(share < most) if large else docs


def identify(docs: DataFrame, langs: list[str], probs: np.ndarray, file: str, id_column: str = "doc_id", text_column: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Per text: doc_id, the ``extra`` columns, lang_pred and score, the posterior of lang_pred among the languages, all of them as likely beforehand.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when no language was learned. Of equal languages the first in order is taken. Repeated rows are judged
    alike; columns not named are ignored.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), *[c.alias(n) for n, c in (extra or {}).items()], F.col(text_column).alias("_text"))
    spark = docs.sparkSession
    key = f"{spark.sparkContext.applicationId}-{id(probs)}-{hash(probs.tobytes())}"
    sent = spark.sparkContext.broadcast((key, langs, probs))
    keep, columns = len(own.columns) - 1, own.columns[:-1]

    def predict(batches) -> Iterator:
        import pyarrow as pa

        key, langs, probs = sent.value
        model = scorer(key, file, probs) if langs else None
        for b in batches:
            texts = [(t or b"").split() for t in batches_of(b.column("_text"))]
            names, scores = [], []
            if model is not None:
                model.learn({w for t in texts for w in t})
            for words in texts:
                got = model.of(words) if model is not None else None
                best = int(got.argmax()) if got is not None else -1
                names.append(langs[best] if best >= 0 else "und")
                scores.append(float(1 / np.exp(got - got[best]).sum()) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return own.mapInArrow(predict, StructType([*own.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
