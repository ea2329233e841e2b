"""Secrets in texts: known forms, and strings in a sensitive context that do not compress.

1. Known forms: an assignment to a name like ``password``, an access key, a long run of hex digits.
2. How new a string is to its surroundings: the identifiers that most texts of the corpus use are counted by Spark and make a zstandard dictionary, which every task primes its compressor with. A
   candidate - a long run of letters, digits and joining signs soon after a sensitive word - is compressed behind the text around it; the bytes that it adds are its novelty. What adds nearly as many
   bytes as its alphabet could carry was not made of known words and not copied from near by: it is reported.

Texts are judged whole, each on its own. The dictionary follows counts over all texts and has a fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import batches_of
from evidencelake.session import materialise

# The known forms. Alternatives are tried in this order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

#: Words after which a secret may stand, in lower case, and how far after them it may begin.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "credential", "authorization", "bearer", "signature")
REACH = 48
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{16,})*={0,2}")
_SENSITIVE_BYTES = [w.encode() for w in SENSITIVE]
_HEX_BYTES = re.compile(rb"[0-9a-f]{32}")
_IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9_+/=\x80-\xff-])[A-Za-z_\x80-\xff]{3,24}(?![A-Za-z0-9_+/=\x80-\xff])")
#: Characters around a candidate that it is compared with, bytes of the dictionary, and the level of compression.
AROUND, DICTIONARY_BYTES, LEVEL = 512, 64 << 10, 9
#: A candidate is new when the bytes it adds reach this share of what its alphabet could carry.
NOVELTY = 0.9
_HELD_WORDS = 200_000


def identifier_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """word, texts: how many texts hold each word of 3 to 24 letters and underscores, outside runs that may be secrets themselves (a secret that many copies share must not become a known word)."""

    def count(batches) -> Iterator:
        import pyarrow as pa

        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "ignore") for w in held], pa.string()), "texts": pa.array(list(held.values()), pa.int64())})
        for b in batches:
            for text in batches_of(b.column("text")):
                held.update(set(_IDENTIFIER.findall(without_candidates(text or b""))))
                if len(held) > _HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    return docs.select(F.col(text_column).alias("text")).mapInArrow(count, "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES, text_column: str = "text") -> bytes:
    """The identifiers that most texts hold (at least two), up to ``size`` bytes, the commonest last, where a match costs least."""
    # written first: the tasks' best words are merged by a task, not by the driver
    common = materialise(identifier_counts(docs, text_column).filter("texts > 1").orderBy(F.desc("texts"), "word").limit(size // 4), "identifiers").orderBy(F.desc("texts"), "word")
    words, held = [], 0
    for row in common.collect():
        word = row.word.encode()
        if held + len(word) + 1 > size:
            break
        words.append(word)
        held += len(word) + 1
    return b" ".join(reversed(words))


def known_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) of the known forms, in code points; leftmost and without overlap within a kind."""
    found = [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that begin within ``REACH`` characters after a sensitive word, leftmost, without overlap."""
    found, free = [], 0
    for word in _SENSITIVE.finditer(text):
        at = max(word.end(), free)
        while (run := _CANDIDATE.search(text, at, min(len(text), at + REACH + 4096))) and run.start() <= word.end() + REACH:
            end = run.end()
            if end == at + REACH + 4096:
                end = _CANDIDATE.match(text, run.start()).end()
            found.append((run.start(), end))
            at = free = end
    return found


def capacity(run: str) -> float:
    """Bytes that a run of this length can carry in the alphabet it is written in; 0 for runs of one class of characters, which are words or numbers."""
    signs = set(run.rstrip("="))
    digits, lower, upper = any(c.isdigit() for c in signs), any(c.islower() for c in signs), any(c.isupper() for c in signs)
    if digits + lower + upper < 2:
        return 0.0
    hexadecimal = signs <= set("0123456789abcdef") or signs <= set("0123456789ABCDEF")
    letters = 16 if hexadecimal else 10 * digits + 26 * lower + 26 * upper + len(signs & set("+/_-."))
    return len(run) * math.log2(letters) / 8


def is_sensitive(folded: bytes) -> bool:
    return any(w in folded for w in _SENSITIVE_BYTES)


def without_candidates(text: bytes) -> bytes:
    if not is_sensitive(text.lower()):
        return text
    whole, parts, done = text.decode("utf-8", "replace"), [], 0
    for start, end in candidates(whole):
        if capacity(whole[start:end]):
            parts.append(whole[done:start])
            done = end
    return " ".join([*parts, whole[done:]]).encode()


class Novelty:
    """A compressor primed with the dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        if known:
            known.precompute_compress(level=LEVEL)
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def added(self, text: str, start: int, end: int) -> int:
        """Bytes that the run adds to the text around it, from which copies of the run are taken out."""
        run = text[start:end]
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).replace(run, " ").encode()
        return len(self.squeeze(around + run.encode())) - len(self.squeeze(around))


def secrets_of(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, str, int, int, float | None]]:
    """(start, kind, end, start of the value, share of its capacity that it adds), by start, then kind; runs inside a known form are not judged again."""
    found = [(*known, None) for known in known_spans(text)]
    held = [(s, e) for s, _, e, _, _ in found]
    for start, end in candidates(text):
        most = capacity(text[start:end])
        if most and not any(s <= start and end <= e for s, e in held):
            share = novelty.added(text, start, end) / most
            if share >= least:
                found.append((start, "novel", end, start, share))
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1])))


def scan_secrets(docs: DataFrame, novelty: float = NOVELTY, dictionary_bytes: int = DICTIONARY_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and secrets: an array of (kind, start, end, value_start, novelty) by start, then kind (assign, access, hex, novel); positions are code points, ends exclusive.

    ``novelty`` is the least share of its capacity that a run must add to be reported as novel; known forms have none. Null, empty and blank texts have no secrets. Texts are judged whole, however long;
    repeated rows and rows of equal or null id are judged one by one. Other columns are ignored. An empty table gives no rows.
    """
    dictionary = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, dictionary_bytes, text_column))
    kind = "array<struct<kind:string,start:long,end:long,value_start:long,novelty:double>>"

    def scan(batches) -> Iterator:
        import pyarrow as pa

        measure = Novelty(dictionary.value)
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("novelty", pa.float64())]))
        for b in batches:
            out = []
            for text in batches_of(b.column("text")):
                folded = (text or b"").lower()
                if is_sensitive(folded) or b"akia" in folded or _HEX_BYTES.search(folded):
                    out.append([{"kind": k, "start": s, "end": e, "value_start": v, "novelty": n} for s, k, e, v, n in secrets_of(text.decode("utf-8", "replace"), measure, novelty)])
                else:
                    out.append([])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, spans)], names=["doc_id", "secrets"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(scan, f"doc_id long, secrets {kind}")


def span_list(secrets: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, mask: str = "[secret]", novelty: float = NOVELTY, dictionary_bytes: int = DICTIONARY_BYTES, text_column: str = "text") -> DataFrame:
    """``docs`` with the values of their secrets replaced by ``mask`` (overlapping ones together by one); all other columns stay, whatever their names. Null texts stay null."""
    dictionary = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, dictionary_bytes, text_column))
    at = docs.columns.index(text_column)

    def clean(batches) -> Iterator:
        import pyarrow as pa

        measure = Novelty(dictionary.value)
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                parts, done = [], 0
                for start, end in sorted((v, e) for _, _, e, v, _ in secrets_of(text or "", measure, novelty)):
                    if start >= done:
                        parts += [text[done:start], mask]
                    done = max(done, end)
                out.append("".join([*parts, text[done:]]) if parts else text)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
