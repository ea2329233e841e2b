"""Token ids on disk in the fewest bits the vocabulary needs, in blocks that numpy unpacks as a whole.

A file is a Parquet table, so every store that Spark writes to will do. A row is one block of whole documents:

=========  ==========================================================================
shard      position of the shard; all ids of shard s come before those of shard s + 1
block      position of the block within its shard
first      ids of the shard before the block
width      bits per id
least      the smallest of the block's document ids
greatest   the greatest of them
doc_ids    the block's documents in order
ends       for each of them, ids of the block up to and with its last one
payload    the ids, ``width`` bits each, highest bit first, the last byte filled with zeros
=========  ==========================================================================

Id i of a block starts at bit ``i * width``, so a document, or any run of ids, is read without unpacking the rest;
Parquet's statistics on shard, block, first, least and greatest lead to the block.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import batches_of, held

FILE_SCHEMA = "shard int, block int, first long, width int, least long, greatest long, doc_ids array<long>, ends array<long>, payload binary"
#: Ids after which a block is closed at the end of a document.
BLOCK_IDS = 1 << 17


def width_of(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits per id."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width % 8 == 0:  # whole bytes
        return ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width // 8 :].tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (not with it) of a block; only their bytes are touched."""
    low, high = start * width // 8, -(-stop * width // 8)
    if width % 8 == 0:
        wide = np.zeros((stop - start, 4), np.uint8)
        wide[:, 4 - width // 8 :] = np.frombuffer(payload, np.uint8)[low:high].reshape(-1, width // 8)
        return wide.view(">u4").ravel().astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)[low:high])[start * width - 8 * low :][: (stop - start) * width]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, 32 - width :] = bits.reshape(-1, width)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Encoder(dict):
    """Ids of whitespace-separated words as bytes (little-endian, 32 bits), kept for the words seen last.

    For tokenizers that drop white space and never join across it, a text's ids are those of its words in order.
    ``direct`` words (Latin letters, digits and ASCII signs but the apostrophe) go to the model piece by piece, as the
    tokenizer itself would split them; all others, and those with a special token's opening, pass through the whole tokenizer.
    """

    SIMPLE = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+)+")
    PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, file: str, direct: bool, most: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.direct, self.most = Tokenizer.from_file(file), direct, most
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        if not self.direct or b"<|" in word:
            value = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        elif word.isalpha():
            value = self.piece(text.lower())
        elif self.SIMPLE.fullmatch(text):
            value = b"".join(map(self.piece, self.PIECES.findall(text.lower())))
        else:
            value = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = value
        return value

    def piece(self, piece: str) -> bytes:
        value = self.pieces.get(piece)
        if value is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            coded = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            value = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
        return value

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


def encoder(file: str, direct: bool) -> Encoder:
    """The worker's encoder for this file."""
    return held(("ids", file, direct), lambda: Encoder(file, direct))


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, vocabulary: int, end_id: int, id_column: str = "doc_id", text_column: str = "text", direct: bool = False,
    order: Sequence[str | Column] | None = None,
) -> None:
    """Encode every whole text and write the ids to ``path`` in the format above, in ascending order of the id column, or in the order given.

    ``tokenizer_file`` is a ``tokenizers`` file whose tokens never span white space and which yields none for it;
    ``direct`` says that it is a byte-level BPE over lower-cased runs of letters, single digits and runs of signs.
    ``vocabulary`` bounds all ids, ``end_id`` closes each document. Null texts count as empty; documents of equal id
    follow one another in the order of their texts, and null ids come first. Other columns are ignored; an empty table gives no blocks. Texts are dealt by ranges of the order, so a
    shard is one range, and are encoded after that: ids would take more room in the shuffle than the texts do.
    """
    width = width_of(max(vocabulary, end_id + 1))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches) -> Iterator:
        import pyarrow as pa

        own = encoder(tokenizer_file, direct)
        shard, block, first, doc_ids, parts, sizes, held = 0, 0, 0, [], [], [], 0

        def flush():
            ids, known = np.frombuffer(b"".join(parts), "<u4"), [i for i in doc_ids if i is not None]
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()), "width": pa.array([width], pa.int32()),
                "least": pa.array([min(known, default=None)], pa.int64()), "greatest": pa.array([max(known, default=None)], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "ends": pa.array([np.cumsum(sizes).tolist()], pa.list_(pa.int64())), "payload": pa.array([pack(ids, width)], pa.binary()),
            })

        for b in batches:
            for pid, doc_id, text in zip(b.column("shard").to_pylist(), b.column("id").to_pylist(), batches_of(b.column("text"))):
                shard = pid
                ids = own.of(text) + end
                doc_ids.append(doc_id)
                parts.append(ids)
                sizes.append(len(ids) // 4)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield flush()
                    block, first, doc_ids, parts, sizes, held = block + 1, first + held, [], [], [], 0
        if doc_ids:
            yield flush()

    keys = {f"order{k}": F.col(o) if isinstance(o, str) else o for k, o in enumerate(order or [id_column])}
    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *[c.alias(n) for n, c in keys.items()])
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys, "id", "text").select("id", "text", F.spark_partition_id().alias("shard"))
    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_digests(blocks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def digests(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                ends = np.array(row["ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                data = unpack(row["payload"], row["width"], 0, int(ends[-1])).astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row["shard"]] * len(ends), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts + row["first"], pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist())], pa.int64()),
                })

    # one row per shard: as many as the writer had tasks
    sizes = blocks.groupBy("shard").agg(F.max(F.col("first") + F.element_at("ends", -1)).alias("ids"))
    before = sizes.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = blocks.mapInArrow(digests, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return local.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray:
    """Ids of one document (the first of that id): the statistics on least and greatest id leave few blocks to look at, one if the files are ordered by id, and only its bits are unpacked."""
    row = read_token_files(spark, path).filter((F.col("least") <= doc_id) & (F.col("greatest") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id))).orderBy("shard", "block").first()
    if row is None:
        raise KeyError(doc_id)
    at = row.doc_ids.index(doc_id)
    return unpack(bytes(row.payload), row.width, row.ends[at - 1] if at else 0, row.ends[at])
