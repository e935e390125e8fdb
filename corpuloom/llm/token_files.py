"""Token ids in fixed-width bit-packed files.

Format: a folder of Parquet files written by Spark's commit protocol (so a
lost or repeated task leaves no half-written file), one row per block of
consecutive documents of a shard:

    shard int, block int       place of the block; shards and blocks ascend with the document id
    start long                 ids of the shard before this block
    doc_ids array<long>        documents of the block, in order
    ends array<long>           end of each document within the block, in ids
    bits int                   width of an id: the fewest bits that hold the vocabulary
    packed binary              the ids, little-endian bit order, padded to a byte

The blocks' ends give the ids of all shards before each. An id at any offset is
found by its block's start without unpacking others, and a block unpacks by
vectorised numpy.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import documents, table_path

#: Ids after which a block is closed (a longer document has a block of its own).
BLOCK_IDS = 1 << 17
#: Words whose ids a worker remembers, twice over; those not met for as long are forgotten.
MEMO_WORDS = 400_000
_MARKS = string.punctuation
_BLOCK = "shard int, block int, start long, doc_ids array<long>, ends array<long>, bits int, packed binary"


def width(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids of ``bits`` bits each, least significant bit first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from the ``first``; reads only the bytes that hold them."""
    if count is None:
        count = len(packed) * 8 // bits - first
    if bits == 16:
        return np.frombuffer(packed, "<u2", count, first * 2).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(packed, "<u4", count, first * 4).copy()
    low, high = first * bits, (first + count) * bits
    raw = np.frombuffer(packed, np.uint8)[low // 8 : (high + 7) // 8]
    planes = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + count * bits].reshape(count, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # words are lower-cased when they come here; texts were cut at added tokens before
    return tokenizer


def _byte_names() -> dict[int, int]:
    """Characters that byte-level merges write bytes as: printable Latin-1 as itself, the others from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


_BYTE_NAMES = _byte_names()


def _plain(word: str) -> bool:
    """Whether a word is lower-case letters that normalisation leaves as they are: one piece to the merges."""
    if not word.isalpha():
        return False
    return word.isascii() or (max(word) < "\u0530" and word.lower() == word and unicodedata.is_normalized("NFC", word))


class _Words(dict):
    """Ids of words as 32-bit little-endian bytes, made when first asked for."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.model, self.most, self.older = tokenizer, tokenizer.model, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            base = word.rstrip(_MARKS)
            if len(base) < len(word) and base and base[-1].isalnum() and base[-1] != "\u0130":  # that letter's lower case ends in a mark of its own
                ids = self[base] + self[word[len(base) :]]
            elif _plain(word):
                ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_NAMES))]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.most:  # words that are not met again before the next time are forgotten
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process, which later tasks of it take up with what it remembers."""
    return WordEncoder(path)


class WordEncoder:
    """Encodes texts by the tokenizers library, word by word, remembering words.

    The tokenizer lower-cases, drops white space, splits letters from marks
    and merges nothing across these places, so a text may be cut at spaces,
    line ends and before the marks at a word's end, and A-Z lower-cased: its
    ids are those of the pieces in order. All else is left to the library.
    The strings of added tokens, such as ``<|endoftext|>``, are those tokens,
    as the library has it, and the text is cut at them first.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        tokenizer = _tokenizer(path)
        self.known = _Words(tokenizer, memo)
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _plain(self, text: str) -> Iterator[bytes]:
        plain = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return map(self.known.__getitem__, plain.replace("\n", " ").split(" "))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        found = [part for i, piece in enumerate(self.cut.split(text)) for part in ([self.added[piece]] if i % 2 else self._plain(piece))]
        return np.frombuffer(b"".join(found), "<u4")


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode each text, end it with ``end_id`` and write all in ascending id order to ``path``.

    Null and empty texts hold just the end id. Rows with a null id come first;
    rows that share an id stand side by side, ordered by their text. An empty
    table gives no blocks. Documents are dealt by ranges of their ids, so the
    order needs no single task.
    """
    bits = width(max(_tokenizer(tokenizer_file).get_vocab_size(with_added_tokens=True), end_id + 1))
    schema = to_arrow_schema(StructType.fromDDL(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, start, shard = word_encoder(tokenizer_file), 0, 0, None
        held, doc_ids, total = [], [], 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            row = [shard, block, start, doc_ids, ends.tolist(), bits, pack(np.concatenate(held), bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                shard = batch.column(0)[k].as_py()
                ids = np.append(encode(batch.column(2)[k].as_py()), np.uint32(end_id))
                if held and total + len(ids) > block_ids:
                    yield closed()
                    block, start, held, doc_ids, total = block + 1, start + total, [], [], 0
                held.append(ids)
                doc_ids.append(batch.column(1)[k].as_py())
                total += len(ids)
        if held:
            yield closed()

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    placed = ordered.select(F.spark_partition_id().alias("shard"), "id", "text")
    placed.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(path)


def shards(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids of all shards before each, from the blocks' ends alone.

    One entry per shard, and a folder has at most as many shards as the
    shuffle partitions it was written with, however large it is.
    """
    ends = spark.read.schema(StructType.fromDDL(_BLOCK)).parquet(path)
    sizes = sorted(ends.groupBy("shard").agg(F.sum(F.element_at("ends", -1)).alias("n")).collect())
    return {shard: before for (shard, _), before in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)}


def _unpacked(batch: pa.RecordBatch, base: dict[int, int]) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray]]:
    """(doc_ids, starts, ends within the block, ids) of every block of a batch."""
    for row in batch.to_pylist():
        ends = np.array(row["ends"])
        begins = np.concatenate([[0], ends[:-1]])
        yield row["doc_ids"], (begins + base[row["shard"]] + row["start"]).tolist(), ends, unpack(row["packed"], row["bits"], 0, int(ends[-1]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document of a folder; start counts the ids of all documents before it."""
    blocks, base = spark.read.schema(StructType.fromDDL(_BLOCK)).parquet(path), shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, starts, ends, ids in _unpacked(batch, base):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), lists], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def ids_at(spark: SparkSession, path: str, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` of a whole folder: only the blocks that hold them are read, and of these only their bytes unpacked."""
    base = shards(spark, path)
    if not base or count <= 0:
        return np.empty(0, np.uint32)
    blocks = spark.read.schema(StructType.fromDDL(_BLOCK)).parquet(path)
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in base.items() for x in pair]), F.col("shard")) + F.col("start")
    held = blocks.select("shard", "bits", "packed", begin.alias("begin"), F.element_at("ends", -1).alias("n"))
    held = held.where((F.col("begin") < first + count) & (F.col("begin") + F.col("n") > first))
    parts = []
    for row in sorted(held.collect(), key=lambda r: r["begin"]):
        low, high = max(first, row["begin"]), min(first + count, row["begin"] + row["n"])
        parts.append(unpack(row["packed"], row["bits"], low - row["begin"], high - low))
    return np.concatenate([np.empty(0, np.uint32), *parts])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a folder, unpacked and summed in one pass."""
    blocks, base = spark.read.schema(StructType.fromDDL(_BLOCK)).parquet(path), shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, starts, ends, ids in _unpacked(batch, base):
                raw, sizes = memoryview(ids.astype("<u4").tobytes()), np.diff(ends, prepend=0)
                crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, path)
