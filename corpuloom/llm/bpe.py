"""Byte-level BPE encoding and decoding with a local rank file.

Each match of the split pattern is encoded on its own by the merge ranks of
the tiktoken library, without special tokens. Long texts are cut before a
space that stands between two non-space characters: no match of the pattern
spans such a place, so the pieces encode as the whole would. Long runs of
white space are cut out too, as the regex engine's stack ends with them: the
pattern takes all of a run but its last character as one match, or the whole
run where the text ends with it. Decoding concatenates raw bytes, so ids that
end within a character survive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: Characters from which a text is cut at safe boundaries.
PIECE = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Characters of a run of white space from which it is a piece of its own; white space as the pattern's engine has it.
RUN = 1 << 14
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; one per worker process."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Pieces of about ``piece`` characters whose encodings concatenate to that of the text.

    Where no safe place follows, the rest stays whole.
    """
    at = 0
    while len(text) - at > piece:
        cut = _SAFE.search(text, at + piece)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str | None, piece: int = PIECE) -> list[int]:
    if not text:
        return []
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        for part in safe_pieces(text[at : run.start()], piece):
            ids += enc.encode_ordinary(part)
        at = run.end() - (run.end() < len(text))
        ids += enc._encode_single_piece(text[run.start() : at])
    for part in safe_pieces(text[at:], piece):
        ids += enc.encode_ordinary(part)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of each row's whole text.

    Null and empty texts have no ids; repeated rows and null ids yield one row
    each; columns besides the two named are not carried, so none can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode_text(enc, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, bytes binary): the raw bytes of each row's ids. Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [enc.decode_bytes(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["id", "ids", "bytes"])

    kept = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids array<int>, bytes binary").withColumnRenamed("id", id_col)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """(id_col, ids, n_tokens, exact): each row's ids and whether they decode to its very bytes; a named position is carried as position."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [encode_text(enc, t) for t in texts]
                exact = [enc.decode_bytes(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(exact), *part.columns[2:]], ["id", "ids", "n_tokens", "exact", *place])

    place = [] if position_col is None else ["position"]
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *([] if position_col is None else [docs[position_col].cast("long").alias("position")]))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, exact boolean" + "".join(f", {c} long" for c in place)).withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, decoded and summed in one pass of one worker."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            sizes, ids_sums, raw_sums = [], [], []
            for text in batch.column(1):
                ids = encode_text(enc, text.as_py())
                sizes.append(len(ids))
                ids_sums.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                raw_sums.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(raw_sums, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
