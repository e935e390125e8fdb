"""Functions over bytes: what they are, how they are coded, and their digests."""

from __future__ import annotations

import codecs
import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# --- Fixed values. Beginnings of files that decide before any decoding.
STRONG = (
    (b"PK\x03\x04", "archive"), (b"PK\x05\x06", "archive"), (b"PK\x07\x08", "archive"), (b"7z\xbc\xaf\x27\x1c", "archive"), (b"Rar!\x1a\x07", "archive"),
    (b"\x1f\x8b\x08", "archive"), (b"BZh9", "archive"), (b"BZh8", "archive"), (b"\xfd7zXZ\x00", "archive"), (b"\x28\xb5\x2f\xfd", "archive"), (b"\x04\x22\x4d\x18", "archive"),
    (b"\x89PNG\r\n\x1a\n", "media"), (b"GIF87a", "media"), (b"GIF89a", "media"), (b"RIFF", "media"), (b"OggS", "media"), (b"fLaC", "media"), (b"\x1aE\xdf\xa3", "media"),
    (b"\x00\x00\x01\xba", "media"), (b"\x00\x00\x01\xb3", "media"), (b"FLV\x01", "media"), (b"ID3", "media"),
    (b"SQLite format 3\x00", "database"), (b"\x00\x01\x00\x00Standard Jet DB", "database"), (b"\x00\x01\x00\x00Standard ACE DB", "database"),
    (b"%PDF-", "document"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "document"), (b"-----BEGIN PGP", "text"), (b"-----BEGIN CERTIFICATE", "text"),
)
# --- Fixed values. Short beginnings, asked only of what is not UTF-8 text.
WEAK = ((b"\xff\xd8\xff", "media"), (b"BM", "media"), (b"II*\x00", "media"), (b"MM\x00*", "media"), (b"{\\rtf", "document"), (b"MZ", "binary"), (b"\x7fELF", "binary"))
ALLOWED_CONTROL = b"\t\n\r\f\b\x1b"
CONTROL_ALLOWANCE, CONTROL_SHARE, PRINTABLE_SHARE = 4, 0.01, 0.95
SNIFF_BYTES, HASH_BYTES = 8192, 65_536
_CONTROL = bytes(b for b in range(0x20) if b not in ALLOWED_CONTROL)
_UNPRINTABLE = bytes(b for b in range(256) if not (0x20 <= b <= 0x7E or b >= 0xA0 or b in ALLOWED_CONTROL))


def _magic(data: bytes, table: tuple) -> str | None:
    return next((kind for start, kind in table if data.startswith(start)), None)


def _decodes(data: bytes, encoding: str, cut: bool = False) -> bool:
    try:
        codecs.getincrementaldecoder(encoding)().decode(data, not cut)
    except UnicodeDecodeError:
        return False
    return True


def kind_of(data: bytes | None, cut: bool = False) -> tuple[str, str | None]:
    """(kind, encoding) of the first bytes of a file: marks, then UTF-8, then short marks, then single-byte text. With ``cut``, more bytes follow, so that the last character may be a part of one."""
    if data is None:
        return "unreadable", None
    if not data:
        return "empty", None
    if strong := _magic(data, STRONG):
        return strong, None
    without = len(data) - len(data.translate(None, _CONTROL))
    may_be_text = b"\x00" not in data and (without <= CONTROL_ALLOWANCE or without / len(data) < CONTROL_SHARE)
    if may_be_text and _decodes(data, "utf-8", cut):
        return "text", "utf-8"
    if weak := _magic(data, WEAK):
        return weak, None
    if may_be_text and len(data.translate(None, _UNPRINTABLE)) / len(data) > PRINTABLE_SHARE:
        return "text", "cp1252" if _decodes(data, "cp1252") else "latin-1"
    return "binary", None


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("encoding", StringType())]))
def _sniff(data: pd.Series, cut: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kind_of(None if d is None else bytes(d), bool(c)) for d, c in zip(data, cut, strict=True)], columns=["kind", "encoding"])


def sniff(content: Column, size: int = SNIFF_BYTES) -> Column:
    """Struct of kind and encoding by the first ``size`` bytes."""
    return _sniff(F.substring(content, 1, size), F.coalesce(F.octet_length(content) > size, F.lit(False)))


def head_hash(content: Column, size: Column | None = None, head: int = HASH_BYTES) -> Column:
    """SHA-256 of the first bytes, a zero byte and the size in decimal: the identity of copies."""
    size = F.octet_length(content) if size is None else size
    return F.sha2(F.concat(F.substring(content, 1, head), F.lit(b"\x00"), size.cast("string").cast("binary")), 256)


@F.pandas_udf(StringType())
def decode(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """Text of bytes in their declared encoding, errors replaced; an unknown encoding counts as UTF-8."""

    def one(d: bytes | None, e: str | None) -> str | None:
        if d is None:
            return None
        try:
            name = codecs.lookup(e or "utf-8").name
        except LookupError:
            name = "utf-8"
        return bytes(d).decode(name, "replace")

    return pd.Series([one(d, e) for d, e in zip(data, encoding, strict=True)], dtype=object)


def derivation_key(source_hash: Column, version: Column, params: Column) -> Column:
    zero = F.lit(b"\x00")
    return F.sha2(F.concat(source_hash.cast("binary"), zero, version.cast("binary"), zero, params.cast("binary")), 256)


def page_hash(kind: Column, name: Column, title: Column, summary: Column, tags: Column, body: Column) -> Column:
    head = F.concat_ws(":", kind, name, title, summary, F.array_sort(tags))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(head, F.lit("\n"), body).cast("binary"), 256))


_LIMBS = StructType([StructField(f"l{i}", LongType()) for i in range(8)])


def _entry_digest(raw: bytes, kind: str, size: int, mtime: float) -> bytes:
    packed = struct.pack(">Qd", int(size or 0), 0.0 if kind == "dir" else float(mtime or 0.0))
    return hashlib.sha256(bytes(raw) + b"\x00" + kind.encode() + b"\x00" + packed).digest()


@F.pandas_udf(_LIMBS)
def entry_limbs(raw: pd.Series, kind: pd.Series, size: pd.Series, mtime: pd.Series) -> pd.DataFrame:
    """Eight 32-bit limbs of an entry's SHA-256, the first the highest; a folder's time does not count."""
    rows = [struct.unpack(">8I", _entry_digest(*x)) for x in zip(raw, kind, size, mtime, strict=True)]
    return pd.DataFrame(rows, columns=[f"l{i}" for i in range(8)])


def hash_limbs(hexadecimal: Column) -> Column:
    """Array of the eight 32-bit limbs of a SHA-256 in hex."""
    return F.array(*[F.conv(F.substring(hexadecimal, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)])
