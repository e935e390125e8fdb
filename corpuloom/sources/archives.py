"""Members of containers read as streams: a container is opened where its task runs and never held whole.

What a container is, its own first bytes say: a zip, a tar, or a compressed
stream, which is a tar's if its first decompressed bytes are a tar's header. A
zip's directory is read entry by entry from its end, a plain tar by its headers
alone, seeking over what lies between, a compressed one by decompressing it in
pieces. Listings are bounded, so a container costs its task one piece of memory
and, at most, ``most`` rows.
"""

from __future__ import annotations

import bz2
import lzma
import os
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .tree import contained

#: Bytes that are read at a time, and that are read to tell what a container is.
PIECE, HEAD = 1 << 20, 4096
#: What the engines begin with.
MAGIC = {"zip": (b"PK\x03\x04", b"PK\x05\x06"), "gzip": (b"\x1f\x8b",), "bzip2": (b"BZh",), "xz": (b"\xfd7zXZ\x00",), "zstd": (b"\x28\xb5\x2f\xfd",)}
_TAR_AT, _TAR = 257, b"ustar"


class Damaged(ValueError):
    """A container that ends or breaks where it should not."""


class _Decoder:
    """Decompresses pieces as they come; streams that follow each other in one file are one. ``open`` while a stream has begun and not ended."""

    MAKE = {"gzip": lambda: zlib.decompressobj(16 + zlib.MAX_WBITS), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}

    def __init__(self, engine: str) -> None:
        self.make, self.open = self.MAKE[engine], False

    def __call__(self, piece: bytes) -> bytes:
        out = []
        while piece:
            if not self.open:
                piece = piece.lstrip(b"\0")  # what pads a stream
                if not piece:
                    break
                self.stream, self.open = self.make(), True
            out.append(self.stream.decompress(piece))
            self.open = not self.stream.eof
            piece = b"" if self.open else self.stream.unused_data
        return b"".join(out)


class Decompressed:
    """A compressed file as a stream to read from, a piece at a time. Raises where it ends within a stream."""

    def __init__(self, handle, engine: str, piece: int = PIECE) -> None:
        self.handle, self.piece, self.held, self.at = handle, piece, b"", 0
        # compressed pieces are small, as what they hold may be a thousand times as large
        self.decode, self.step = _Decoder(engine), max(1, piece >> 6)

    def read(self, n: int) -> bytes:
        out, need = [], n
        while need:
            if not self.held:
                raw = self.handle.read(self.step)
                if not raw:
                    if self.decode.open:
                        raise EOFError("the file ends within a compressed stream")
                    break
                self.held = self.decode(raw)
                continue
            out.append(self.held[:need])
            need -= len(out[-1])
            self.held = self.held[len(out[-1]) :]
        self.at += n - need
        return b"".join(out)


def engine_of(head: bytes) -> tuple[str | None, bool]:
    """(engine, whether a tar is inside) by a container's first bytes; (None, False) if they tell of none."""
    for name, marks in MAGIC.items():
        if head.startswith(marks):
            if name == "zip":
                return name, False
            try:
                inner = _Decoder(name)(head)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
                inner = b""
            return name, inner[_TAR_AT : _TAR_AT + len(_TAR)] == _TAR
    return ("tar", True) if head[_TAR_AT : _TAR_AT + len(_TAR)] == _TAR else (None, False)


def _directory(handle) -> tuple[int, int]:
    """(begin, size) of a zip's directory, by the record at its end; large ones have a second record before that."""
    size = handle.seek(0, os.SEEK_END)
    tail_at = max(0, size - (1 << 16) - 22)
    handle.seek(tail_at)
    tail = handle.read()
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise Damaged("no directory")
    length, offset = struct.unpack_from("<II", tail, at + 12)
    end = tail_at + at
    if end >= 76:
        handle.seek(end - 20)
        mark, _, where, _ = struct.unpack("<IIQI", handle.read(20))
        if mark == 0x07064B50:
            handle.seek(where)
            record = handle.read(56)
            if record[:4] == b"PK\x06\x06":
                length, offset = struct.unpack_from("<QQ", record, 40)
                end = where
    return max(0, end - length), length  # what stands before the zip shifts its offsets


def _zip_members(handle) -> Iterator[tuple[str, int, str]]:
    begin, left = _directory(handle)
    handle.seek(begin)
    held = b""

    def need(n: int) -> None:
        nonlocal held, left
        while len(held) < n:
            piece = handle.read(min(left, PIECE))
            if not piece:
                raise Damaged("the directory ends within an entry")
            left -= len(piece)
            held += piece

    while held or left:
        need(46)
        if held[:4] != b"PK\x01\x02":
            raise Damaged("no entry where one should be")
        flags, size = struct.unpack_from("<H", held, 8)[0], struct.unpack_from("<I", held, 24)[0]
        n_name, n_extra, n_note = struct.unpack_from("<HHH", held, 28)
        need(46 + n_name + n_extra + n_note)
        name, extra = held[46 : 46 + n_name], held[46 + n_name : 46 + n_name + n_extra]
        held = held[46 + n_name + n_extra + n_note :]
        if size == 0xFFFFFFFF:
            at = 0
            while at + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, at)
                if kind == 1 and length >= 8:
                    size = struct.unpack_from("<Q", extra, at + 4)[0]
                at += 4 + length
        shown = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        yield shown, size, "dir" if shown.endswith("/") else "file"


def _tar_members(stream, mode: str) -> Iterator[tuple[str, int, str]]:
    with tarfile.open(fileobj=stream, mode=mode, bufsize=PIECE) as t:
        for m in t:
            yield m.name, m.size, "dir" if m.isdir() else "file"
            t.members.clear()  # or every member stays


def members(path: bytes, most: int = fixed.MEMBER_LIMIT) -> Iterator[tuple[str, int, str]]:
    """(member, size, kind) of a container by its content, ``most`` at most; none of a file that is no container. Raises where it is damaged."""
    with open(path, "rb") as handle:
        head = handle.read(HEAD)
        handle.seek(0)
        engine, tar = engine_of(head)
        if engine is None:
            return
        if engine == "zip":
            found = _zip_members(handle)
        elif engine == "tar":
            found = _tar_members(handle, "r:")
        elif tar:
            found = _tar_members(Decompressed(handle, engine), "r|")
        else:
            stream, size = Decompressed(handle, engine), 0
            while piece := stream.read(PIECE):
                size += len(piece)
            stem = os.path.basename(path).decode("utf-8", "replace")
            found = iter([(stem.rsplit(".", 1)[0] or stem, size, "file")])
        for i, m in enumerate(found):
            if i >= most:
                return
            yield m


def listed(entries: DataFrame, root: str, most: int = fixed.MEMBER_LIMIT) -> DataFrame:
    """(container, member, size, kind, note) of the files among ``entries`` (raw, kind), as the ``filetree`` source has them, below a folder that all executors see.

    Files that are no containers give no row. A damaged or unreadable one gives
    what was read of it and a row with a note and nulls; an empty one no row.
    Containers are dealt out by their paths; each is one task's work, one piece
    of it in memory at a time.
    """
    top = os.fsencode(root.removeprefix("file://"))
    names = ["container", "member", "size", "kind", "note"]
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held: list[tuple] = []

                def rows(held: list[tuple] = held) -> pa.RecordBatch:
                    made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)
                    held.clear()
                    return made

                try:
                    for m in members(contained(top, raw), most):
                        held.append((raw, *m, None))
                        if len(held) >= 4096:
                            yield rows()
                except (OSError, EOFError, ValueError, tarfile.TarError, zlib.error, lzma.LZMAError, zstandard.ZstdError, struct.error) as error:
                    held.append((raw, None, None, None, f"damaged: {type(error).__name__}"))
                if held:
                    yield rows()

    files = entries.where("kind = 'file'").select("raw").repartition("raw")
    return files.mapInArrow(run, "container binary, member string, size long, kind string, note string")
