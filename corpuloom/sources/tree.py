"""File trees as a Spark data source.

``spark.read.format("filetree").load(root)`` gives one row per entry below a
folder that all executors see. Names that are not UTF-8 keep their bytes in
``raw``; links are told, not followed; folders that can't be read give no
rows. Each partition walks some of the folders of the first two levels, so a
large tree is walked by many tasks. Options: ``content`` (true: also the first
``maxBytes`` bytes of files), ``partitions``.

Filters on ``path`` (equal, a beginning, a range) and ``parent`` (equal) prune
folders before they are listed, and filters on ``kind`` spare what they leave out
its content; Spark applies all filters to the rows as well. :func:`register`
turns that on for a session.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .. import schemas


def _kind(mode: int) -> str:
    return "symlink" if stat.S_ISLNK(mode) else "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


def contained(root: bytes, relative: bytes) -> bytes:
    """The real path of ``relative`` below ``root``; refuses absolute paths, NUL bytes and what leaves the tree."""
    if relative.startswith(b"/") or b"\x00" in relative or (len(relative) > 1 and relative[1:2] == b":"):
        raise ValueError(f"not a path within the tree: {relative!r}")
    top, full = os.path.realpath(root), os.path.realpath(os.path.join(root, relative))
    if full != top and not full.startswith(top.rstrip(b"/") + b"/"):
        raise ValueError(f"leaves the tree: {relative!r}")
    return full


def assert_outside(corpus: str, derived: str) -> None:
    """Refuses a place for derived data that lies within the corpus it is derived from."""
    a, b = os.path.realpath(corpus), os.path.realpath(derived)
    if b == a or b.startswith(a.rstrip("/") + "/"):
        raise ValueError(f"{derived} lies within {corpus}")


def checked(rows: DataFrame, col: str, root: str) -> DataFrame:
    """The rows with ``real``, the real path of a relative one below ``root``, null where that is refused."""
    top, place = os.fsencode(root.removeprefix("file://")), rows.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column(place).to_pylist():
                try:
                    found.append(None if p is None else contained(top, os.fsencode(p)).decode("utf-8", "replace"))
                except ValueError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "real"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, real string")


def outside(rows: DataFrame, corpus: str, derived: str) -> DataFrame:
    """The rows with ``outside``: whether their place for derived data (column ``derived``) lies outside of their corpus; null where either is."""
    at = [rows.columns.index(c) for c in (corpus, derived)]

    def told(a: str | None, b: str | None) -> bool | None:
        if a is None or b is None:
            return None
        try:
            assert_outside(a, b)
        except ValueError:
            return False
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [told(a, b) for a, b in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, "outside"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, outside boolean")


class Folders(InputPartition):
    """Folders to list; of the deep ones also what lies below."""

    def __init__(self, flat: list[bytes], deep: list[bytes]):
        self.flat, self.deep = flat, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.fsencode(options["path"].removeprefix("file://"))
        self.content = options.get("content", "false").lower() == "true"
        self.most = int(options.get("maxbytes", options.get("maxBytes", 1 << 20)))
        self.parts = int(options.get("partitions", 16))
        self.within: list[tuple[str, str, bool]] = []  # (least, most, whether most is included) of the paths that are asked for
        self.parents: set[str] | None = None
        self.kinds: set[str] | None = None
        self.listed = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what prunes folders; all filters are left to Spark too."""
        for f in filters:
            column, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
            if column == "path" and isinstance(value, str):
                if isinstance(f, EqualTo):
                    self.within.append((value, value, True))
                elif isinstance(f, StringStartsWith):
                    self.within.append((value, value + chr(0x10FFFF) * 4, True))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.within.append((value, chr(0x10FFFF) * 4, True))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.within.append(("", value, isinstance(f, LessThanOrEqual)))
            elif column == "parent" and isinstance(f, EqualTo) and isinstance(value, str):
                self.parents = {value} if self.parents is None else self.parents & {value}
            elif column == "kind" and isinstance(f, EqualTo | In):
                some = {value} if isinstance(f, EqualTo) else set(value or ())
                self.kinds = some if self.kinds is None else self.kinds & some
            yield f

    def _asked(self, folder: bytes, below: bool) -> bool:
        """Whether a folder's entries may be asked for, or also those ``below`` them: all have paths from ``folder/`` up to the next name."""
        shown = folder.decode("utf-8", "replace")
        first, last = (shown + "/", shown + "0") if shown else ("", chr(0x10FFFF) * 5)
        if any(last <= least or first > most or (first == most and not included) for least, most, included in self.within):
            return False
        if self.parents is None:
            return True
        return any(p == shown or (below and (not shown or p.startswith(shown + "/"))) for p in self.parents)

    def _folders(self, folder: bytes) -> list[bytes]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                return sorted(os.path.join(folder, e.name) for e in found if e.is_dir(follow_symlinks=False))
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        first = [f for f in self._folders(b"") if self._asked(f, True)]
        second = [g for f in first for g in self._folders(f) if self._asked(g, True)]
        parts = [Folders([b"", *first], [])]
        return parts + [Folders([], second[i :: self.parts]) for i in range(min(self.parts, len(second)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.flat:
            yield from self._rows(folder)
        todo = list(partition.deep)
        while todo:
            folder = todo.pop()
            todo.extend(f for f in self._folders(folder) if self._asked(f, True))
            yield from self._rows(folder)

    def _rows(self, folder: bytes) -> Iterator[tuple]:
        if not self._asked(folder, False):
            return
        self.listed += 1
        try:
            names = sorted(os.listdir(os.path.join(self.root, folder)))
        except OSError:
            return
        for name in names:
            raw = os.path.join(folder, name)
            full = os.path.join(self.root, raw)
            try:
                found = os.lstat(full)
            except OSError:
                continue
            kind = _kind(found.st_mode)
            shown = [x.decode("utf-8", "replace") for x in (raw, folder, name)]
            row = (raw, *shown, kind, found.st_size, found.st_mtime)
            yield (*row, self._head(full) if kind == "file" and (self.kinds is None or kind in self.kinds) else None) if self.content else row

    def _head(self, full: bytes) -> bytes | None:
        try:
            with open(full, "rb") as f:
                return f.read(self.most)
        except OSError:
            return None


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return schemas.ENTRIES + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
