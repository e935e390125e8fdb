"""Tables whose writes are commits: a log of manifests, and keyed tables on it.

A table is a folder of immutable parts and a log of numbered manifests, each of
which lists the parts of one version. Data is written first and seen only once
its manifest is there; a manifest is put under the next number if no one has
put it before, so writers that meet are brought into one order and a writer
that dies leaves nothing but a part that no version names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How long a part that no version names is left alone: its writer may be about to commit it.
GRACE_SECONDS = 86_400


class Conflict(Exception):
    """Someone else's commit came first, and this one does not stand beside it."""


class Log:
    """Manifests by number below ``path``/log. Number 0 is the empty state, which is in no file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, version: int) -> str:
        return f"{self.path}/log/{version:020}.json"

    def versions(self) -> list[int]:
        """Numbers of all manifests, ascending."""
        where = self._path(f"{self.path}/log")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """(version, manifest) of a version, the newest by default."""
        version = self.latest() if version is None else version
        if not version:
            return 0, {}
        at = self._path(self._file(version))
        if not self._fs.exists(at):
            raise ValueError(f"no version {version} of {self.path}")
        stream = self._fs.open(at)
        try:
            return version, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def put(self, version: int, manifest: dict) -> None:
        """Writes a manifest under its number whole, or raises :class:`Conflict` if there is one: by a hard link on one machine's disk, else by a rename that replaces nothing."""
        draft = f"{self.path}/log/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(json.dumps(manifest, sort_keys=True).encode())
            stream.hsync()
        finally:
            stream.close()
        try:
            uri = self._fs.makeQualified(self._path(self._file(version))).toUri()
            if uri.getScheme() == "file":
                os.link(self._fs.makeQualified(self._path(draft)).toUri().getPath(), uri.getPath())
            else:
                self._rename(draft, self._file(version))
        except FileExistsError:
            raise Conflict(f"version {version} of {self.path} is there") from None
        finally:
            self._fs.delete(self._path(draft), False)

    def _rename(self, draft: str, to: str) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(draft), self._path(to), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise FileExistsError(to) from None
            raise

    def commit(self, change: Callable[[int, dict], dict]) -> int:
        """Puts ``change(next version, newest manifest)``; begins anew where another commit came between. What ``change`` raises ends it."""
        while True:
            version, manifest = self.state()
            made = change(version + 1, manifest)
            try:
                self.put(version + 1, made)
                return version + 1
            except Conflict:
                continue

    def vacuum(self, keep: int, folder: str, named: Callable[[dict], set[str]], grace: float = GRACE_SECONDS) -> int:
        """Deletes all manifests but the newest ``keep``, then the entries of ``folder`` that none of these names and that are older than ``grace`` seconds; gives the number of these."""
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        names = set().union(*(named(self.state(v)[1]) for v in kept)) if kept else set()
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._path(self._file(v)), False)
        where, gone = self._path(f"{self.path}/{folder}"), 0
        if self._fs.exists(where):
            for s in self._fs.listStatus(where):
                if s.getPath().getName() not in names and time.time() - s.getModificationTime() / 1000 >= grace:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone


class Table:
    """A keyed table of committed parts; a row of a later version takes the place of an earlier one with its key.

    ``schema`` is that of its rows. Keys may be null. Writing costs what is
    written: rows are merged when they are read, and by :meth:`compact`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)
        self.stored = StructType([*self.schema.fields]).add("__gone", "boolean")
        self.log = Log(spark, path)

    def _write(self, rows: DataFrame, gone: Column, unique: bool = False) -> str:
        """A part of the rows, one a key: of several the largest. ``unique`` rows repeat no key and are not shuffled."""
        name = uuid.uuid4().hex
        rest = [f.name for f in self.schema.fields if f.name not in self.key]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], gone.alias("__gone"))
        if unique:
            rows.select(self.stored.names).write.parquet(f"{self.path}/parts/{name}")
            return name
        once = rows.groupBy(*self.key).agg(F.max(F.struct(*[F.col(c) for c in (*rest, "__gone")])).alias("__row"))
        once.select(*self.key, "__row.*").select(self.stored.names).write.parquet(f"{self.path}/parts/{name}")
        return name

    def _parts(self, parts: list[dict]) -> DataFrame:
        """Rows of parts, with the version ``__seq`` that each came with."""
        if not parts:
            return self.spark.createDataFrame([], self.stored).withColumn("__seq", F.lit(0).cast("long"))
        read = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/parts/{p['name']}" for p in parts])
        part = F.element_at(F.split(read["_metadata.file_path"], "/"), -2)
        seq = F.coalesce(*[F.when(part == p["name"], F.lit(p["seq"])) for p in parts]) if len(parts) < 64 else F.create_map(*[F.lit(x) for p in parts for x in (p["name"], p["seq"])])[part]
        return read.withColumn("__seq", seq.cast("long"))

    def _merged(self, parts: list[dict]) -> DataFrame:
        if len(parts) == 1:  # a part has a row a key: nothing to merge, nothing to shuffle
            return self._parts(parts).where("NOT __gone").select(self.schema.names)
        rest = [c for c in self.stored.names if c not in self.key]
        latest = self._parts(parts).groupBy(*self.key).agg(F.max_by(F.struct(*rest), "__seq").alias("__row"))
        return latest.select(*self.key, "__row.*").where("NOT __gone").select(self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._merged(self.log.state(version)[1].get("parts", []))

    def _put(self, name: str, rows_since: int | None) -> int:
        def change(version: int, manifest: dict) -> dict:
            parts = manifest.get("parts", [])
            if rows_since is not None and (since := [p for p in parts if p["seq"] > rows_since]):
                mine = self._parts([{"name": name, "seq": 0}]).select(*[F.col(k).alias(f"my_{k}") for k in self.key])
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"my_{k}")) for k in self.key])
                if self._parts(since).join(mine, same, "left_semi").limit(1).count():
                    raise Conflict(f"keys were written since version {rows_since}")
            return {"parts": [*parts, {"name": name, "seq": version}]}

        return self.log.commit(change)

    def own(self, version: int) -> DataFrame:
        """The rows that a version's upsert brought."""
        return self._parts([p for p in self.log.state(version)[1]["parts"] if p["seq"] == version]).where("NOT __gone").select(self.schema.names)

    def upsert(self, rows: DataFrame, since: int | None = None, unique: bool = False) -> int:
        """Commits rows by their keys and gives the version.

        Concurrent upserts all hold, in the order of their versions. With
        ``since``, the version that the rows were made from, :class:`Conflict`
        is raised if one of their keys was written after it. ``unique`` says
        that no key repeats, as in what :meth:`read` gives.
        """
        return self._put(self._write(rows, F.lit(False), unique), since)

    def delete(self, keys: DataFrame, since: int | None = None) -> int:
        """Commits that rows of these keys are gone."""
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.key]
        return self._put(self._write(keys.select(*self.key, *blank), F.lit(True)), since)

    def compact(self) -> int:
        """Commits one part in place of all; raises :class:`Conflict` if another compaction took one of them away meanwhile."""
        version, manifest = self.log.state()
        old = manifest.get("parts", [])
        name = self._write(self._merged(old), F.lit(False))

        def change(_: int, now: dict) -> dict:
            if not {p["name"] for p in old} <= {p["name"] for p in now.get("parts", [])}:
                raise Conflict("the parts were compacted already")
            later = [p for p in now["parts"] if p not in old]
            return {"parts": [{"name": name, "seq": version}, *later]}

        return self.log.commit(change)

    def vacuum(self, keep: int = 1, grace: float = GRACE_SECONDS) -> int:
        """Deletes old versions and the parts that only they name; gives the number of parts."""
        return self.log.vacuum(keep, "parts", lambda m: {p["name"] for p in m.get("parts", [])}, grace)
