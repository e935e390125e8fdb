"""A stored index that changes: immutable segments, deletion lists, tiered merging, and block-max search.

A segment's postings lie in blocks. Its documents are dealt into slices of a
bounded number and ordered in each by length, then id; a block is a run of a
term's postings in that order, so a block's documents are about as long as each
other, and its best (tf, length) pairs - those that no other pair beats in both -
bound what a posting of it can add to a score, whatever the average length of
the whole index has become.

What the index is made of is a manifest: segments, deletion lists and their
counts. Adding writes a segment, dropping a deletion list with the document
frequencies that it takes away, replacing both; each is one commit, so a search
reads one version and a writer that dies changes nothing.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.commits import Conflict, Log
from . import search

#: Documents of a slice at most, slices of a segment at least, and postings of a block.
SLICE_DOCS, MIN_SLICES, BLOCK = 16_384, 8, 128
#: Tokens that are inverted at a time, and partitions for each slice: few slices share one.
TOKENS, SPREAD = 1 << 21, 4
#: Segments of one tier that are merged into one, and how many times larger the next tier is.
FANOUT, TIER = 4, 10
DOCS = search.DOCS
_BLOCKS = "slice int, term string, n int, low int, high int, best_tf array<int>, best_len array<int>, at array<int>, docs array<{kind}>, lens array<int>, tfs array<int>, positions array<array<int>>"
_RUNS = "slice int, term string, part int, docs array<{kind}>, lens array<int>, at array<int>, tfs array<int>, places array<int>"


def _ends(changes: np.ndarray, n: int) -> np.ndarray:
    """Where runs of equal rows begin, and the end, of n rows of which ``changes`` tells whether each but the first differs from the one before it."""
    return np.r_[0, np.flatnonzero(changes) + 1, n].astype(np.int64)


def _listed(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _inverted(part: pa.RecordBatch, base: int) -> Iterator[pa.RecordBatch]:
    """Postings by term of rows (slice, doc, len, said: tokens between spaces) of one slice, of which the first is its ``base``-th document; the documents themselves as the empty term."""
    docs, lens = part.column(1), part.column(2).to_numpy()
    n, ints, own = part.num_rows, lambda x: pa.array(x.astype(np.int32)), part.column(0)[0].as_py()

    def runs(terms: pa.Array, ends: np.ndarray, of: np.ndarray, tfs: np.ndarray, place_ends: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        same = [pa.array(np.full(len(terms), x, np.int32)) for x in (own, base)]
        lists = [_listed(ends, x) for x in (docs.take(pa.array(of)), ints(lens[of]), ints(base + of), ints(tfs))]
        return pa.RecordBatch.from_arrays([same[0], terms, same[1], *lists, _listed(place_ends, ints(places))], ["slice", "term", "part", "docs", "lens", "at", "tfs", "places"])

    yield runs(pa.array([DOCS], pa.string()), np.array([0, n]), np.arange(n), np.ones(n), np.zeros(2), np.empty(0))
    words = pc.split_pattern(part.column(3), " ").flatten().dictionary_encode()
    size = np.maximum(lens, 1).astype(np.int64)  # an empty text splits into one empty string
    of = np.repeat(np.arange(n), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    code = words.indices.to_numpy()
    code = code.astype(np.uint16) if len(words.dictionary) <= 1 << 16 else code  # short integers are sorted by their digits
    if not lens.all():
        of, at, code = (x[np.repeat(lens > 0, size)] for x in (of, at, code))
    if not len(of):
        return
    order = np.argsort(code, kind="stable")
    of, at, code = of[order], at[order], code[order]
    first = _ends((code[1:] != code[:-1]) | (of[1:] != of[:-1]), len(of))
    of, code = of[first[:-1]], code[first[:-1]]
    ends = _ends(code[1:] != code[:-1], len(code))
    yield runs(words.dictionary.take(pa.array(code[ends[:-1]])).cast(pa.string()), ends, of, np.diff(first), first[ends], at)


def _runs(docs: DataFrame, id_col: str, text_col: str, slices: int) -> DataFrame:
    """Postings of a table's texts, in rows of a term's in some :data:`TOKENS` tokens of a slice. Texts are dealt into slices whole, in one shuffle, and split and inverted there."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int")).repartition(SPREAD * slices, "slice")
    rows = rows.select("slice", "doc", text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    rows = rows.select("slice", "doc", F.size("tokens").alias("len"), F.array_join("tokens", " ").alias("said")).sortWithinPartitions("slice", "len", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of, piece = batch.column(0).to_numpy(), np.cumsum(batch.column(2).to_numpy().astype(np.int64)) // TOKENS
            ends = _ends((of[1:] != of[:-1]) | (piece[1:] != piece[:-1]), len(of)).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                last, base = (last, base) if of[a] == last else (of[a], 0)
                yield from _inverted(batch.slice(a, b - a), base)
                base += b - a

    return rows.mapInArrow(run, _RUNS.format(kind=kind)).sortWithinPartitions("slice", "term", "part")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of a partition sorted by slice and term, those of a term in a slice together, and where each such group begins, and the end."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        of, term = table.column("slice").to_numpy(), table.column("term").chunk(0).dictionary_encode().indices.to_numpy()
        ends = _ends((of[1:] != of[:-1]) | (term[1:] != term[:-1]), len(of))
        if len(ends) > 2:
            yield table.slice(0, ends[-2]).combine_chunks(), ends[:-1]
        held = table.slice(ends[-2])
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _flat(table: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and how many each row has."""
    lists = table.column(column).chunk(0)
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _cut(most: int, table: pa.Table, row: np.ndarray, group: np.ndarray, docs: pa.Array, lens: np.ndarray, at: np.ndarray, tfs: np.ndarray, positions: pa.ListArray) -> pa.RecordBatch:
    """Blocks of ``most`` postings in the order of their ``group`` and ``at``; ``row`` is a row of ``table`` with the group's slice and term."""
    n = len(group)
    ends = _ends(group[1:] != group[:-1], n)
    within = np.arange(n) - np.repeat(ends[:-1], np.diff(ends))
    ends = np.r_[np.flatnonzero(within % most == 0), n]
    begin, size = ends[:-1], np.diff(ends)
    block = np.repeat(np.arange(len(begin), dtype=np.int64), size)
    # a posting whose tf none before it in its block has is on the block's frontier, unless one of its length follows that is too
    rank = (block << 32) + tfs
    best = np.flatnonzero(np.r_[True, rank[1:] > np.maximum.accumulate(rank)[:-1]])
    best = best[~np.r_[(block[best[1:]] == block[best[:-1]]) & (lens[best[1:]] == lens[best[:-1]]), False]]
    best_ends = np.searchsorted(best, ends)
    ints = lambda x: pa.array(x.astype(np.int32))
    of = table.select(["slice", "term"]).take(pa.array(row[begin])).combine_chunks()
    columns = [of.column(0).chunk(0), of.column(1).chunk(0), ints(size), ints(at[begin]), ints(at[ends[1:] - 1]), _listed(best_ends, ints(tfs[best])), _listed(best_ends, ints(lens[best]))]
    columns += [_listed(ends, x) for x in (ints(at), docs, ints(lens), ints(tfs), positions)]
    return pa.RecordBatch.from_arrays(columns, ["slice", "term", "n", "low", "high", "best_tf", "best_len", "at", "docs", "lens", "tfs", "positions"])


def _blocked(runs: DataFrame, kind: str) -> DataFrame:
    """Blocks of :func:`_runs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in _terms(batches):
            docs, count = _flat(table, "docs")
            lens, at, tfs = (_flat(table, c)[0].to_numpy().astype(np.int64) for c in ("lens", "at", "tfs"))
            places, used = _flat(table, "places")
            groups = np.repeat(np.arange(len(ends) - 1), np.diff(ends))  # of rows
            own = np.where(np.repeat(used > 0, count), tfs, 0)  # documents themselves have no places
            row = np.repeat(np.arange(table.num_rows), count)
            yield _cut(BLOCK, table, row, groups[row], docs, lens, at, tfs, _listed(np.r_[0, np.cumsum(own)], places))

    return runs.mapInArrow(run, _BLOCKS.format(kind=kind))


class _Places:
    """New places of the documents of a slice that is made of others: by length, then id, without deleted ones."""

    def __init__(self, table: pa.Table) -> None:
        """``table`` has (unit, docs, lens, at): the blocks of the empty term, and with null places the deleted documents, of each unit, a slice before."""
        table = table.combine_chunks()
        gone = ~table.column("at").chunk(0).is_valid().to_numpy(zero_copy_only=False)
        held, lists = table.filter(pa.array(~gone)).combine_chunks(), table.filter(pa.array(gone))
        (docs, count), lens, at = _flat(held, "docs"), _flat(held, "lens")[0], _flat(held, "at")[0].to_numpy()
        unit = np.repeat(held.column("unit").to_numpy(), count)
        self.units, own = np.unique(unit, return_inverse=True)
        size = np.bincount(own)
        self.begin = np.cumsum(size) - size
        live = np.ones(len(docs), bool)
        for u, listed in zip(lists.column("unit").to_pylist(), lists.column("docs"), strict=True):
            mine = np.flatnonzero(unit == u)
            live[mine] = ~pc.is_in(docs.take(pa.array(mine)), value_set=listed.values).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(live)
        rows = pa.table({"len": lens.take(pa.array(kept)), "doc": docs.take(pa.array(kept))})
        self.to = np.full(len(docs), -1, np.int64)
        kept = kept[pc.sort_indices(rows, [("len", "ascending"), ("doc", "ascending")]).to_numpy()]
        self.to[self.begin[own[kept]] + at[kept]] = np.arange(len(kept))

    def of(self, unit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """New places of documents by their unit and place there; -1 of deleted ones."""
        return self.to[self.begin[np.searchsorted(self.units, unit)] + at]


def _reblocked(blocks: DataFrame, kind: str) -> DataFrame:
    """Blocks of slices made of others, from the blocks (slice, unit, term, docs, lens, at, tfs, positions) of each, sorted by slice and term; deleted documents of a unit come as the empty term's with null places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: _Places | None = None
        for table, ends in _terms(batches):
            empty = np.flatnonzero(pc.equal(table.column("term"), DOCS).to_numpy()[ends[:-1]])
            for a, b in zip(np.unique(np.r_[0, empty]), np.unique(np.r_[0, empty, len(ends) - 1])[1:], strict=True):
                if a in empty:
                    places = _Places(table.slice(ends[a], ends[a + 1] - ends[a]))
                yield from remade(table.slice(ends[a], ends[b] - ends[a]).combine_chunks(), ends[a : b + 1] - ends[a], places)

    def remade(table: pa.Table, ends: np.ndarray, places: _Places) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        known = table.column("at").chunk(0).is_valid().to_numpy(zero_copy_only=False)
        table, group = table.filter(pa.array(known)).combine_chunks(), group[known]
        at, count = _flat(table, "at")
        row = np.repeat(np.arange(table.num_rows), count)
        to = places.of(table.column("unit").to_numpy()[row], at.to_numpy())
        kept = np.flatnonzero(to >= 0)
        if not len(kept):
            return
        kept = kept[np.lexsort((to[kept], group[row[kept]]))]
        lens, tfs = (_flat(table, c)[0].to_numpy()[kept].astype(np.int64) for c in ("lens", "tfs"))
        docs, positions = (_flat(table, c)[0].take(pa.array(kept)) for c in ("docs", "positions"))
        yield _cut(BLOCK, table, row[kept], group[row[kept]], docs, lens, to[kept], tfs, positions)

    return blocks.mapInArrow(run, _BLOCKS.format(kind=kind))


def _packed(sizes: dict[tuple[str, int], int], most: int) -> list[tuple[str, int, int, int]]:
    """(owner, slice, to, unit): slices put together, the largest with the smallest that still fit, into ones of ``most`` documents or one slice; a unit is a slice's number."""
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    found, to, low, high = [], 0, 0, len(order) - 1
    while low <= high:
        n, mine = sizes[order[low]], [order[low]]
        low += 1
        while low <= high and n + sizes[order[high]] <= most:
            n += sizes[order[high]]
            mine.append(order[high])
            high -= 1
        found += [(*x, to) for x in mine]
        to += 1
    return [(*x, unit) for unit, x in enumerate(found)]


class Index:
    """An index at ``path``, of documents whose ids are of type ``kind``. Ids are unique and not null; rows with a null id are left out, and of rows that repeat one, one is taken."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint") -> None:
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.log = Log(spark, path)
        self._frames: dict[tuple, DataFrame] = {}  # a segment's files never change

    # --- Reading

    def manifest(self, version: int | None = None) -> dict:
        return {"segments": [], **self.log.state(version)[1]}

    def _read(self, table: str, names: Sequence[str], schema: str) -> DataFrame:
        """A table of segments or deletion lists, by ``owner``."""
        key = (table, *names)
        if key not in self._frames:
            if not names:
                return self.spark.createDataFrame([], schema).withColumn("owner", F.lit(""))
            read = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}/{table}" for n in names])
            self._frames[key] = read.withColumn("owner", F.element_at(F.split(read["_metadata.file_path"], "/"), -3))
        return self._frames[key]

    def _blocks(self, segments: list[dict]) -> DataFrame:
        return self._read("blocks", [s["name"] for s in segments], _BLOCKS.format(kind=self.kind))

    def _gone(self, segments: list[dict]) -> DataFrame:
        """(owner: the segment, slice, doc) of deleted documents."""
        lists = {d: s["name"] for s in segments for d in s["deleted"]}
        rows = self._read("docs", list(lists), f"segment string, slice int, doc {self.kind}")
        return rows.select(F.col("segment").alias("owner"), "slice", "doc")

    def postings(self, segments: list[dict] | None = None, terms: Sequence[str] | None = None) -> DataFrame:
        """(owner, slice, term, doc, len, tf, positions) of all documents that are there; the empty term has every document once."""
        segments = self.manifest()["segments"] if segments is None else segments
        blocks = self._blocks(segments)
        blocks = blocks if terms is None else blocks.where(F.col("term").isin(list(terms)))
        rows = blocks.select("owner", "slice", "term", F.explode(F.arrays_zip("docs", "lens", "tfs", "positions")).alias("p"))
        rows = rows.select("owner", "slice", "term", F.col("p.docs").alias("doc"), F.col("p.lens").alias("len"), F.col("p.tfs").alias("tf"), F.col("p.positions").alias("positions"))
        return rows.join(self._gone(segments), ["owner", "slice", "doc"], "left_anti") if any(s["deleted"] for s in segments) else rows

    def documents(self) -> DataFrame:
        """(doc, len) of all documents that are there."""
        return self._documents(self.manifest()["segments"]).select("doc", F.col("len").cast("long").alias("len"))

    def _documents(self, segments: list[dict]) -> DataFrame:
        """(owner, slice, doc, len, at) of all documents that are there."""
        blocks = self._blocks(segments).where(F.col("term") == DOCS)
        rows = blocks.select("owner", "slice", F.explode(F.arrays_zip("docs", "lens", "at")).alias("p"))
        rows = rows.select("owner", "slice", F.col("p.docs").alias("doc"), F.col("p.lens").alias("len"), F.col("p.at").alias("at"))
        return rows.join(self._gone(segments), ["owner", "slice", "doc"], "left_anti") if any(s["deleted"] for s in segments) else rows

    # --- Writing

    def _segment(self, blocks: DataFrame) -> dict | None:
        """Writes blocks as a segment and tells of it; none of no documents."""
        name = uuid.uuid4().hex
        where = f"{self.path}/data/{name}"
        blocks.write.parquet(f"{where}/blocks")
        blocks = self.spark.read.parquet(f"{where}/blocks")
        blocks.where(F.col("term") != DOCS).groupBy("term").agg(F.sum("n").cast("long").alias("df")).sort("term").write.parquet(f"{where}/terms")
        tokens = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        docs, total = blocks.where(F.col("term") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0))).first()
        return {"name": name, "docs": docs, "tokens": total, "deleted": []} if docs else None

    def _slices(self, n: int) -> int:
        return max(MIN_SLICES, -(-n // SLICE_DOCS))

    def _built(self, docs: DataFrame, id_col: str, text_col: str) -> dict | None:
        docs = docs.where(docs[id_col].isNotNull())
        n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
        docs = docs if n == ids else docs.dropDuplicates([id_col])  # which moves the texts once more
        return self._segment(_blocked(_runs(docs, id_col, text_col, self._slices(ids)), self.kind))

    def _merged(self, group: list[dict]) -> dict | None:
        """Writes segments as one, without what is deleted: slices are put together whole, and their blocks merged."""
        blocks, lists = self._blocks(group), self._gone(group)
        sizes = Counter({(r["owner"], r["slice"]): r["n"] for r in blocks.where(F.col("term") == DOCS).groupBy("owner", "slice").agg(F.sum("n").alias("n")).collect()})  # one row a slice
        sizes.subtract({(r["owner"], r["slice"]): r["n"] for r in lists.groupBy("owner", "slice").agg(F.count(F.lit(1)).alias("n")).collect()})
        total = sum(sizes.values())
        dealt = _packed({x: n for x, n in sizes.items() if n > 0}, min(SLICE_DOCS, -(-total // MIN_SLICES)))
        if not dealt:
            return None
        to = F.broadcast(self.spark.createDataFrame(dealt, "owner string, slice int, to int, unit int"))  # one row a slice
        gone = lists.groupBy("owner", "slice").agg(F.collect_list("doc").alias("docs")).withColumn("term", F.lit(DOCS))
        rows = blocks.select("owner", "slice", "term", "docs", "lens", "at", "tfs", "positions").unionByName(gone, allowMissingColumns=True)
        rows = rows.join(to, ["owner", "slice"]).select(F.col("to").alias("slice"), "unit", "term", "docs", "lens", "at", "tfs", "positions")
        rows = rows.repartition(SPREAD * (1 + max(x[2] for x in dealt)), "slice").sortWithinPartitions("slice", "term")
        return self._segment(_reblocked(rows, self.kind))

    def _deleted(self, segments: list[dict], ids: DataFrame) -> dict[str, dict]:
        """Writes a deletion list for each segment that holds some of ``ids`` (doc): what each takes away."""
        found: dict[str, dict] = {}
        if not segments:
            return found
        name = uuid.uuid4().hex
        where = f"{self.path}/data/{name}"
        rows = self._documents(segments).join(ids.select("doc").distinct(), "doc", "left_semi")
        rows.select(F.col("owner").alias("segment"), "slice", "doc", "len", "at").write.parquet(f"{where}/docs")
        gone = self.spark.read.parquet(f"{where}/docs")
        for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).collect():  # one row a segment
            found[r["segment"]] = {"name": name, "docs": r["n"], "tokens": r["tokens"]}
        if found:
            held = [s for s in segments if s["name"] in found]
            self._held(held, gone).groupBy("term").agg(F.sum("df").alias("df")).sort("term").write.parquet(f"{where}/terms")
        return found

    def _held(self, segments: list[dict], gone: DataFrame) -> DataFrame:
        """(term, df): in how many documents of ``gone`` (segment, slice, at) terms are, by some blocks of a slice; of a posting its place is all that is read."""
        blocks = self._blocks(segments).where(F.col("term") != DOCS).select("owner", "slice", "term", "at")
        lists = gone.groupBy(F.col("segment").alias("owner"), "slice").agg(F.collect_list("at").alias("at")).withColumn("term", F.lit(DOCS))
        rows = blocks.unionByName(lists).repartition("owner", "slice").sortWithinPartitions("owner", "slice", "term")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, out = None, np.zeros(0, bool)
            for batch in batches:
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                ends = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    if keys[a] != last:  # the slice's first row is its deleted documents, if it has any
                        last, out = keys[a], np.zeros(0, bool)
                        if batch.column(2)[a].as_py() == DOCS:
                            at = batch.column(3)[a].values.to_numpy()
                            out = np.zeros(at.max() + 1, bool)
                            out[at] = True
                            a += 1
                    if a < b and len(out):
                        lists = batch.column(3).slice(a, b - a)
                        at, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                        of = np.repeat(np.arange(b - a), count)[(at < len(out)) & out[np.minimum(at, len(out) - 1)]]
                        df = np.bincount(of, minlength=b - a)
                        yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pa.array(df.astype(np.int64))], ["term", "df"]).filter(pa.array(df > 0))

        return rows.select("owner", "slice", "term", "at").mapInArrow(run, "term string, df long")

    @staticmethod
    def _without(segments: list[dict], gone: dict[str, dict]) -> list[dict]:
        left = []
        for s in segments:
            d = gone.get(s["name"])
            s = s if d is None else {**s, "docs": s["docs"] - d["docs"], "tokens": s["tokens"] - d["tokens"], "deleted": [*s["deleted"], d["name"]]}
            if s["docs"]:
                left.append(s)
        return left

    def _commit(self, base: int, segments: list[dict]) -> int:
        """Commits a whole list of segments made from version ``base``; a commit between makes it a conflict."""

        def change(version: int, _: dict) -> dict:
            if version != base + 1:
                raise Conflict(f"the index is at version {version - 1}, not {base}")
            return {"segments": segments, "kind": self.kind}

        return self.log.commit(change)

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> int:
        """Adds the documents whose ids the index lacks, as one segment, and gives the version. What is there stays as it is."""
        base, state = self.log.state()
        segments = state.get("segments", [])
        fresh = docs.join(self.documents().select(F.col("doc").alias(id_col)), id_col, "left_anti") if segments else docs
        made = self._built(fresh, id_col, text_col)
        return self._commit(base, [*segments, made]) if made else base

    def drop(self, ids: DataFrame) -> int:
        """Takes documents (doc) out."""
        base, state = self.log.state()
        gone = self._deleted(state.get("segments", []), ids)
        return self._commit(base, self._without(state["segments"], gone)) if gone else base

    def replace(self, docs: DataFrame, id_col: str, text_col: str) -> int:
        """Puts documents in place of those with their ids, which need not be there."""
        base, state = self.log.state()
        segments = state.get("segments", [])
        made = self._built(docs, id_col, text_col)
        gone = self._deleted(segments, docs.select(F.col(id_col).alias("doc")))
        return self._commit(base, [*self._without(segments, gone), *([made] if made else [])])

    def reset(self) -> int:
        """An empty version."""
        return self._commit(self.log.latest(), [])

    def merge(self, everything: bool = False) -> int:
        """Merges the segments of every tier that holds :data:`FANOUT` of them and those of which half is deleted, or all, without what is deleted; gives the version."""
        base, state = self.log.state()
        segments = state.get("segments", [])
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(int(log(s["docs"], TIER)), []).append(s)
        groups = [segments] if everything else [t for t in tiers.values() if len(t) >= FANOUT]
        groups = [g for g in groups if len(g) > 1 or any(s["deleted"] for s in g)]
        names = {s["name"] for g in groups for s in g}
        groups += [[s] for s in segments if s["name"] not in names and self._half_gone(s)]
        for group in groups:
            made = self._merged(group)
            old = {s["name"] for s in group}
            segments = [s for s in segments if s["name"] not in old] + ([made] if made else [])
        return self._commit(base, segments) if groups else base

    def _half_gone(self, s: dict) -> bool:
        return bool(s["deleted"]) and self._gone([s]).where(F.col("owner") == s["name"]).count() > s["docs"]

    def vacuum(self, keep: int = 1, **kw) -> int:
        """Deletes old versions and the segments and lists that only they name."""
        return self.log.vacuum(keep, "data", lambda m: {x for s in m.get("segments", []) for x in (s["name"], *s["deleted"])}, **kw)

    # --- Searching

    def frequencies(self, segments: list[dict], terms: Sequence[str]) -> dict[str, int]:
        """Document frequencies over all segments, less what is deleted."""
        held = lambda names: self._read("terms", names, "term string, df bigint").where(F.col("term").isin(list(terms)))
        rows = held([s["name"] for s in segments]).select("term", "df")
        lists = sorted({d for s in segments for d in s["deleted"]})
        if lists:
            rows = rows.unionByName(held(lists).select("term", (-F.col("df")).alias("df")))
        found: Counter = Counter()
        for r in rows.collect():  # a row a term and segment
            found[r["term"]] += r["df"]
        return {t: n for t, n in found.items() if n > 0}

    def search(self, phrases: Sequence[Sequence[str]], every: bool, k: int = 10, keep: DataFrame | None = None, version: int | None = None, count: bool = False) -> DataFrame:
        """(doc, score) of the best ``k`` documents by BM25 with all phrases, or any, as :func:`search.bm25` has it.

        Single words are scored by blocks: a slice's stretches between the ends of
        blocks are taken in the order of their bounds, and none whose bound is
        below the slice's ``k``-th best score is scored. Phrases of several
        tokens and a ``keep`` (doc) are scored whole. With ``count``, the
        result has ``scored`` besides, the postings that the row's slice
        scored.
        """
        segments = self.manifest(version)["segments"]
        k = max(1, k)
        if not phrases or not segments:
            return self.spark.createDataFrame([], f"doc {self.kind}, score double" + (", scored long" if count else ""))
        n, tokens = sum(s["docs"] for s in segments), sum(s["tokens"] for s in segments)
        average = tokens / n
        if keep is not None or any(len(p) > 1 for p in phrases):
            terms = sorted({t for p in phrases for t in p})
            whole = self.spark.createDataFrame([(float(n), average)], "n double, average double")
            return search.top(search.bm25(self.postings(segments, terms), self.documents(), phrases, every, keep, whole), k)
        times = Counter(p[0] for p in phrases)
        df = self.frequencies(segments, list(times))
        if every and len(df) < len(times):
            return self.search([], every, count=count)
        weight = {t: times[t] * max(log((n - d + 0.5) / (d + 0.5)), fixed.IDF_FLOOR) for t, d in df.items()}
        need = len(times) if every else 1
        blocks = self._blocks(segments).where(F.col("term").isin(sorted(weight))).select("owner", "slice", "term", "low", "high", "best_tf", "best_len", "at", "docs", "lens", "tfs")
        if any(s["deleted"] for s in segments):  # deleted documents come as blocks of the empty term
            gone = self._gone(segments).groupBy("owner", "slice").agg(F.collect_list("doc").alias("docs"))
            nothing = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in blocks.columns if c not in ("owner", "slice", "docs", "term")}
            blocks = blocks.unionByName(gone.withColumn("term", F.lit(DOCS)).withColumns(nothing))
        dealt = blocks.repartition("owner", "slice").sortWithinPartitions("owner", "slice", "term", "low")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                found, scored = _best(part, weight, average, need, k)
                if found:
                    docs, scores = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, part.schema.field("docs").type.value_type), pa.array(scores, pa.float64()), pa.array([scored] * len(docs), pa.int64())], ["doc", "score", "scored"])

        best = search.top(dealt.mapInArrow(run, f"doc {self.kind}, score double, scored long"), k)
        return best if count else best.select("doc", "score")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of each slice of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        begin = 0
        for i in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []:
            if held and keys[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[begin]
            held.append(batch.slice(begin, i - begin))
            begin = i
    if held:
        yield pa.Table.from_batches(held)


def _best(part: pa.Table, weight: dict[str, float], average: float, need: int, k: int) -> tuple[list[tuple], int]:
    """((doc, score) of the best ``k`` of a slice, how many postings were scored for it)."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    terms = np.array(part.column("term").to_pylist(), object)
    gone = {d for docs in part.filter(pa.array(terms == DOCS)).column("docs").to_pylist() for d in docs}
    part = part.filter(pa.array(terms != DOCS)).combine_chunks()
    if not part.num_rows:
        return [], 0
    terms = part.column("term").to_pylist()
    flat = lambda c: part.column(c).chunk(0)
    ends = flat("best_tf").offsets.to_numpy()
    tf, ln = flat("best_tf").flatten().to_numpy().astype(float), flat("best_len").flatten().to_numpy().astype(float)
    damp = lambda n: k1 * (1 - b + b * n / average)
    w = np.array([weight[t] * (k1 + 1) for t in terms])
    bound = np.maximum.reduceat(tf / (tf + damp(ln)), ends[:-1]) * w
    low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
    edges = np.unique(np.concatenate([low, high + 1]))
    # what the blocks of each term can add to each stretch between edges; blocks of a term lie side by side
    ups, met, cover = np.zeros(len(edges) - 1), np.zeros(len(edges) - 1, int), []
    runs = np.flatnonzero(np.r_[True, [a != c for a, c in zip(terms[1:], terms[:-1], strict=True)], True])
    for a, c in zip(runs[:-1], runs[1:], strict=True):
        at = np.searchsorted(low[a:c], edges[:-1], "right") - 1 + a
        inside = (at >= a) & (edges[:-1] <= high[np.maximum(at, a)])
        ups += np.where(inside, bound[at], 0.0)
        met += inside
        cover.append(np.where(inside, at, -1))
    cover = np.stack(cover)
    ends = flat("at").offsets.to_numpy()
    place, lens, tfs = (flat(c).flatten().to_numpy() for c in ("at", "lens", "tfs"))
    docs = flat("docs").flatten()
    order = np.flatnonzero(met >= need)
    order = order[np.argsort(-ups[order], kind="stable")]
    best: list[tuple[float, object]] = []
    scored, done = 0, 0
    while done < len(order):
        if len(best) == k and ups[order[done]] * (1 + 1e-9) < best[-1][0]:
            break
        some = order[done : done + 8]
        done += len(some)
        which = [np.empty(0, np.int64)]
        for x in some:
            for j in cover[:, x]:
                if j >= 0:
                    a, c = np.searchsorted(place[ends[j] : ends[j + 1]], (edges[x], edges[x + 1])) + ends[j]
                    which.append(np.arange(a, c))
        which = np.concatenate(which)
        scored += len(which)
        own = np.searchsorted(ends, which, "right") - 1
        adds = w[own] * tfs[which] / (tfs[which] + damp(lens[which].astype(float)))
        ids, first, back, count = np.unique(place[which], return_index=True, return_inverse=True, return_counts=True)
        scores = np.bincount(back, adds, len(ids))
        good = np.flatnonzero(count >= need)
        if len(best) == k:
            good = good[scores[good] >= best[-1][0]]
        if len(good) > k and not gone:
            good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
        for s, d in zip(scores[good].tolist(), docs.take(pa.array(which[first[good]])).to_pylist(), strict=True):
            if d not in gone:
                best.append((s, d))
        best.sort(key=lambda x: (-x[0], x[1]))
        del best[k:]
    return [(d, s) for s, d in best], scored
