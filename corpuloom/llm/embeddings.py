"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance d = 2 - 2t. Split
into blocks of rotated coordinates, at least one block of such a pair lies
within its share of d, and every coordinate of that block within the share's
root. So each block is range-joined under its proportional budget:

1. Vectors are normalised in double precision and rotated by a fixed random
   orthogonal matrix, which spreads the variance evenly over the blocks.
2. In each block, a grid over its first coordinates with cells as wide as the
   block's reach; a pair within reach meets in cells that touch. The more
   vectors a label has, the more coordinates are used.
3. A cell's members are dealt into chunks, and a task holds a chunk against
   one of the same or a touching cell: by block distance first, then the whole
   vectors exactly in double precision. A pair within reach in several blocks
   counts in the first of these only, so counts add up without pairs being
   written anywhere.
4. Tasks give each vector's number of links and links enough to keep what they
   join connected; components follow from these.

Equal vectors of one label are one class first, so a crowd of copies is one
member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, groups, materialise
from .components import components

THRESHOLD = 0.93
#: Blocks that a vector is split into, and most members of a chunk.
BLOCKS, CHUNK = 4, 4096
#: Most grid coordinates of a block; a label has as many as keep its cells near a chunk's size.
MAX_GRID = 4
_SEED = 20240517
_SPREAD = 3.0


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _bounds(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)


def _reach(threshold: float, bounds: np.ndarray) -> np.ndarray:
    """Each block's reach: its share of the squared distance by its dimensions, with room for rounding."""
    return np.sqrt((2 - 2 * threshold) * np.diff(bounds) / bounds[-1] * (1 + 1e-9) + 1e-12)


def _scaled(values: list | None) -> np.ndarray | None:
    """The vector in double precision, scaled by a power of two (which is exact); none if null, empty, zero or with a null or non-finite component."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((x * x).sum(axis=1))
    return x / norms[:, None], norms


def _turned(units: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rotated coordinates low to high; einsum adds up a row alike whatever the other rows are."""
    return np.einsum("ij,jk->ik", units, rotation(units.shape[1])[:, low:high])


def _cells(classes: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, block, cell, cid): the cell of every class in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            dims, grids = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            for dim, grid in sorted(set(zip(dims.tolist(), grids.tolist(), strict=True))):
                some = np.flatnonzero((dims == dim) & (grids == grid))
                rows = batch.take(pa.array(some))
                units, _ = _units(np.frombuffer(b"".join(rows.column(3).to_pylist())).reshape(-1, dim))
                bounds = _bounds(dim, BLOCKS)
                for b, reach in enumerate(_reach(threshold, bounds)):
                    high = min(bounds[b + 1], bounds[b] + grid)
                    cells = np.floor(_turned(units, bounds[b], high) / (reach * (1 + 1e-6))).astype("<i4")
                    for column, x in zip(out, (rows.column(0).to_pylist(), [dim] * len(some), [b] * len(some), [c.tobytes() for c in cells], rows.column(2).to_pylist()), strict=True):
                        column.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["label", "dim", "block", "cell", "cid"])

    return classes.select("label", "dim", "cid", "vector", "grid").mapInArrow(run, "label string, dim int, block int, cell binary, cid long")


def _touching(cells: DataFrame) -> DataFrame:
    """(label, dim, block, near, far): pairs of cells in use that touch, each pair once; a cell also touches itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, far = [], []
            for i, cell in enumerate(batch.column(3).to_pylist()):
                at = np.frombuffer(cell, "<i4")
                half = [d for d in product((-1, 0, 1), repeat=len(at)) if d >= (0,) * len(at)]
                far.extend((at + np.array(d, "<i4")).astype("<i4").tobytes() for d in half)
                which.extend([i] * len(half))
            rows = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(far, pa.binary())], ["label", "dim", "block", "near", "far"])

    asked = cells.mapInArrow(run, "label string, dim int, block int, near binary, far binary")
    return asked.join(cells.withColumnRenamed("cell", "far"), ["label", "dim", "block", "far"], "left_semi")


def _search(rows: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, a, b): links of members, by task; or with a null cid a link (a, b) that joins what the task held apart."""
    key = ["label", "dim", "block", "near", "far", "i", "j"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "side", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, key):
            dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
            bounds = _bounds(dim, BLOCKS)
            reach = _reach(threshold, bounds) ** 2
            side = table.column("side").to_numpy()
            within = table.column("near")[0] == table.column("far")[0] and table.column("i")[0] == table.column("j")[0]
            x = np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(-1, dim)
            units, norms = _units(x)
            turned = _turned(units, 0, bounds[block + 1])
            own = turned[:, bounds[block] :]
            cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
            left = np.arange(len(cid)) if within else np.flatnonzero(side == 0)
            right = left if within else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            links, top, joined = np.zeros(len(cid), np.int64), list(range(len(cid))), []

            def root(q: int, top: list[int] = top) -> int:
                while top[q] != q:
                    top[q] = top[top[q]]
                    q = top[q]
                return q

            for at in range(0, len(left), 256):
                mine = left[at : at + 256]
                p, q = np.nonzero(_near(own[mine], own[right]) <= reach[block])
                p, q = mine[p], right[q]
                if within:
                    p, q = p[p < q], q[p < q]
                for b in range(block + 1):  # a pair counts in the first block within reach
                    part = slice(bounds[b], bounds[b + 1])
                    hit = np.concatenate([((turned[p[s : s + 65536], part] - turned[q[s : s + 65536], part]) ** 2).sum(axis=1) <= reach[b] for s in range(0, len(p), 65536)] or [np.empty(0, bool)])
                    p, q = (p[hit], q[hit]) if b == block else (p[~hit], q[~hit])
                for s in range(0, len(p), 65536):
                    a, b = p[s : s + 65536], q[s : s + 65536]
                    good = (x[a] * x[b]).sum(axis=1) / (norms[a] * norms[b]) >= threshold
                    a, b = a[good], b[good]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    for u, v in zip(a.tolist(), b.tolist(), strict=True):
                        if root(u) != root(v):
                            top[root(u)] = root(v)
                            joined.append((u, v))
            some = np.flatnonzero(links)
            if len(some):
                pairs = cid[np.array(joined, np.int64)].reshape(-1, 2)
                none, extra = [None] * len(some), len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(cid[some]), pa.nulls(extra, pa.int64())]), pa.concat_arrays([pa.array(links[some]), pa.nulls(extra, pa.int64())]),
                        pa.concat_arrays([pa.array(none, pa.int64()), pa.array(pairs[:, 0])]), pa.concat_arrays([pa.array(none, pa.int64()), pa.array(pairs[:, 1])]),
                    ],
                    ["cid", "links", "a", "b"],
                )

    return rows.mapInArrow(run, "cid long, links long, a long, b long")


def _near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances less some room for the rounding of the product form; what passes is judged by differences."""
    return (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * (u @ v.T) - 1e-12


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows are compared if their labels are equal and not null (all rows if
    ``label_col`` is None) and their vectors are as long. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing,
    nor do rows with a null label. Repeated rows are links of each other; a
    null id is never the smallest unless a component has no other. Other
    columns are not carried. An empty table gives no rows.
    """
    label = F.lit("") if label_col is None else vectors[label_col].cast("string")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scaled(v) for v in batch.column(2).to_pylist()]
            dims, raw = [None if v is None else len(v) for v in found], [None if v is None else v.tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "vector"])

    whole = rows.mapInArrow(scaled, "id long, label string, dim int, vector binary")
    able = F.col("label").isNotNull() & F.col("vector").isNotNull()
    whole = materialise(whole.withColumn("class", F.when(able, F.md5("vector"))), "vectors")
    classes = whole.where(F.col("class").isNotNull()).groupBy("label", "dim", "vector", "class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    grid = F.least(F.greatest(F.ceil(F.log(F.count(F.lit(1)) / CHUNK) / float(np.log(_SPREAD))), F.lit(1)), F.lit(MAX_GRID)).cast("int")
    grids = classes.groupBy("label", "dim").agg(grid.alias("grid"))
    members = materialise(_cells(classes.join(grids, ["label", "dim"]), threshold), "cells")
    place = ["label", "dim", "block"]
    sizes = members.groupBy(*place, "cell").agg(F.count(F.lit(1)).alias("size")).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    near = sizes.select(*place, F.col("cell").alias("near"), F.col("size").alias("n"), F.col("chunks").alias("n_near"))
    far = sizes.select(*place, F.col("cell").alias("far"), F.col("chunks").alias("n_far"))
    tasks = _touching(sizes.select(*place, "cell")).join(near, [*place, "near"]).join(far, [*place, "far"])
    tasks = materialise(tasks.where("near <> far OR n > 1").drop("n"), "tasks")
    # chunk i of the near cell meets chunk j of the far one; within one cell, i <= j
    own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    dealt = members.join(sizes, [*place, "cell"]).select(*place, "cell", "cid", own.alias("own"))
    one = F.col("near") == F.col("far")
    left = dealt.withColumnRenamed("cell", "near").join(tasks, [*place, "near"])
    partners = F.sequence(F.when(one, F.col("own")).otherwise(F.lit(0)), F.col("n_far") - 1)
    left = left.select(*place, "near", "far", F.col("own").alias("i"), F.explode(partners).alias("j"), F.lit(0).alias("side"), "cid")
    right = dealt.withColumnRenamed("cell", "far").join(tasks, [*place, "far"]).where(~one | (F.col("own") > 0))
    partners = F.sequence(F.lit(0), F.when(one, F.col("own") - 1).otherwise(F.col("n_near") - 1))
    right = right.select(*place, "near", "far", F.explode(partners).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "cid")
    found = materialise(_search(left.union(right).join(classes.select("cid", "copies", "vector"), "cid"), threshold), "links")

    counts = found.where("cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.where("cid IS NULL").select("a", "b"))
    lows = parts.join(classes.select("cid", "low"), parts["node"] == F.col("cid")).select("cid", "label", "low")
    lows = lows.join(lows.groupBy("label").agg(F.min("low").alias("lowest")), "label").select("cid", "lowest")
    told = classes.join(counts, "cid", "left").join(lows, "cid", "left")
    told = told.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("class").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("lowest"))
    same = (whole["label"] == told["l"]) & (whole["dim"] == told["d"]) & (whole["class"] == told["c"])
    out = whole.select("id", "label", "dim", "class").join(told, same, "left")
    alone = F.col("c").isNull()
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("lowest")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"))
