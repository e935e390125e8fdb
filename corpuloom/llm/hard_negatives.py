"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

The scores of anchors with rows are a matrix product of whole numbers. Both
sides are dealt into blocks of rows, and dimensions into chunks:

1. Every pair of an anchor block and a row block is a tile, and every chunk of
   it a task's work: the anchors' and the rows' columns of one chunk meet there
   and give partial scores, exact 64-bit integers, sent in the narrowest
   integer type that holds them.
2. Partial scores are shuffled by tile and added up.
3. A finished tile is reduced at once to its own best few rows for every
   window, and only these go on to the final ranking of each window.

This runs twice. Positives have their anchor's label, so the first run deals
anchors and rows out by label and multiplies only blocks that share a group of
labels. Each of an anchor's positives opens a window of scores, and the second
run, over all pairs of blocks, ranks the rows of other labels within it.

A block has a bounded number of rows whatever its label, so neither a label of
a third of all rows nor a crowd of copies makes a task larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, groups, materialise, whole

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Rows of a block, anchors of a block, dimensions of a chunk, and most chunks.
ROWS, ANCHORS, DIMS, MAX_CHUNKS = 1024, 256, 32, 8
#: Most groups that labels are hashed into; the table of their sizes is broadcast.
MAX_GROUPS = 1 << 16
#: Largest squared norm: a hundred times any score fits 64 bits.
LIMIT = 1 << 56
_TILE = ["grp", "bi", "bj"]
_PARTIAL = "grp int, bi int, bj int, k int, uid long, id long, label string, windows array<long>, ids array<long>, uids array<long>, labels array<string>, scores binary"


def _rows(vectors: DataFrame, anchor: Column, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(uid, id, label, anchor, dim, vector) of the rows that take part."""
    kept = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vectors[vector_col].cast("array<double>").alias("v")).where("label IS NOT NULL AND v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [whole(v, scale, LIMIT) for v in batch.column(3).to_pylist()]
            some = [i for i, v in enumerate(found) if v is not None]
            dims, raw = pa.array([len(found[i]) for i in some], pa.int32()), pa.array([found[i].astype("<i4").tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some, pa.int64())).columns[:3], dims, raw], ["id", "label", "anchor", "dim", "vector"])

    return kept.mapInArrow(run, "id long, label string, anchor boolean, dim int, vector binary").withColumn("uid", F.monotonically_increasing_id())


def _pieces(rows: DataFrame, anchors: DataFrame, n_groups: int, width: int, chunks: int) -> DataFrame:
    """(grp, bi, bj, k, side, uid, id, label, windows, piece): every block's chunks, one copy for each tile that they are in."""
    group = F.pmod(F.xxhash64("label"), F.lit(n_groups)).cast("int").alias("grp")
    a, b = anchors.withColumn("grp", group), rows.withColumn("grp", group)
    counts = b.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(a.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp")
    blocks = F.broadcast(counts.select("grp", F.ceil(F.col("n") / ROWS).cast("int").alias("nj"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("ni")))  # n_groups rows at most
    of = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["grp", "bi", "bj", "side", "uid", "id", "label", "windows", "vector"]
    left = a.join(blocks, "grp").withColumn("bi", of("ni")).withColumn("bj", upto("nj")).withColumn("side", F.lit(0)).select(columns)
    right = b.withColumn("windows", F.lit(None).cast("array<long>")).join(blocks, "grp").withColumn("bj", of("nj")).withColumn("bi", upto("ni")).withColumn("side", F.lit(1)).select(columns)
    every = left.unionByName(right).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    first = F.col("k") == 0  # what isn't a number goes with the first chunk alone
    piece = F.expr(f"substring(vector, k * {4 * width} + 1, {4 * width})")
    return every.select(*_TILE, "k", "side", "uid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("label")).alias("label"), F.when(first, F.col("windows")).alias("windows"), piece.alias("piece"))


def _matrix(pieces: list[bytes], width: int) -> np.ndarray:
    """One row a piece; what a shorter vector lacks is 0."""
    return np.frombuffer(b"".join(p.ljust(4 * width, b"\0") for p in pieces), "<i4").reshape(-1, width).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in double precision where no sum can pass 2^53, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _narrow(scores: np.ndarray) -> bytes:
    low, high = int(scores.min()), int(scores.max())
    return scores.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // n}").astype(np.int64)


def _tiles(rows: DataFrame, anchors: DataFrame, n_groups: int, dims: int, reduce: Callable, schema: str) -> DataFrame:
    """What ``reduce`` makes of every finished tile: of its anchors (dicts), their scores, and its rows' ids, uids and labels."""
    width = max(DIMS, -(-dims // MAX_CHUNKS))
    chunks = max(1, -(-dims // width))
    key = [*_TILE, "k"]
    pieces = _pieces(rows, anchors, n_groups, width, chunks).repartition(*key).sortWithinPartitions(*key, "side", "uid")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
        names = [c.split()[0] for c in _PARTIAL.split(", ")]
        for table in groups(batches, key):
            grp, bi, bj, k = (table.column(c)[0].as_py() for c in key)
            m = int((table.column("side").to_numpy() == 0).sum())
            if not m or m == table.num_rows:
                continue
            pieces = table.column("piece").to_pylist()
            part = product(_matrix(pieces[:m], width), _matrix(pieces[m:], width))
            uid, ids, labels, windows = (table.column(c).to_pylist() for c in ("uid", "id", "label", "windows"))
            out = [(grp, bi, bj, k, uid[i], ids[i], labels[i], windows[i], None, None, None, _narrow(part[i])) for i in range(m)]
            if k == 0:  # one row tells what the tile's columns are
                out.insert(0, (grp, bi, bj, k, None, None, None, None, ids[m:], uid[m:], labels[m:], None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    partial = pieces.mapInArrow(multiply, _PARTIAL).repartition(*_TILE).sortWithinPartitions(*_TILE, F.asc_nulls_first("uid"), "k")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _TILE):
            held = table.to_pylist()
            head = held[0]
            n, found, scores = len(head["ids"]), [], []
            for r in held[1:]:
                part = _wide(r["scores"], n)
                if r["k"] == 0:
                    found.append(r)
                    scores.append(part.copy())
                else:
                    scores[-1] += part
            made = reduce(found, scores, np.array([x is None for x in head["ids"]]), np.array([x or 0 for x in head["ids"]], np.int64), np.array(head["uids"], np.int64), np.array(head["labels"], object))
            if made is not None:
                yield made

    return partial.mapInArrow(finish, schema)


def _best(some: np.ndarray, scores: np.ndarray, none: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the rows ``some``: larger scores, then smaller ids, null ids last."""
    if len(some) > k:
        s = scores[some]
        some = some[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return some[np.lexsort((uids[some], ids[some], none[some], -scores[some]))][:k]


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    Anchors are the rows that ``anchor`` holds of. An anchor's positives are its
    ``positives`` best other rows of its label, its negatives for one of these
    the ``negatives`` best rows of other labels with scores between ``low`` and
    ``high`` percent of the positive's. A positive without any gives no row.

    Rows with a null label (``label``; by default the column of that name), a
    null or empty vector, a null or non-finite component, or scaled components
    of a squared norm over 2^56 take no part. What a shorter vector lacks counts
    as 0. Every row stands for itself: repeated rows are each other's positives,
    and repeated anchors give their rows each. A null id is no anchor's by a
    condition on ids, and comes last among ties. Other columns are not carried.
    An empty table gives no rows.
    """
    rows = materialise(_rows(vectors, anchor, id_col, vector_col, vectors["label"] if label is None else label, scale), "rows")
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    own = rows.where("anchor").select("uid", "id", "label", "vector")

    def same(found: list[dict], scores: list[np.ndarray], none: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
        out = []
        for a, s in zip(found, scores, strict=True):
            some = np.flatnonzero((labels == a["label"]) & (uids != a["uid"]))
            out.extend((a["uid"], None if none[j] else int(ids[j]), int(uids[j]), int(s[j])) for j in _best(some, s, none, ids, uids, positives))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["anchor", "positive_id", "positive", "score"])

    no_windows = own.withColumn("windows", F.lit(None).cast("array<long>"))
    best = _tiles(rows, no_windows, max(1, min(MAX_GROUPS, -(-n // ROWS))), dims, same, "anchor long, positive_id long, positive long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive")
    best = materialise(best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "positives")
    # an anchor's windows are its positives' scores, in their order
    scores = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("windows"))
    asked = own.join(scores, own["uid"] == F.col("anchor")).drop("anchor")

    def other(found: list[dict], scores: list[np.ndarray], none: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
        out = []
        for a, s in zip(found, scores, strict=True):
            able = labels != a["label"]
            for place, p in enumerate(a["windows"], 1):
                some = np.flatnonzero(able & (100 * s >= low * p) & (100 * s <= high * p))
                out.extend((a["uid"], a["id"], place, None if none[j] else int(ids[j]), int(uids[j]), int(s[j])) for j in _best(some, s, none, ids, uids, negatives))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["anchor", "anchor_id", "place", "negative_id", "negative", "negative_score"])

    near = _tiles(rows, asked, 1, dims, other, "anchor long, anchor_id long, place int, negative_id long, negative long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    told = near.join(best.withColumnRenamed("score", "positive_score"), ["anchor", "place"])
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)
