"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors become whole numbers and are cut into parts; each part position has a
codebook. A part's nearest entry lies within a ring: if some entry is at
distance d, an entry nearer than that has a norm within d of the part's own. So
entries are sorted by norm, and

1. a binary search finds the entry of the nearest norm; its distance is the
   first best one;
2. a binary search finds the interval of entries whose norms the best distance
   allows, ends included, for an entry on the edge may tie;
3. the entries of the interval are measured exactly in 64-bit integers,
   outwards from the first, and whenever one is better the interval shrinks.

A round of training is one pass: every task gives the sums and counts of its
own parts by position and entry, and only these are shuffled and added up. The
codebooks, parts x entries rows, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, whole

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest squared norm of a scaled vector whose squared errors are exact in 64 bits.
LIMIT = 1 << 58
_SALTS = 32


def _bounds(dim: int, parts: int) -> list[int]:
    """Where parts begin and end: equal ones, or as near as whole numbers are."""
    return [i * dim // parts for i in range(parts + 1)]


class Rings:
    """A codebook sorted by norm; entries keep their own indexes."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
        self.order = np.lexsort((np.arange(len(entries)), norms))
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, ties to the lower index."""
        norms, n = np.sqrt((x * x).sum(axis=1).astype(np.float64)), len(self.norms)
        after = np.searchsorted(self.norms, norms).clip(0, n - 1)
        before = (after - 1).clip(0)
        start = np.where(np.abs(norms - self.norms[before]) < np.abs(self.norms[after] - norms), before, after)
        best, place = self._distance(x, start), start.copy()
        low, high = self._ring(norms, best)
        for step in range(1, n):
            for side in (-step, step):
                at = start + side
                rows = np.flatnonzero((at >= low) & (at < high))
                if not len(rows):
                    continue
                d, to = self._distance(x[rows], at[rows]), at[rows]
                won = (d < best[rows]) | ((d == best[rows]) & (self.order[to] < self.order[place[rows]]))
                rows, d, to = rows[won], d[won], to[won]
                best[rows], place[rows] = d, to
                low[rows], high[rows] = self._ring(norms[rows], d)
            if not ((start - step > low) | (start + step + 1 < high)).any():
                break
        return self.order[place], best

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.measured += len(at)
        away = x - self.entries[at]
        return (away * away).sum(axis=1)

    def _ring(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of entries whose norms are within the best distance, with room for the rounding of roots."""
        reach = np.sqrt(best.astype(np.float64))
        room = (norms + reach + 1) * 1e-12
        return np.searchsorted(self.norms, norms - reach - room, "left"), np.searchsorted(self.norms, norms + reach + room, "right")


def _columns(batch: pa.RecordBatch, at: int, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _trained(vectors: DataFrame, books: list[np.ndarray], dim: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; entries that no part takes stay."""
    bounds = _bounds(dim, len(books))
    wide = max(b - a for a, b in zip(bounds, bounds[1:], strict=False))

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], now: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            rings = [Rings(b) for b in now]
            total, count = [np.zeros_like(b) for b in now], [np.zeros(len(b), np.int64) for b in now]
            for batch in batches:
                x = _columns(batch, 0, dim)
                for p, ring in enumerate(rings):
                    part = x[:, bounds[p] : bounds[p + 1]]
                    index, _ = ring.nearest(part)
                    np.add.at(total[p], index, part)
                    count[p] += np.bincount(index, minlength=len(now[p]))
            found = [(p, e, int(n), np.pad(total[p][e], (0, wide - total[p].shape[1])).tolist()) for p, c in enumerate(count) for e, n in enumerate(c) if n]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

        told = vectors.select("vector").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        told = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide)])
        books = [b.copy() for b in books]
        for r in told.collect():  # one row a codebook entry at most
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books[r["part"]].shape[1])]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every usable row.

    Rows whose vector is null or holds a null or non-finite component are
    dropped. Codebooks begin with the vectors of the ``entries`` smallest ids
    (nulls last, equal ids by their vectors), fewer if there are fewer rows.
    All vectors should be as long as the first of these; where a length isn't a
    multiple of ``parts``, parts are as equal as can be. A row has a null code
    and error, and counts in nothing, if its vector is empty or of another
    length, or if the squared norm of its scaled components passes 2^58. Repeated rows are coded
    alike, one row each; a null label is a label. Other columns are not
    carried. An empty table gives no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [whole(v, scale, LIMIT) for v in batch.column(2).to_pylist()]
            dims, raw = [None if v is None else len(v) for v in found], [None if v is None else v.astype("<i4").tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "vector"])

    kept = materialise(rows.mapInArrow(scaled, f"id {kind}, label string, dim int, vector binary"), "codes-in")
    first = kept.where("dim IS NOT NULL").orderBy(F.asc_nulls_last("id"), "dim", "vector").limit(entries).collect()  # the codebooks' first entries
    dim = first[0]["dim"] if first else 0
    start = [np.frombuffer(r["vector"], "<i4").astype(np.int64) for r in first if r["dim"] == dim]
    bounds = _bounds(dim, parts)
    books = [np.array([v[bounds[p] : bounds[p + 1]] for v in start], np.int64).reshape(len(start), bounds[p + 1] - bounds[p]) for p in range(parts)]
    same = F.coalesce(F.col("dim") == dim, F.lit(False))
    books = _trained(kept.where(same), books, dim, rounds) if start else books

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Rings(b) for b in books]
        for batch in batches:
            x = _columns(batch, 2, dim)
            found = [ring.nearest(x[:, bounds[p] : bounds[p + 1]]) for p, ring in enumerate(rings)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8 if entries <= 256 else ">u2")
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in index], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    coded = kept.where(same).select("id", "label", "vector").mapInArrow(assigned, f"id {kind}, label string, code string, error long")
    others = kept.where(~same).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialise(coded.unionByName(others) if start else others, "codes")
    # totals come to every row by its label; a label of very many rows is dealt over salts
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumnRenamed("label", "of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(_SALTS)).cast("int"))
    out = salted.join(totals, (salted["salt"] == totals["salt"]) & F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(documents(spark, sf_dir, "embeddings"))
