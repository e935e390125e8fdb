"""Mixing sources to target weights by Pfair scheduling.

A source of target share w (an exact fraction of the whole) is a task: its i-th
block (from 0) is released at slot floor(i / w) and due by slot
ceil((i + 1) / w). Earliest-deadline-first over the released blocks meets every
deadline, so after any number of slots each source is within less than one
block of its share, however small or large that is. Releases and deadlines are
compared as whole numbers of any size: nothing is rounded, and no target is
raised or lowered.

Slots follow each other, so the driver lays them out, and their number is
bounded: a block has :data:`BLOCK_ROWS` rows, or as many more as keep the
schedule within :data:`MAX_SLOTS` blocks. Every block's slot, four bytes each,
is what is broadcast.

When a source runs out, the others go on by their weights among themselves in
a new phase, so no row is dropped; there are at most as many phases as
sources.
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Rows of a block at least, and most blocks of a schedule: in larger tables, blocks grow.
BLOCK_ROWS, MAX_SLOTS = 16, 1 << 20
#: Most sources, and so most phases; more are refused. Their counts are gathered at the driver.
MAX_SOURCES = 1000
#: Exponent on a source's row count that gives its weight where none is named: 1 keeps the natural mix, 0 makes all equal.
TEMPER = 0.7
_CHUNK = 4096


def deal(weights: dict[str, float], left: dict[str, int]) -> list[str]:
    """The source of each slot, earliest deadline first, until one of the sources has none of its ``left`` blocks any more."""
    names = sorted(left)
    exact = [Fraction(weights[s]) for s in names]
    apart = [sum(exact) / w for w in exact]  # slots from one block to the next
    up, down, rest = [x.numerator for x in apart], [x.denominator for x in apart], [left[s] for s in names]
    ready: list[tuple[int, int, int]] = []  # (deadline, release, source)
    waiting = [(0, k) for k in range(len(names))]
    taken, slots = [0] * len(names), []
    while True:
        while waiting and waiting[0][0] <= len(slots):
            release, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(taken[k] + 1) * up[k] // down[k]), release, k))
        due, _, k = heapq.heappop(ready)
        if len(slots) >= due:
            raise AssertionError("EDF meets every deadline")
        slots.append(names[k])
        taken[k] += 1
        if taken[k] == rest[k]:
            return slots
        heapq.heappush(waiting, (taken[k] * up[k] // down[k], k))


def plan(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """The slot of each block of every source; all slots together have no gap."""
    left = {s: n for s, n in blocks.items() if n}
    found: dict[str, list[int]] = {s: [] for s in left}
    at = 0
    while left:
        for s in deal(weights, left):
            found[s].append(at)
            left[s] -= 1
            at += 1
        left = {s: n for s, n in left.items() if n}
    return {s: np.array(x, np.int32) for s, x in found.items()}


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id_col, source, target, block, slot, position) of every row.

    ``target`` is the source's target share of the mix: its named weight, or
    where none is named its rows to the power :data:`TEMPER`, over the sum.

    ``block`` counts the source's blocks of ``block_rows`` rows (more beyond
    :data:`MAX_SLOTS` blocks) in ascending id order, ``slot`` is the block's
    place in the whole schedule and ``position`` the row's place (slot * rows of
    a block + place in its block). A null source counts as ''. Rows with a null
    id come first in their source; rows that repeat an id stand side by side,
    and a crowd of such rows is dealt over tasks like any others. An empty table
    gives no rows. A source without a named weight, and a weight that isn't
    above 0 and finite, are refused.

    Ranking a source of any size takes no single task: rows are dealt by
    ranges of (source, id), ranked within their range, and moved on by the
    counts of the ranges before it.
    """
    return _schedule(docs, weights, block_rows, id_col, source_col).drop("tie")


def _schedule(docs: DataFrame, weights: dict[str, float] | None, block_rows: int, id_col: str, source_col: str, tie: Column | None = None) -> DataFrame:
    """As :func:`schedule`, with ``tie``, which orders rows of one source and id."""
    spark = docs.sparkSession
    tie = F.lit(0).cast("long") if tie is None else tie
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), tie.alias("tie"), F.monotonically_increasing_id().alias("row"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "source", "id", "tie", "row").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged.select("part", "source", "id", "tie", "row"), "mixing")  # a part's number must not change between the two uses
    if (found := ranged.select("source").distinct().limit(MAX_SOURCES + 1).count()) > MAX_SOURCES:  # told before any is gathered
        raise ValueError(f"{found} sources or more; {MAX_SOURCES} at most")
    sizes = ranged.groupBy("source", "part").count().collect()  # at most sources + partitions rows
    counts: dict[str, int] = {}
    before: dict[tuple[str, int], int] = {}
    for source, part, count in sorted(sizes):
        before[source, part] = counts.get(source, 0)
        counts[source] = counts.get(source, 0) + count
    weights = {s: c**TEMPER for s, c in counts.items()} if weights is None else weights
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"sources without a weight: {missing[:5]}")
    if bad := sorted(s for s in counts if not (weights[s] > 0 and isfinite(weights[s]))):
        raise ValueError(f"weights that aren't above 0: {bad[:5]}")
    kind = rows.schema["id"].dataType.simpleString()
    if not counts:
        return spark.createDataFrame([], f"{id_col} {kind}, source string, target double, block long, slot long, position long, tie long")
    size = max(block_rows, -(-sum(counts.values()) // MAX_SLOTS))
    slots = plan({s: -(-c // size) for s, c in counts.items()}, weights)
    starts = spark.createDataFrame([(s, p, b) for (s, p), b in before.items()], "source string, part int, before long")
    whole = sum(Fraction(weights[s]) for s in counts)
    pieces = [(s, float(Fraction(weights[s]) / whole), at // _CHUNK, x[at : at + _CHUNK]) for s, x in slots.items() for at in range(0, len(x), _CHUNK)]
    columns = [pa.array([p[i] for p in pieces], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int32())))]
    places = spark.createDataFrame(pa.table(columns, ["source", "target", "chunk", "slots"]))  # MAX_SLOTS + MAX_SOURCES slots at most
    local = F.row_number().over(Window.partitionBy("part", "source").orderBy("id", "tie", "row")) - 1
    ranked = ranged.withColumn("local", local).join(F.broadcast(starts), ["source", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local")).withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    placed = ranked.withColumn("chunk", F.floor(F.col("block") / _CHUNK).cast("long")).join(F.broadcast(places), ["source", "chunk"])
    placed = placed.withColumn("slot", F.get("slots", (F.col("block") % _CHUNK).cast("int")).cast("long"))
    return placed.select(F.col("id").alias(id_col), "source", "target", "block", "slot", (F.col("slot") * size + F.col("rank") % size).alias("position"), "tie")


def placed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and position, from 0, of the rows of a table that was written in order to Parquet files.

    Reading deals out files by size, so rows come in another order than they
    were written. Their order is that of the writers' tasks, the numbers in
    the files' names, and within a file that of its rows. One row for each
    file reaches the driver.
    """
    spark, meta = docs.sparkSession, docs.metadataColumn("_metadata")
    rows = docs.select(*[docs[c] for c in columns], meta["file_path"].alias("__file"), meta["row_index"].alias("__row"))
    before, starts = 0, []
    numbers = lambda f: [int(x) for x in re.fullmatch(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.\w+)*", f.rsplit("/", 1)[1]).groups("0")]
    for file, n in sorted(rows.groupBy("__file").count().collect(), key=lambda r: numbers(r[0])):
        starts.append((file, before))
        before += n
    starts = spark.createDataFrame(starts, "__file string, __before long")
    return rows.join(F.broadcast(starts), "__file").select(*columns, (F.col("__before") + F.col("__row")).alias("position"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with all their columns, in the order of the schedule.

    The table is dealt by ranges of the position and sorted, so its files in
    turn are the mix. Rows that share an id and a source take their places in
    the order of their texts' hashes; those with equal texts as well are told
    apart by their number alone, one task for each such text.
    """
    hashed = F.xxhash64(F.col(f"`{text_col}`"))
    places = _schedule(docs, weights, BLOCK_ROWS, id_col, source_col, hashed)
    nth = F.row_number().over(Window.partitionBy("__i", "__s", "__t").orderBy("__position"))
    places = places.select(F.col(id_col).alias("__i"), F.col("source").alias("__s"), F.col("tie").alias("__t"), F.col("position").alias("__position")).withColumn("__n", nth)
    own = F.row_number().over(Window.partitionBy(id_col, "__source", "__hash").orderBy(text_col))
    rows = docs.withColumn("__source", F.coalesce(docs[source_col].cast("string"), F.lit(""))).withColumn("__hash", hashed).withColumn("__own", own)
    same = F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__source") == F.col("__s")) & (F.col("__hash") == F.col("__t")) & (F.col("__own") == F.col("__n"))
    joined = rows.join(places, same)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(n, "__position").sortWithinPartitions("__position").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(documents(spark, sf_dir))
