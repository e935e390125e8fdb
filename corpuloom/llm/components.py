"""Connected components of a link table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

#: Nodes that a task remembers at most while it thins links, and most links that one task solves at the end.
REMEMBERED, ALONE = 1 << 20, 1 << 17
_HALF = 0xFFFFFFFF


class _Union:
    """Nodes joined to trees; a tree's root is its least node."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = self.top
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.top[max(a, b)] = min(a, b)
        return a != b


def forest(links: DataFrame) -> DataFrame:
    """(u, v): links that keep connected what ``links`` (u, v) connect.

    Every task keeps those of its links that join what they left apart; links
    are dealt by v, so a node that is v of many links costs one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Union()
        for batch in batches:
            joined = [seen.join(u, v) for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(joined, pa.bool_()))
            if len(seen.top) > REMEMBERED:
                seen = _Union()

    return links.repartition("v").mapInArrow(run, "u long, v long")


def _solved(links: DataFrame) -> DataFrame:
    """(node, label) of at most :data:`ALONE` links, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Union()
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.join(u, v)
        nodes = list(seen.top)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([seen.root(x) for x in nodes], pa.int64())], ["node", "label"])

    return links.repartition(1).mapInArrow(run, "node long, label long")


def _renamed(x: Column, turn: int) -> Column:
    """Another name of a node, one to one, in an order of its own each turn: two steps of a Feistel network."""
    left, right = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_HALF))
    for step in (2 * turn, 2 * turn + 1):
        left, right = right, left.bitwiseXOR(F.hash(right, F.lit(step)).cast("long").bitwiseAND(F.lit(_HALF)))
    return F.shiftleft(left, 32).bitwiseOR(right)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (long columns a, b) reaches.

    Links are thinned by every task to those that join something. While more
    than :data:`ALONE` are left, a turn contracts them: every node goes over to
    the least of itself and its neighbours, that one's least and that one's
    again, in an order of names that is drawn anew each turn, so a turn leaves
    a fraction of the nodes; links between these go on, thinned again. The few
    links at the end are one task's. Tables are written to the shared folder,
    so lineage is short, and nothing passes through the driver but the number
    of links left. A link with a null end joins nothing. Nodes without a link
    to another are absent; an empty table gives no rows.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialise(forest(edges), "edges")
    first, old, steps = edges, [], []
    while edges.count() > ALONE:
        turn = len(steps)
        named = edges.select(_renamed(F.col("u"), turn).alias("u"), _renamed(F.col("v"), turn).alias("v"))
        least = named.union(named.select("v", "u")).groupBy("u").agg(F.min("v").alias("v"))
        least = materialise(least.select("u", F.least("u", "v").alias("to")), "least")
        second, third = (least.select(F.col("u").alias(f"u{i}"), F.col("to").alias(f"to{i}")) for i in (2, 3))
        step = least.join(second, F.col("to") == F.col("u2")).join(third, F.col("to2") == F.col("u3"))
        steps.append(materialise(step.select("u", F.col("to3").alias("to")), "step"))
        left, right = (steps[-1].select(F.col("u").alias(f"{c}0"), F.col("to").alias(f"{c}1")) for c in "ab")
        moved = named.join(left, F.col("u") == F.col("a0")).join(right, F.col("v") == F.col("b0"))
        moved = moved.select(F.least("a1", "b1").alias("u"), F.greatest("a1", "b1").alias("v")).where("u <> v")
        old += [edges, least]
        edges = materialise(forest(moved), "edges")
    if not steps:
        labels = materialise(_solved(edges), "labels")
        drop_table(edges)
        return labels
    nodes = first.select("u").union(first.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("now"))
    for turn, step in enumerate(steps):
        nodes = nodes.withColumn("now", _renamed(F.col("now"), turn)).join(step.withColumnRenamed("u", "at"), F.col("now") == F.col("at"), "left")
        nodes = nodes.select("node", F.coalesce("to", "now").alias("now"))
    last = _solved(edges).withColumnRenamed("node", "at")
    nodes = nodes.join(last, F.col("now") == F.col("at"), "left").select("node", F.coalesce("label", "now").alias("now"))
    nodes = materialise(nodes, "nodes")
    lows = nodes.groupBy("now").agg(F.min("node").alias("label"))
    labels = materialise(nodes.join(lows, "now").select("node", "label"), "labels")
    for table in (*old, edges, *steps, nodes):
        drop_table(table)
    return labels
