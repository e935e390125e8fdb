"""Digests of a tree by folder, and what changed between two trees.

A folder has a digest of its own entries and one of all folders below it and
itself. Two trees with equal digests of a folder are alike there, so a comparison
goes down into unequal folders only, level by level, and reads the entries of
those whose own digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary
from . import paths


def _name(raw: Column) -> Column:
    """A path's bytes as a string of one character each, so that none is lost."""
    return F.decode(raw, "ISO-8859-1")


def _parent(name: Column) -> Column:
    return F.regexp_replace(name, "(?s)/?[^/]*$", "")


def _combined(rows: DataFrame, by: str, limbs: Column) -> DataFrame:
    """(by, n, digest): XOR and sum of the limbs of each group, alike in whatever order they come."""
    parts = rows.select(by, limbs.alias("l")).groupBy(by)
    xors = [F.bit_xor(F.get("l", F.lit(i))).alias(f"x{i}") for i in range(8)]
    sums = [F.sum(F.get("l", F.lit(i))).alias(f"s{i}") for i in range(8)]
    told = F.sha2(F.concat_ws("|", "n", *[f"x{i}" for i in range(8)], *[f"s{i}" for i in range(8)]), 256)
    return parts.agg(F.count(F.lit(1)).alias("n"), *xors, *sums).select(by, "n", told.alias("digest"))


def folders(entries: DataFrame) -> DataFrame:
    """(folder, parent, n, own, tree) of every folder that has entries or is one: its entries, their digest, and the digest of all below.

    ``folder`` is the path's bytes, a character each, '' for the root; a
    folder's time counts in no digest, its own name in its parent's. Two
    shuffles, whatever the depth: entries are added up by folder, folders by
    each folder that they lie in. The entries' digests are made once, when this
    is called.
    """
    limbs = binary.entry_limbs("raw", "kind", "size", "mtime")
    rows = entries.select(_parent(_name(F.col("raw"))).alias("folder"), limbs.alias("d")).select("folder", F.array(*[F.col(f"d.l{i}") for i in range(8)]).alias("limbs"))
    own = paths.written(_combined(rows, "folder", F.col("limbs")), "folders")  # read thrice below
    empty = entries.where("kind = 'dir'").select(_name(F.col("raw")).alias("folder")).join(own.select("folder"), "folder", "left_anti").distinct()
    own = own.unionByName(empty.select("folder", F.lit(0).cast("long").alias("n"), F.lit("").alias("digest")))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = own.select(F.explode(above).alias("top"), F.sha2(F.concat_ws("|", "folder", "digest"), 256).alias("d"))
    tree = _combined(spread, "top", binary.hash_limbs(F.col("d"))).select(F.col("top").alias("folder"), F.col("digest").alias("tree"))
    both = tree.join(own.withColumnRenamed("digest", "own"), "folder", "left")
    return both.select("folder", F.when(F.col("folder") != "", _parent(F.col("folder"))).alias("parent"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("own", F.lit("")).alias("own"), "tree")


def unequal(a: DataFrame, b: DataFrame) -> tuple[DataFrame, int]:
    """((folder) of folders whose own entries differ, folders read) of two tables of :func:`folders`.

    Each level is a join of the children of the unequal folders of the level
    above; a tree of depth d takes d + 1 of them. Folders with equal digests are
    not gone into.
    """
    left, right = (t.select(F.col("folder").alias(f"f{s}"), F.col("parent").alias(f"p{s}"), F.col("own").alias(f"o{s}"), F.col("tree").alias(f"t{s}")) for t, s in ((paths.written(a, "folders"), "1"), (paths.written(b, "folders"), "2")))  # each level reads them
    found, read = [], 0
    at = a.sparkSession.createDataFrame([(None,)], "at string")
    while True:
        near, far = (t.join(at, t[p].eqNullSafe(at["at"]), "left_semi") for t, p in ((left, "p1"), (right, "p2")))
        level = near.join(far, F.col("f1") == F.col("f2"), "full").select(F.coalesce("f1", "f2").alias("folder"), (~F.col("t1").eqNullSafe(F.col("t2"))).alias("differs"), (~F.col("o1").eqNullSafe(F.col("o2"))).alias("own"))
        level = paths.written(level, "level")
        n, more = level.agg(F.count(F.lit(1)), F.count_if("differs")).first()
        read += n
        found.append(level.where("own").select("folder"))
        if not more:
            break
        at = level.where("differs").select(F.col("folder").alias("at"))
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    return whole, read


def changed(a: DataFrame, b: DataFrame, where: DataFrame) -> DataFrame:
    """(raw, change) of the entries of two trees in the folders ``where``: added, removed or changed."""
    left, right = (t.withColumn("folder", _parent(_name(F.col("raw")))).join(where, "folder", "left_semi").select(F.col("raw").alias(f"raw{s}"), F.struct("kind", "size", F.when(F.col("kind") != "dir", F.col("mtime")).alias("mtime")).alias(f"e{s}")) for t, s in ((a, "1"), (b, "2")))
    both = left.join(right, F.col("raw1") == F.col("raw2"), "full").where(~F.col("e1").eqNullSafe(F.col("e2")))
    return both.select(F.coalesce("raw1", "raw2").alias("raw"), F.when(F.col("e1").isNull(), "added").when(F.col("e2").isNull(), "removed").otherwise("changed").alias("change"))
