"""Folder digests find what changed and read little; filters prune a tree before it is listed."""

import os
import random

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringStartsWith

from corpuloom.operators import merkle
from corpuloom.sources import tree

ENTRIES = "raw binary, path string, kind string, size long, mtime double"


def made(spark, files):
    """Entries of files and of the folders above them."""
    dirs = {p.rsplit(b"/", i)[0] for p in files for i in range(1, p.count(b"/") + 1)}
    rows = [(bytearray(p), p.decode("utf-8", "replace"), "file", s, m) for p, (s, m) in files.items()] + [(bytearray(d), d.decode("utf-8", "replace"), "dir", 0, random.random()) for d in dirs]
    random.shuffle(rows)
    return spark.createDataFrame(rows, ENTRIES), dirs


def test_changes_are_found_in_few_folders(spark):
    r = random.Random(1)
    files = {f"{a}/{b}/{c}/f{i}".encode(): (r.randrange(9), 1.0) for a in "abcdef" for b in "uvwxyz" for c in "123" for i in range(3)}
    files |= {b"top": (1, 1.0), b"a/\xff/x": (1, 1.0), b"a/\xfe/x": (1, 1.0)}
    old, dirs = made(spark, files)
    new = dict(files)
    del new[b"b/u/1/f0"]
    new[b"c/v/2/f1"] = (99, 1.0)
    new[b"c/v/2/more"] = (1, 1.0)
    new[b"a/\xfe/x"] = (1, 2.0)
    new[b"new/deep/down/file"] = (5, 1.0)
    now, _ = made(spark, new)
    a, b = merkle.folders(old), merkle.folders(now)
    assert {x["folder"].encode("latin-1") for x in a.collect()} == dirs | {b""}
    where, read = merkle.unequal(a, b)
    got = {(bytes(x["raw"]), x["change"]) for x in merkle.changed(old, now, where).collect()}
    assert got == {(b"b/u/1/f0", "removed"), (b"c/v/2/f1", "changed"), (b"c/v/2/more", "added"), (b"a/\xfe/x", "changed"), (b"new", "added"), (b"new/deep", "added"), (b"new/deep/down", "added"), (b"new/deep/down/file", "added")}
    assert where.count() == 3 + 4 + 1 - 1 and read < 0.35 * len(dirs)  # of over 140 folders
    same, read = merkle.unequal(a, merkle.folders(old.repartition(5)))
    assert same.count() == 0 and read == 1


def test_digests_of_odd_trees(spark):
    none = spark.createDataFrame([], ENTRIES)
    assert merkle.folders(none).count() == 0
    where, read = merkle.unequal(merkle.folders(none), merkle.folders(none))
    assert where.count() == 0 and read == 0
    one, _ = made(spark, {b"x": (1, 1.0)})
    where, _ = merkle.unequal(merkle.folders(none), merkle.folders(one))
    assert [tuple(x) for x in merkle.changed(none, one, where).select(F.decode("raw", "utf-8"), "change").collect()] == [("x", "added")]
    hollow = spark.createDataFrame([(bytearray(b"d"), "d", "dir", 0, 1.0)], ENTRIES)
    assert {x["folder"]: x["n"] for x in merkle.folders(hollow).collect()} == {"": 1, "d": 0}


def planted(tmp_path):
    for a in ("a", "b", "ba"):
        for b in ("x", "y"):
            for c in ("1", "2"):
                os.makedirs(tmp_path / a / b / c)
                (tmp_path / a / b / c / "f.txt").write_text(a + b + c)
    return str(tmp_path)


def read(root, filters):
    reader = tree.FileTree({"path": root, "content": "true"}).reader(None)
    assert list(reader.pushFilters(filters)) == filters
    return [row for p in reader.partitions() for row in reader.read(p)], reader.listed


def test_filters_prune_folders(spark, tmp_path):
    root = planted(tmp_path)
    every, listed = read(root, [])
    assert listed == 1 + 3 + 6 + 12
    path = lambda row: row[1]
    cases = [
        ([StringStartsWith(("path",), "b/x/")], lambda p: p.startswith("b/x/"), 5), ([EqualTo(("path",), "a/y/2/f.txt")], lambda p: p == "a/y/2/f.txt", 4), ([EqualTo(("parent",), "ba/x")], lambda p: p.rpartition("/")[0] == "ba/x", 1),
        ([GreaterThanOrEqual(("path",), "b/y"), LessThan(("path",), "ba")], lambda p: "b/y" <= p < "ba", 6), ([StringStartsWith(("path",), "b")], lambda p: p.startswith("b"), 15), ([EqualTo(("path",), "")], lambda p: False, 1),
    ]
    for filters, keep, most in cases:
        rows, listed = read(root, filters)
        assert {path(x) for x in rows if keep(path(x))} == {path(x) for x in every if keep(path(x))}, filters
        assert listed <= most, (filters, listed)
    tree.register(spark)
    entries = spark.read.format("filetree").load(root)
    for where, keep in (("path LIKE 'b/x/%'", lambda p: p.startswith("b/x/")), ("parent = 'a/x'", lambda p: p.rpartition("/")[0] == "a/x"), ("path >= 'b/y' AND path < 'ba'", lambda p: "b/y" <= p < "ba")):
        assert {x["path"] for x in entries.where(where).collect()} == {path(x) for x in every if keep(path(x))}
    kinds = spark.read.format("filetree").option("content", "true").load(root).where("kind = 'file'")
    assert {x["content"].decode() for x in kinds.collect()} == {a + b + c for a in ("a", "b", "ba") for b in "xy" for c in "12"}


def test_levels_read_folders_and_make_no_digest_again(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(f"t/{i % 3}/{i}".encode()), f"t/{i % 3}/{i}", "file", i, 1.0) for i in range(30)], "raw binary, path string, kind string, size long, mtime double")
    assert "ArrowEvalPython" not in merkle.folders(rows)._jdf.queryExecution().optimizedPlan().toString()
