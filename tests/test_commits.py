"""Committed tables and changing indexes against plain ones."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import search, segments
from corpuloom.sources.commits import Conflict, Log, Table


def held(table, version=None):
    return {r["k"]: r["v"] for r in table.read(version).collect()}


def put(spark, table, rows, **kw):
    return table.upsert(spark.createDataFrame(rows, "k long, v string"), **kw)


@pytest.fixture()
def made(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", "k bigint, v string", ["k"])


def test_upserts_deletes_and_old_versions(spark, made):
    assert held(made) == {}
    assert put(spark, made, [(1, "a"), (2, "b"), (None, "n")]) == 1
    assert put(spark, made, [(2, "c"), (2, "d"), (3, None)]) == 2  # of rows with one key the largest
    assert made.delete(spark.createDataFrame([(1,), (9,)], "k long")) == 3
    assert held(made) == {2: "d", 3: None, None: "n"}
    assert held(made, 1) == {1: "a", 2: "b", None: "n"}
    assert held(made, 0) == {}
    with pytest.raises(ValueError, match="no version"):
        made.read(99)
    assert made.compact() == 4
    assert held(made) == {2: "d", 3: None, None: "n"} and held(made, 2) == {1: "a", 2: "d", 3: None, None: "n"}
    assert made.vacuum(keep=1) == 0  # too young
    assert made.vacuum(keep=1, grace=0) == 3
    assert held(made) == {2: "d", 3: None, None: "n"} and made.log.versions() == [4]


def test_concurrent_upserts_end_in_one_order(spark, made):
    failed = []

    def write(i):
        try:
            put(spark, made, [(0, f"w{i}"), (i, "own")])
        except Exception as e:  # told after the join
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and made.log.versions() == [1, 2, 3, 4, 5]
    last = [held(made, v)[0] for v in range(1, 6)]
    assert sorted(last) == [f"w{i}" for i in range(1, 6)]
    assert held(made) == {0: last[-1]} | {i: "own" for i in range(1, 6)}


def test_conflicts_are_told(spark, made):
    base = put(spark, made, [(1, "a"), (2, "b")])
    put(spark, made, [(1, "other")])
    with pytest.raises(Conflict, match="since version 1"):
        put(spark, made, [(1, "mine")], since=base)
    assert put(spark, made, [(2, "mine")], since=base) == 3
    assert held(made) == {1: "other", 2: "mine"}
    with pytest.raises(Conflict):
        made.log.put(2, {})
    assert not [f for f in os.listdir(made.path[7:] + "/log") if not f.endswith("json") and not f.endswith("crc")]  # drafts are gone


def test_a_killed_write_is_never_seen(spark, made, monkeypatch):
    put(spark, made, [(1, "a")])
    monkeypatch.setattr(Log, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        put(spark, made, [(1, "never"), (2, "never")])
    monkeypatch.undo()
    assert held(made) == {1: "a"} and made.log.versions() == [1]
    assert put(spark, made, [(3, "c")]) == 2
    assert made.vacuum(keep=9, grace=0) == 1  # the part that no version names
    assert held(made) == {1: "a", 3: "c"}


def test_two_compactions_conflict(spark, made, monkeypatch):
    put(spark, made, [(1, "a")])
    put(spark, made, [(2, "b")])
    inner = Table._write

    def between(self, *a):
        monkeypatch.setattr(Table, "_write", inner)
        Table(spark, made.path, "k bigint, v string", ["k"]).compact()
        put(spark, made, [(3, "c")])
        return inner(self, *a)

    monkeypatch.setattr(Table, "_write", between)
    with pytest.raises(Conflict, match="compacted already"):
        made.compact()
    assert held(made) == {1: "a", 2: "b", 3: "c"}


# --- Indexes of segments

WORDS = "the of and cat dog bird sits runs on mat of_the ünï".split()


def random_docs(seed, ids):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[: r.choice([3, 7, 12])]) for _ in range(r.choice([0, 1, 5, 40, 200])))) for i in ids]


def same(index, docs, spark, queries=("the of and cat", "dog nowhere", "the the mat")):
    df = spark.createDataFrame(sorted(docs.items()), "id long, text string") if docs else spark.createDataFrame([], "id long, text string")
    plain = [x.cache() for x in search.index(df, "id", "text")]
    for q in queries:
        for every in (True, False):
            for k in (3, 500):
                phrases = search.and_phrases(q)
                want = [(r["doc"], round(r["score"], 9)) for r in search.top(search.bm25(*plain, phrases, every), k).collect()]
                got = [(r["doc"], round(r["score"], 9)) for r in index.search(phrases, every, k).collect()]
                assert [s for _, s in got] == pytest.approx([s for _, s in want]), (q, every, k)
                assert {d for d, s in got if not got or s > got[-1][1]} == {d for d, s in want if not want or s > want[-1][1]}, (q, every, k)
    assert {r["doc"]: r["len"] for r in index.documents().collect()} == {r["doc"]: r["len"] for r in plain[1].collect()}
    [x.unpersist() for x in plain]


def test_segments_equal_a_fresh_build_after_every_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "MIN_SLICES", 3)
    index = segments.Index(spark, f"file://{tmp_path}/i")
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    same(index, {}, spark, ["cat"])
    first = random_docs(1, range(60))
    assert index.add(frame([*first, (None, "cat"), (5, "cat")][:61]), "id", "text") == 1
    docs = dict(first)
    same(index, docs, spark)
    second = random_docs(2, range(40, 90))
    index.add(frame(second), "id", "text")  # 40 to 59 stay as they are
    docs = dict(second) | docs
    same(index, docs, spark, ["of_the cat"])
    index.drop(spark.createDataFrame([(i,) for i in (*range(0, 90, 4), 1000)], "doc long"))
    docs = {i: t for i, t in docs.items() if i % 4}
    same(index, docs, spark, ["the of"])
    third = random_docs(3, range(80, 110))
    version = index.replace(frame(third), "id", "text")
    before, docs = dict(docs), docs | dict(third)
    same(index, docs, spark)
    assert index.drop(spark.createDataFrame([(4000,)], "doc long")) == version  # nothing to drop
    index.merge(everything=True)
    assert len(index.manifest()["segments"]) == 1 and not index.manifest()["segments"][0]["deleted"]
    same(index, docs, spark)
    old = {r["doc"] for r in index.search([["cat"]], True, 500, version=version - 1).collect()}
    assert old == {i for i, t in before.items() if "cat" in t.split()}  # an old version reads back
    assert index.vacuum(keep=1, grace=0) > 3
    same(index, docs, spark, ["cat"])
    index.reset()
    same(index, {}, spark, ["cat"])


def test_tiers_merge_when_they_are_full(spark, tmp_path):
    index = segments.Index(spark, f"file://{tmp_path}/i")
    for i in range(segments.FANOUT):
        index.add(spark.createDataFrame(random_docs(i, range(10 * i, 10 * i + 10)), "id long, text string"), "id", "text")
    version = index.log.latest()
    assert index.merge() == version + 1 and len(index.manifest()["segments"]) == 1
    assert index.merge() == version + 1  # nothing to do
    same(index, dict(d for i in range(segments.FANOUT) for d in random_docs(i, range(10 * i, 10 * i + 10))), spark, ["the of and"])


def test_writers_of_an_index_conflict(spark, tmp_path, monkeypatch):
    index = segments.Index(spark, f"file://{tmp_path}/i")
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    index.add(frame(random_docs(1, range(5))), "id", "text")
    inner = segments.Index._built

    def between(self, *a):
        monkeypatch.setattr(segments.Index, "_built", inner)
        segments.Index(spark, index.path).add(frame(random_docs(2, range(5, 9))), "id", "text")
        return inner(self, *a)

    monkeypatch.setattr(segments.Index, "_built", between)
    with pytest.raises(Conflict, match="version 2, not 1"):
        index.add(frame(random_docs(3, range(5, 20))), "id", "text")
    assert index.documents().count() == 9


def test_broad_searches_score_fewer_postings(spark, tmp_path, monkeypatch):
    """A search for any of several common words scores a part of their postings, and finds the same."""
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "MIN_SLICES", 1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = segments.Index(spark, f"file://{tmp_path}/i")
    index.add(docs, "doc_id", "text")
    held_, plain = index.postings(terms=["the", "of", "and"]).count(), search.index(docs, "doc_id", "text")
    for every in (False, True):
        phrases = search.or_phrases("the of and")
        got = index.search(phrases, every, 5, count=True).collect()
        want = search.top(search.bm25(*plain, phrases, every), 5).collect()
        assert [(r["doc"], round(r["score"], 9)) for r in got] == [(r["doc"], round(r["score"], 9)) for r in want]
        assert got[0]["scored"] < 0.6 * held_  # one slice


def test_string_ids_and_odd_tables(spark, tmp_path):
    index = segments.Index(spark, f"file://{tmp_path}/i", "string")
    rows = [("b/x.txt", "cat dog"), ("a/x.txt", "cat dog"), ("c", None), ("d", ""), (None, "cat"), ("b/x.txt", "cat dog")]
    index.add(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    assert [r["doc"] for r in index.search([["cat"], ["dog"]], True).collect()] == ["a/x.txt", "b/x.txt"]
    assert index.documents().count() == 4
    assert index.add(spark.createDataFrame([], "id string, text string"), "id", "text") == 1
    keep = spark.createDataFrame([("b/x.txt",)], "doc string")
    assert [r["doc"] for r in index.search([["cat"]], True, keep=keep).collect()] == ["b/x.txt"]


def test_a_single_part_and_unique_rows_are_not_shuffled(spark, tmp_path):
    t = Table(spark, str(tmp_path / "single"), "k string, v string", ["k"])
    first = t.upsert(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "k string, v string"))
    one = t.read(first)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"] or "", r["v"]) for r in one.collect()) == [("", "4"), ("a", "2"), ("b", "3")]
    second = t.upsert(one.where("k = 'b'").withColumn("v", F.lit("5")), unique=True)
    assert [tuple(r) for r in t.own(second).collect()] == [("b", "5")]
    t.delete(spark.createDataFrame([("a",)], "k string"))
    t.compact()
    assert sorted((r["k"] or "", r["v"]) for r in t.read().collect()) == [("", "4"), ("b", "5")]
    gone = Table(spark, str(tmp_path / "gone"), "k string, v string", ["k"])
    gone.delete(spark.createDataFrame([("a",)], "k string"))
    assert gone.read().count() == 0


def test_changes_take_no_postings_apart(spark, tmp_path, monkeypatch):
    """Adding, dropping, replacing and merging move texts and blocks whole, not their postings one by one, and make the blocks that their definition has."""
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "MIN_SLICES", 2)
    monkeypatch.setattr(segments, "TOKENS", 300)
    with monkeypatch.context() as m:
        m.setattr(segments.Index, "postings", None)
        index = segments.Index(spark, f"file://{tmp_path}/i")
        frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
        docs = dict(random_docs(1, range(80)))
        index.add(frame(sorted(docs.items())), "id", "text")
        index.add(frame([(200, ""), (201, "cat"), (3, "cat")]), "id", "text")
        index.drop(spark.createDataFrame([(i,) for i in (*range(0, 80, 3), 200)], "doc long"))
        new = random_docs(2, range(70, 95))
        index.replace(frame(new), "id", "text")
        index.drop(spark.createDataFrame([(i,) for i in range(90, 95)], "doc long"))
        docs = {i: t for i, t in ({i: t for i, t in docs.items() if i % 3} | {201: "cat"} | dict(new)).items() if not 90 <= i < 95}
        same(index, docs, spark, ["the of", "dog"])
        index.merge(everything=True)
        same(index, docs, spark, ["the of", "dog"])
    held = index.postings().collect()
    fresh = segments.Index(spark, f"file://{tmp_path}/fresh")
    fresh.add(frame(sorted(docs.items())), "id", "text")
    plain = lambda rows: sorted((r["term"], r["doc"], r["len"], r["tf"], tuple(r["positions"])) for r in rows)
    assert plain(held) == plain(fresh.postings().collect()) and len({r["slice"] for r in held}) > 1
    order = {}
    for r in index._blocks(index.manifest()["segments"]).sort("slice", "term", "low").collect():
        if not r["term"]:
            order |= {(r["slice"], d): (n, d, at) for d, n, at in zip(r["docs"], r["lens"], r["at"])}
        assert r["n"] == len(r["docs"]) <= 4 and (r["low"], r["high"]) == (r["at"][0], r["at"][-1]) and r["at"] == [order[r["slice"], d][2] for d in r["docs"]]
        pairs = set(zip(r["tfs"], r["lens"]))
        best = sorted((n, tf) for tf, n in pairs if not any(a >= tf and b <= n and (a, b) != (tf, n) for a, b in pairs))
        assert best == list(zip(r["best_len"], r["best_tf"]))
    for s in {s for s, _ in order}:
        mine = sorted(x for (of, _), x in order.items() if of == s)
        assert [at for _, _, at in mine] == list(range(len(mine)))  # places by length, then id
