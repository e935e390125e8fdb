"""Joins of near strings against nested loops."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpuloom.functions import edit
from corpuloom.operators import aliases, nearjoin, traces, vault


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def swaps(a, b):
    """One insertion, deletion, substitution or swap, by trying them all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    out = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1 : i + 2] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in out or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def words(seed, n, letters="abé", most=5):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(most + 1))) for _ in range(n)]


def test_one_edit_pairs_equal_a_nested_loop(spark):
    a = [(i % 2, w) for i, w in enumerate(words(1, 90))] + [(0, None), (None, "ab"), (0, "ab"), (0, "ab")]
    b = [(i % 2, w) for i, w in enumerate(words(2, 90))] + [(0, None), (None, "ab")]
    left, right = spark.createDataFrame(a, "run int, x string"), spark.createDataFrame(b, "run int, y string")
    found = nearjoin.one_edit_pairs(left, right, ["run"], "x", "y")
    want = {(g, x, y) for g, x in a for h, y in b if g is not None and g == h and x is not None and y is not None and swaps(x, y)}
    assert Counter(tuple(r) for r in found.collect()) == Counter(want) and want
    text = plan(found)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_corruption_plans_without_nested_loops(spark):
    served = spark.createDataFrame([(1, "a/x.txt#L0-9", "strong"), (1, "a/y.txt#L0-9", "weak"), (2, "b#L1-2", "weak")], "run_id long, address string, band string")
    cited = spark.createDataFrame([(1, "a/x.tx#L0-9"), (1, "a/z.txt#L0-9"), (2, "b#L1-2"), (2, "b#L12-"), (3, "b#L1-2")], "run_id long, address string")
    found = traces.corruption(served, cited)
    assert sorted(map(tuple, found.collect())) == [(1, "a/x.tx#L0-9", "a/x.txt#L0-9"), (2, "b#L12-", "b#L1-2")]  # z is one edit from x and from y
    assert "NestedLoop" not in plan(found) and "CartesianProduct" not in plan(found)


def test_a_trie_finds_the_nearest_and_leaves_branches_out():
    r = random.Random(3)
    codes = ["".join(r.choice("ABCDEFGH") for _ in range(3)) + r.choice("234") + "-" + r.choice("XYZ") for _ in range(3000)] + ["AB", "ABCDEFGH"]
    trie = nearjoin.Trie(codes)
    nodes = sum(len(x[0]) for x in trie.levels)
    for w in [codes[7][:5] + "Q", "ABC", "", "ABCDEFGHI", *words(4, 30, "ABCX2-", 9)]:
        old = trie.visited
        want = [c for _, c in sorted((lev(w, c), c) for c in set(codes))[:3]]
        assert trie.nearest(w, 3) == want, w
        if w == codes[7][:5] + "Q":
            assert trie.visited - old < 0.5 * nodes
    assert nearjoin.Trie([]).nearest("A", 3) == []


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_resolving_equals_all_against_all(spark):
    r = random.Random(5)
    bodies = ["".join(r.choice("ABCM") for _ in range(3)) + r.choice("23") for _ in range(70)]
    live = spark.createDataFrame([(b, f"d{i}#L0-9") for i, b in enumerate(sorted(set(bodies)))], "body string, address string")
    live = live.select(F.concat("body", F.lit("-"), edit.check_symbol(F.col("body"))).alias("alias"), "address")
    live = live.union(spark.createDataFrame([("QQQ2-A", "q1"), ("QQQ2-C", "q2"), ("QQQ2-D", "q3"), ("QQQ2-E", "q4")], "alias string, address string"))
    table = {x["alias"]: x["address"] for x in live.collect()}
    some = sorted(table)
    asked = [*some[:5], *(a.lower() for a in some[5:8]), *(a.replace("-", "") for a in some[8:10]), *(a[:2] + a[3:] for a in some[10:14]), *(a[1] + a[0] + a[2:] for a in some[14:20]), *(a[:-1] + "?" for a in some[20:26]), *(a.replace("M", "RN") for a in some if "M" in a), "QQQ2-?", "nothing at all", "", "  ", None, "Z"]
    got = {x["written"]: x for x in aliases.resolve(spark.createDataFrame([(a,) for a in asked], "written string"), live).collect()}
    assert set(got) == set(asked)
    pairs = spark.createDataFrame([(a, b) for a in set(asked) - {None} for b in some], "written string, live string")
    normal = edit.normalise_alias(F.trim("written"))
    folds = F.filter(edit.folded_aliases(normal), lambda v: edit.checks(v))
    rank = F.when(F.trim("written") == F.col("live"), 0).when(normal == F.col("live"), 1).when(F.array_contains(folds, F.col("live")), 2).when(edit.one_edit(normal, F.col("live")), 3).otherwise(4)
    by = {}
    for x in pairs.select("written", "live", rank.alias("rank"), F.levenshtein(normal, "live").alias("d")).collect():
        by.setdefault(x["written"], []).append((x["rank"], x["d"] if x["rank"] == 4 else 0, x["live"]))
    for w, rows in by.items():
        rows.sort()
        least, edits = rows[0][0], sum(x[0] == 3 for x in rows)
        status = "unknown" if least == 4 or not w.strip() else ("exact", "normalised", "folded", "repaired" if edits == 1 else "ambiguous")[least]
        assert got[w]["status"] == status, w
        if status == "unknown":
            assert got[w]["candidates"] == ([] if not w.strip() else [x[2] for x in rows[:3]]), w
        elif status == "ambiguous":
            assert got[w]["candidates"] == [x[2] for x in rows if x[0] == 3][:3] and got[w]["address"] is None, w
        else:
            assert (got[w]["alias"], got[w]["address"]) == (rows[0][2], table[rows[0][2]]), w
    assert {x["status"] for x in got.values()} == {"exact", "normalised", "folded", "repaired", "ambiguous", "unknown"}
    text = plan(aliases.resolve(spark.createDataFrame([("x",)], "written string"), live))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    none = aliases.resolve(spark.createDataFrame([("x",)], "written string"), live.limit(0)).collect()
    assert [(x["status"], x["candidates"]) for x in none] == [("unknown", [])]


def test_an_exhausted_space_is_refused(spark):
    with pytest.raises(aliases.Exhausted, match="alias space is exhausted"):
        aliases.mint(spark.range(edit.CODES + 1).select(F.col("id").cast("string").alias("address")))
    minted = aliases.mint(spark.range(5).select(F.col("id").cast("string").alias("address")))
    assert minted.select("alias").distinct().count() == 5
    more = aliases.mint(spark.range(7).select(F.col("id").cast("string").alias("address")), minted)
    assert more.select("alias").distinct().count() == more.count() == 7
    with pytest.raises(aliases.Exhausted):
        aliases.mint(spark.range(edit.CODES + 1).select(F.col("id").cast("string").alias("address")), minted)


def slow_clusters(rows, threshold):
    out = {}
    for scope in {r[0] for r in rows}:
        heads = []
        for _, path, title, at in sorted((r for r in rows if r[0] == scope), key=lambda r: (-r[3], r[1])):
            t = (title or "").lower()
            keeper = next((p for p, h in heads if SequenceMatcher(None, h, t).ratio() >= threshold), None)
            if keeper is None:
                heads.append((path, t))
            out[path] = keeper or path
    return out


@pytest.mark.parametrize("rounds", [12, 0, 1])
def test_clusters_equal_the_ordered_fold(spark, monkeypatch, rounds):
    monkeypatch.setattr(vault, "ROUNDS", rounds)
    r = random.Random(rounds)
    stems = ["Notes on the alpha project", "notes of the beta project", "Zed", "", "a plan for the winter of the year"]
    rows = []
    for i in range(110):
        t = list(r.choice(stems))
        for _ in range(r.randrange(5)):
            t.insert(r.randrange(len(t) + 1), r.choice("abcxyz "))
        rows.append((r.choice(["u1", "u2", None]), f"p{i:03}", r.choice(["".join(t), "".join(t), None, "Zed"]), r.randrange(60)))
    chain = "abcdefghijklmnopqrstuvwxyz"
    rows += [("chain", f"c{i:02}", "".join(chain[(i + j) % 26] for j in range(20)), i) for i in range(26)]  # each is alike to the next only
    df = spark.createDataFrame(rows, "scope string, path string, title string, t int").withColumn("updated", F.timestamp_seconds("t"))
    for threshold in (0.85, 0.6):
        got = {x["path"]: x["keeper"] for x in vault.clusters(df, threshold, "scope").collect()}
        assert got == slow_clusters(rows, threshold)
    assert vault.clusters(df.limit(0), 0.85, "scope").count() == 0


def test_the_query_equals_the_ordered_fold(spark, sf):
    import re

    from corpuloom.plans.stored import QUERIES

    rows = []
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        rows.append((re.search('<html lang="([^"]*)"', p["html"])[1], str(p["page_id"]), re.search("(?s)<title>(.*?)</title>", p["html"])[1], p["page_id"]))
    assert {r["path"]: r["keeper"] for r in QUERIES["mem_compact"](spark, sf).collect()} == slow_clusters(rows, 0.85)


def test_prefixes_of_alike_titles_meet():
    r = random.Random(9)
    for _ in range(3000):
        a = "".join(r.choice("abcde fg") for _ in range(r.randrange(14)))
        b = list(a)
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), r.choice("abqé"))
        b = "".join(b[r.randrange(3) :])
        for t in (0.6, 0.85, 1.0):
            like = SequenceMatcher(None, a, b).ratio() >= t
            assert nearjoin.alike(a, b, t) == like
            assert not like or a == b or set(nearjoin.rarest(a, t)) & set(nearjoin.rarest(b, t))


@pytest.mark.parametrize(("letters", "columns"), [(255, 1024), (4, 9)])
def test_bounds_of_titles_lose_no_alike_pair(monkeypatch, letters, columns):
    import numpy as np

    monkeypatch.setattr(nearjoin, "LETTERS", letters)
    monkeypatch.setattr(nearjoin, "COLUMNS", columns)
    r = random.Random(letters)
    titles = ["", "x", "é" * 70]
    for n in (8, 30, 63, 64, 65, 90):
        for _ in range(12):
            t = [r.choice("aaabcdé ") for _ in range(n)]
            titles.append("".join(t))
            for _ in range(r.randrange(n // 3)):
                t[r.randrange(n)] = r.choice("abñz")
            titles.append("".join(t))
    titles = sorted(set(titles))
    for threshold in (0.3, 0.85, 1.0):
        held, all_ = nearjoin._Titles(titles), np.arange(len(titles))
        a, b = held.share(all_, all_, threshold)
        good = held.follow(a, b, threshold)
        left = set(zip(a[good].tolist(), b[good].tolist(), strict=True))
        assert {(i, j) for i in all_ for j in all_ if nearjoin.alike(titles[i], titles[j], threshold)} <= left


def test_bounds_of_titles_leave_few_pairs_of_prose():
    import numpy as np

    r = random.Random(5)
    parts = "the of and ing tion er ha on ou re ent ly ble at is th ed".split()
    titles = sorted({"".join(r.choice(parts) + r.choice(["", " "]) for _ in range(30))[:60] for _ in range(600)})
    held, all_ = nearjoin._Titles(titles), np.arange(len(titles))
    a, b = held.share(all_, all_, 0.85)
    keep = a < b
    left = len(held.follow(a[keep], b[keep], 0.85))
    assert left <= len(titles)  # of 180,000 pairs, nearly all of which share one of their rarest letters
