"""Near duplicates, repeated strings and embeddings against brute force on awkward tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.llm import embeddings, near_dedup, queries, substrings
from corpuloom.llm import components as components_of
from corpuloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def union_find(nodes, links):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("alone", [1 << 17, 0, 40])
def test_components_equal_union_find(spark, monkeypatch, alone):
    monkeypatch.setattr(components_of, "ALONE", alone)
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == union_find(nodes, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Near duplicates


def slow_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    places = {}
    for i, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in places.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i: len(s) for i, s in sets.items()}, union_find(sets, links)


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates_equal_brute_force_on_documents(spark, sf, k, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, k, percent).collect()}
    sizes, groups = slow_groups([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == groups
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def chain(r, n, words=60):
    """Copies of copies, each with one word changed: ends of the chain are strangers."""
    text = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        text = list(text)
        text[r.randrange(words)] = f"x{r.randrange(10**6)}"
    return out


def test_near_duplicates_of_chains_and_crowds(spark):
    r = random.Random(7)
    texts = chain(r, 40) + chain(r, 25, 30)
    base = [f"b{i}" for i in range(80)]
    for _ in range(120):  # a crowd around one text, some members far from each other
        t = list(base)
        for _ in range(r.randrange(1, 7)):
            t[r.randrange(80)] = f"y{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [texts[3]] * 30 + ["Same Words", "same words", "same  words\n", "one", "ONE", "", None, " \t", "é É"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(frame(spark, rows), 2, 80).collect()}
    sizes, groups = slow_groups(rows, 2, 80)
    assert {i: x["n_shingles"] for i, x in got.items()} == sizes
    assert {i: x["component_id"] for i, x in got.items()} == groups


def test_blocks_search_neighbourhoods_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    test_near_duplicates_of_chains_and_crowds(spark)


@pytest.mark.parametrize("block", [256, 3])
def test_a_bucket_of_strangers(spark, monkeypatch, block):
    """Every class in one bucket, led by one that is close to none: groups of near copies are found all the same."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(4):
            t = list(base)
            t[r.randrange(60)] = f"y{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    signed = [(i, near_dedup.signature(t, 2)) for i, t in rows]
    classes = spark.createDataFrame([(i, n, bits.tolist()) for i, (n, _, bits) in signed], "cid long, n long, bits array<long>")
    shared = spark.createDataFrame([(0, i, 0) for i, _ in rows], "bucket long, cid long, leader long")
    met = near_dedup._across(shared, spark.createDataFrame([], "node long, label long"), classes, 80)
    want = union_find(range(len(rows)), [(4 * (i // 4), i) for i in range(len(rows))])
    assert union_find(range(len(rows)), [(x["a"], x["b"]) for x in met.collect()]) == want


def test_estimate_is_close_to_the_similarity(spark):
    a = " ".join(f"w{i}" for i in range(1000))
    rows = []
    for share in (0.5, 0.8, 0.95):
        b = " ".join(f"w{i}" if i < 1000 * share else f"z{i}" for i in range(1000))
        n, _, left = near_dedup.signature(a, 1)
        _, _, right = near_dedup.signature(b, 1)
        rows.append((share / (2 - share), left.tolist(), right.tolist()))
        assert n == 1000
    df = spark.createDataFrame(rows, "want double, a array<long>, b array<long>")
    for r in df.select("want", near_dedup.estimate(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r["want"] - r["got"]) < 0.15


AWKWARD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (2, ""), (3, None), (None, "a b c d e f"), (None, "lonely text of some words here"), (4, "word " * 50_000), (5, "word " * 50_001), (1, "another text under one id of words")]


def test_near_duplicates_of_awkward_rows(spark):
    df = frame(spark, AWKWARD).withColumn("key", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = near_dedup.near_duplicates(df, 5, 80).collect()
    assert len(got) == len(AWKWARD)
    assert [r["n_shingles"] for r in got if r["doc_id"] in (2, 3)] == [0, 0, 0]
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["1", "None"]
    assert near_dedup.near_duplicates(df.limit(0), 5, 80).count() == 0
    kept = near_dedup.keep_one(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in kept.collect()) == sorted([("1", "a b c d"), ("1", "another"), ("2", ""), ("3", ""), ("4", "word wo"), ("None", "lonely ")])
    assert near_dedup.keep_one(df.limit(0), 5, 80).count() == 0


# --- Repeated strings


def slow_removal(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def slow_passages(rows, length=200, least=50):
    """Bytes of maximal runs of repeated strings that hold enough words, by document."""
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b) + 2, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        step = np.diff(gone)
        runs = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)
        out[k] = sum(y - x for x, y in runs if len(b[x:y].split()) >= least)
    return out


def removal(spark, rows, length=400):
    found = substrings.remove_repeats(frame(spark, rows), length=length)
    return Counter((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect())


def wanted(rows, length=400):
    return Counter((i, *x) for (i, _), x in zip(rows, slow_removal([t for _, t in rows], length), strict=True))


def test_repeats_equal_brute_force_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = wanted(rows)
    assert removal(spark, rows) == want
    found = queries.op3_substrings(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    assert {r["doc_id"]: r["n_passage_bytes"] for r in found} == slow_passages(rows)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force_on_made_texts(spark, seed):
    r = random.Random(seed)
    letters = ["ab", "abcdé", "xyz \n"][seed % 3]

    def some(n):
        return "".join(r.choice(letters) for _ in range(n))

    shared = [some(r.choice([399, 400, 401, 450, 700])) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [some(r.randrange(300)) if r.random() < 0.5 else r.choice(shared)[r.randrange(3) :] for _ in range(r.randrange(6))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 1500), (101, "ab" * 600), (102, "a" * 399), (103, shared[0] * 2), (104, None), (105, "")]
    assert removal(spark, rows) == wanted(rows)


def test_repeats_of_one_passage_in_many_contexts(spark):
    r = random.Random(9)
    passage = "".join(r.choice("pqrs ") for _ in range(380))
    rows = [(i, "".join(r.choice("abcd") for _ in range(r.randrange(200))) + r.choice(["", "X" * 25, "YZ" * 9]) + passage + r.choice(["", "Q" * 21, "R" * 19])) for i in range(150)]
    assert removal(spark, rows) == wanted(rows)


@pytest.mark.parametrize("length", [8, 60, 200, 1600])
def test_repeats_of_other_lengths(spark, length):
    r = random.Random(length)
    shared = ["".join(r.choice("abcd ") for _ in range(length + d)) for d in (-1, 0, 1, 30)]
    rows = [(i, "".join(r.choice(shared) if r.random() < 0.5 else "".join(r.choice("wxyz ") for _ in range(r.randrange(50))) for _ in range(5))) for i in range(25)]
    assert removal(spark, rows, length) == wanted(rows, length)
    with pytest.raises(ValueError, match="1601"):
        substrings.repeats(frame(spark, rows), 1601)


def test_passages_are_counted_beside_what_goes(spark):
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**5)}" for _ in range(n))
    shared = [words(n) for n in (30, 45, 52, 90)]
    rows = [(i, " ".join(r.choice([words(r.randrange(40)), r.choice(shared)]) for _ in range(6))) for i in range(30)] + [(30, None), (31, ""), (32, "a b " * 400), (33, "x" * 900)]
    found = substrings.remove_repeats(frame(spark, rows), passage=(200, 50)).collect()
    assert {x["doc_id"]: x["passage_bytes"] for x in found} == slow_passages(rows)
    assert Counter((x["doc_id"], x["n_bytes"], x["n_bytes"] - len(x["kept"]), len(x["removed"]), hashlib.sha256(x["kept"]).hexdigest()) for x in found) == wanted(rows)


def test_short_runs_stay_by_their_words(spark):
    r = random.Random(2)
    long, short = (" ".join(f"w{r.randrange(10**5)}" for _ in range(n)) for n in (51, 40))
    rows = [(i, f"{i} start {long if i < 3 else 'x'} middle {i} {short} end {i}") for i in range(6)]
    out = {x["doc_id"]: x["text"] for x in substrings.without_repeats(frame(spark, rows), length=200, min_words=50).collect()}
    assert all(long not in t and short in t for t in out.values())
    assert all(out[i] == t for i, t in rows[3:])


def test_a_hash_collision_is_found_and_mended(monkeypatch):
    monkeypatch.setattr(substrings.Prefixes, "of", lambda self, start, length: (np.asarray(length) * 0 + 1).astype(np.uint64))  # all strings collide
    strings = [b"banana", b"bandana", b"apple", b"banana", b"b"]
    starts = np.cumsum([0, *map(len, strings)])[:-1]
    p = substrings.Prefixes(np.frombuffer(b"".join(strings), np.uint8))
    order, ext = substrings.suffix_sort(p, starts, np.array(list(map(len, strings))), np.zeros(5, int))
    assert [strings[i] for i in order] == sorted(strings)
    assert ext.tolist() == [0, 0, 1, 6, 3]


def test_suffix_sort_equals_sorted():
    r = random.Random(11)
    for _ in range(20):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 40))]
        group = np.sort(np.array([r.randrange(4) for _ in strings]))
        starts = np.cumsum([0, *map(len, strings)])[:-1]
        p = substrings.Prefixes(np.frombuffer(b"".join(strings) + b"z", np.uint8))
        order, _ = substrings.suffix_sort(p, starts, np.array(list(map(len, strings))), group)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))


def test_anchors_cover_every_window():
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    owned = [w for _, place, first, last in substrings.anchors(data) for p, a, b in zip(place, first, last, strict=True) for w in range(a, b + 1) if a <= w <= p <= w + 240]
    assert owned == list(range(3000 - 399))


def test_repeats_of_awkward_rows(spark):
    x = "".join(random.Random(1).choice("abc") for _ in range(500))
    rows = [(1, x), (1, x), (None, x + "tail"), (2, None), (3, ""), (4, "é" * 700), (5, "short")]
    assert removal(spark, rows) == wanted(rows)
    df = frame(spark, rows).withColumn("key", F.lit("clash")).withColumn("runs", F.lit(1))
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, ""), (1, ""), (None, "tail"), (2, None), (3, ""), (4, ""), (5, "short")])
    assert substrings.remove_repeats(df.limit(0)).count() == 0


# --- Embeddings


def slow_links(rows, threshold=0.93):
    good = []
    for i, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append((i, np.array(v, float) / np.linalg.norm(v), label) if ok else (i, None, None))
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][1] is not None and good[b][1] is not None and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold]
    count = Counter(x for link in links for x in link)
    groups = union_find(range(len(rows)), links)
    lows = {}
    for n, g in groups.items():
        if rows[n][0] is not None:
            lows[g] = min(lows.get(g, rows[n][0]), rows[n][0])
    return Counter((rows[n][0], count[n], lows.get(groups[n])) for n in range(len(rows)))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def near(spark, rows, **kw):
    got = embeddings.near_vectors(vectors(spark, rows), **kw).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)


def crowd(seed, n, dim=16):
    r = np.random.default_rng(seed)
    heads = r.standard_normal((5, dim))
    rows = []
    for i in range(n):
        v = heads[r.integers(5)] + r.standard_normal(dim) * r.choice([0.02, 0.12, 0.3, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(3)) if r.random() < 0.9 else None))
    return rows + [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, [2 * x for x in rows[0][1]], rows[0][2])]


def test_vectors_equal_brute_force(spark):
    rows = crowd(1, 300)
    assert near(spark, rows) == slow_links(rows)


def test_vectors_in_chunks_and_finer_grids(spark, monkeypatch):
    rows = crowd(2, 220)
    monkeypatch.setattr(embeddings, "CHUNK", 9)
    assert near(spark, rows) == slow_links(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 0.0], None),
        (None, [1.0, 0.01], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1e30, 0.0], 0), (11, [1e-30, 0.0], 0), (12, [1.0], 0), (13, [2.0], 0), (14, [-1.0], 0),
    ]
    assert near(spark, rows) == slow_links(rows)
    assert embeddings.near_vectors(vectors(spark, []),).count() == 0
    extra = vectors(spark, rows).withColumn("cid", F.lit("clash")).withColumn("links", F.lit(1))
    assert embeddings.near_vectors(extra).count() == len(rows)


def test_vectors_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op10_embeddings(spark, sf).collect())
    assert got == slow_links(rows)
