"""Hard negatives and vector codes against brute force on awkward tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.llm import hard_negatives, queries, sql, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [(901, None, 1), (902, [0.1, None, 0.3, 0.4], 1), (903, [0.1, float("nan"), 0.3, 0.4], 2), (904, [float("inf"), 0.0, 0.0, 0.0], 2)]


def some_vectors(seed, n, dim, labels=4):
    """Vectors on a coarse grid, so that scores and distances tie, with copies, null labels and null ids."""
    r = random.Random(seed)
    rows = [(r.randrange(n), [r.randrange(-4, 5) / 4 for _ in range(dim)], r.choice([*range(labels), None])) for _ in range(n)]
    rows += [r.choice(rows) for _ in range(n // 4)] + [(None, [0.5] * dim, 1), (None, [0.5] * dim, None)]
    return rows + [(i, v and v[:1] * (dim - 4) + v, x) for i, v, x in BAD]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)


# --- Hard negatives


def slow_negatives(rows, every, positives=5, negatives=5):
    rows = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], label) for i, v, label in rows if usable(v) and label is not None]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for a, (i, v, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for b, (j, w, other) in enumerate(rows) if b != a]
        mine = sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:positives]
        for p, j, _ in mine:
            near = sorted((s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p), key=lambda s: (-s[0], last(s[1])))
            out.update((i, j, rank, s[1], p, s[0]) for rank, s in enumerate(near[:negatives], 1))
    return out


def mined(spark, rows, every, **kw):
    df = spark.createDataFrame(rows, VECTORS)
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect())


@pytest.mark.parametrize(("rows", "anchors", "dims", "most"), [(1024, 256, 32, 8), (7, 3, 2, 8), (5, 2, 1, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, rows, anchors, dims, most):
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("DIMS", dims), ("MAX_CHUNKS", most)):
        monkeypatch.setattr(hard_negatives, name, value)
    table = some_vectors(rows, 60, 7)
    assert mined(spark, table, 5) == slow_negatives(table, 5)


def test_hard_negatives_of_odd_tables(spark):
    assert not mined(spark, [], 1)
    assert not mined(spark, [(0, [1.0], 1)], 1)
    assert not mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 1)
    assert not mined(spark, [(0, [1.0], None), (1, None, 1)], 1)
    copies = [(0, [0.5, 0.5], 1)] * 9 + [(1, [0.5, 0.5], 2)] * 9
    assert mined(spark, copies, 2) == slow_negatives(copies, 2)
    short = [(0, [0.5, 0.5, 1.0], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.5], 2), (3, [1e30, 0.0], 1)]  # the last's squared norm passes the limit
    assert mined(spark, short, 2) == slow_negatives(short[:3], 2)
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in some_vectors(3, 30, 4)], VECTORS + ", uid string, anchor int, score double")
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, positives=2, negatives=1).count() == sum(slow_negatives(some_vectors(3, 30, 4), 3, 2, 1).values())


def test_products_of_large_numbers_are_exact():
    a = np.array([[2**28 - 1, 3], [-(2**28), 1]], np.int64)
    assert hard_negatives.product(a, a).tolist() == [[int(sum(int(p) * int(q) for p, q in zip(x, y, strict=True))) for y in a] for x in a]
    for scores in ([-128, 127], [128, 0], [1 << 31, 5], [-(1 << 55), 1 << 55]):
        assert hard_negatives._wide(hard_negatives._narrow(np.array(scores)), 2).tolist() == scores


def test_a_hot_label_is_dealt_over_blocks(spark, monkeypatch):
    """Blocks hold a bounded number of rows whatever the label, and a row goes once to each anchor block and chunk."""
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    rows = spark.range(1000).select(F.col("id").alias("uid"), "id", F.lit("hot").alias("label"), F.lit(b"\0" * 8).alias("vector"))
    own = rows.where("id % 100 = 0").withColumn("windows", F.lit(None).cast("array<long>"))
    pieces = hard_negatives._pieces(rows, own, 20, 32, 1)
    assert pieces.where("side = 1").count() == 1000
    assert pieces.where("side = 1").groupBy("grp", "bi", "bj").count().agg(F.max("count")).first()[0] < 100


# --- Vector codes


def slow_codes(rows, parts=8, entries=16, rounds=6):
    rows = [(i, [int(np.floor(float(np.float32(x)) * 4096)) for x in v], label) for i, v, label in rows if usable(v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    dim = len(rows[0][1])
    cut = lambda v: [v[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    books = [[cut(r[1])[p] for r in rows[:entries]] for p in range(parts)]
    assign = lambda: [[min(range(len(b)), key=lambda e: (away(x, b[e]), e)) for x, b in zip(cut(r[1]), books, strict=True)] for r in rows]
    for _ in range(rounds):
        at = assign()
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                held = [cut(r[1])[p] for r, c in zip(rows, at, strict=True) if c[p] == e]
                if held:
                    new[p][e] = [sum(x) // len(held) for x in zip(*held, strict=True)]
        books = new
    at = assign()
    errors = [sum(away(x, books[p][c[p]]) for p, x in enumerate(cut(r[1]))) for r, c in zip(rows, at, strict=True)]
    by = Counter()
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{e:02x}" for e in c), x, by[r[2]], sha) for r, c, x in zip(rows, at, errors, strict=True))


def coded(spark, rows, **kw):
    return Counter(tuple(r) for r in vector_codes.codes(spark.createDataFrame(rows, VECTORS), **kw).collect())


@pytest.mark.parametrize(("n", "dim"), [(90, 16), (70, 11), (9, 8)])
def test_codes_equal_brute_force(spark, n, dim):
    rows = some_vectors(n, n, dim)
    assert coded(spark, rows) == slow_codes(rows)


def test_codes_of_odd_tables(spark):
    assert not coded(spark, [])
    assert not coded(spark, [(1, None, 1), (2, [None], 1)])
    assert coded(spark, [(1, [0.5] * 8, None)] * 3) == slow_codes([(1, [0.5] * 8, None)] * 3)
    mixed = [(5, [0.25] * 8, 1), (6, [0.5] * 8, 1), (7, [0.5] * 4, 1), (8, [], 2), (9, [3e38] * 8, 1)]
    got = {r[0]: r[1:4] for r in coded(spark, mixed)}
    whole = {r[0]: r[1:4] for r in slow_codes(mixed[:2])}
    assert got == {**whole, 7: (None, None, whole[5][2]), 8: (None, None, None), 9: (None, None, whole[5][2])}
    extra = spark.createDataFrame([(*r, 1, "x") for r in some_vectors(3, 20, 8)], VECTORS + ", code int, salt string")
    assert vector_codes.codes(extra, parts=2, entries=300, rounds=1).count() > 20


def test_rings_leave_entries_out_and_miss_none():
    r = np.random.default_rng(5)
    entries, x = r.integers(-900, 900, (64, 3)), r.integers(-900, 900, (4000, 3))
    entries[7] = entries[3]
    ring = vector_codes.Rings(entries)
    index, best = ring.nearest(x)
    away = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
    assert ring.measured < 0.6 * away.size


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_vector_codes"])
def test_vector_queries_equal_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = c.sql({"op11_hard_negatives": sql.OP11, "op13_vector_codes": sql.OP13}[name]).df()[list(got.columns)]
    assert Counter(map(tuple, got.values.tolist())) == Counter(map(tuple, want.values.tolist()))
