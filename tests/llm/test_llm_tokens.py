"""Encoding, token files, mixing and the whole pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuloom.llm import bpe, mixing, near_dedup, quality_rules, queries, substrings, token_files
from corpuloom.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "B", "'s", "'t", "re", "É", "é", "́", "Σ", "ς", "ß", "İ", "²", "1", "_", ".", "»", "'", " ", "  ", "\t", "\n", " ", "中", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\x1c", "😀", "ﬁ", "≠", "K"]


def texts(seed, n, most=12):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(most))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [(1, "A b.", "en", "x", 4), (1, "A b.", "en", "x", 4), (2, "", "en", None, 0), (3, None, None, None, None), (None, "no id", "fr", "x", 5), (4, "word " * 60_000 + "end" * 30_000, "en", "y", 390_000), (5, "é" * 5, "fr", "y", 5)]


# --- Byte-level BPE


def test_safe_pieces_encode_as_the_whole():
    enc = bpe.encoding(RANKS, PATTERN)
    for t in texts(1, 3000, 40) + [" " * 50 + "a b  c\n d", "a" * 100]:
        for piece in (1, 5, 13):
            assert bpe.encode_text(enc, t, piece) == enc.encode_ordinary(t)
        assert "".join(bpe.safe_pieces(t, 3)) == t


def test_cut_runs_of_white_space_encode_as_the_whole(monkeypatch):
    enc = bpe.encoding(RANKS, PATTERN)
    monkeypatch.setattr(bpe, "_RUN", re.compile(bpe._RUN.pattern.replace(f"{{{bpe.RUN},}}", "{9,}")))
    r = random.Random(8)
    for _ in range(2000):
        parts = [" " * 12, "\n" * 9, "\t ", "\u3000" * 11, "\x1c" * 10, "\xa0" * 30, "abc", "é", "'s", "12", "!?", "  x", " y", "\r\n" * 6]
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        for piece in (1, 20):
            assert bpe.encode_text(enc, t, piece) == enc.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("sign", ["\n", " ", "\t", "\u3000", "\r\n", "a", "!", "1", "\u0301"])
def test_bpe_of_a_million_equal_signs(sign):
    enc = bpe.encoding(RANKS, PATTERN)
    n = 1_000_000
    text = "a" + sign * n + "b"
    ids = bpe.encode_text(enc, text)
    assert enc.decode_bytes(ids) == text.encode()
    if sign.isspace():  # the run without its last sign is one match; the last one goes by itself, or with b if it is a space
        tail = " b" if sign == " " else sign[-1] + "b"
        assert ids == enc.encode_ordinary("a") + enc._encode_single_piece((sign * n)[:-1]) + enc.encode_ordinary(tail)


def test_bpe_query_equals_the_library(spark, sf):
    enc = bpe.encoding(RANKS, PATTERN)
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = enc.encode_ordinary(d["text"]), got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_bpe_of_awkward_rows(spark):
    df = frame(spark, AWKWARD).withColumn("ids", F.lit("clash"))
    coded = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in coded) == Counter((i, (t or "").encode()) for i, t, *_ in AWKWARD)
    assert all(r["exact"] for r in bpe.tokens(df).collect())
    got = bpe.encode_digests(df).collect()
    assert len(got) == len(AWKWARD)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert bpe.encode_digests(df.limit(0)).count() == 0
    cut = spark.createDataFrame([(1, bpe.encoding(RANKS, PATTERN).encode_ordinary("😀")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {bytes(r["bytes"]) for r in bpe.decode(cut, RANKS, PATTERN).where("doc_id = 2").collect()} == {b""}
    assert b"\xf0\x9f" in {bytes(r["bytes"])[:2] for r in bpe.decode(cut, RANKS, PATTERN).collect()}


# --- Token files


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 15, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(packed, bits, 0, len(ids)) == ids).all()
    for first, count in ((0, 0), (1, 1), (13, 400), (1000, 1)):
        assert (token_files.unpack(packed, bits, first, count) == ids[first : first + count]).all()


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_words_encode_as_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    encode = token_files.WordEncoder(WORDS, memo=50)
    assert encode("a <|endoftext|> b").tolist() == [320, 49407, 321]
    for t in texts(2, 6000):
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def slow_files(rows, end=1):
    tokenizer = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op5_token_files(spark, sf).collect()) == slow_files(rows)


def test_token_files_of_awkward_rows(spark, tmp_path):
    df = frame(spark, AWKWARD).withColumn("shard", F.lit("clash"))
    path = f"file://{tmp_path}/t"
    token_files.write(df, path, WORDS, 1, block_ids=10)
    got = sorted((tuple(r) for r in token_files.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == slow_files([(i, t) for i, t, *_ in AWKWARD])
    ids = {r["start"]: r["ids"] for r in token_files.read(spark, path).collect()}
    assert {s: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, x in ids.items()} == {s: (n, c) for _, s, n, c in got}
    flat = np.concatenate([ids[s] for s in sorted(ids)])
    for first, count in ((0, 1), (3, 40), (len(flat) - 5, 5), (0, len(flat)), (10, 0)):
        assert token_files.ids_at(spark, path, first, count).tolist() == flat[first : first + count].tolist()
    empty = f"file://{tmp_path}/e"
    token_files.write(df.limit(0), empty, WORDS, 1)
    assert token_files.read_digests(spark, empty).count() == 0
    assert len(token_files.ids_at(spark, empty, 0, 5)) == 0


# --- Mixing


def deviations(order, weights):
    """The most that any source is off its share after any number of slots."""
    whole, taken = sum(map(Fraction, weights.values())), np.array(order)
    t = np.arange(1, len(order) + 1)
    return {s: float(np.abs(np.cumsum(taken == s) - t * float(Fraction(w) / whole)).max()) for s, w in weights.items()}


@pytest.mark.parametrize(
    "weights",
    [{"a": 1}, {"a": 3, "b": 2}, {"a": 1, "b": 1, "c": 1}, {"a": 500, "b": 333, "c": 166, "d": 1}, {"a": 7, "b": 5, "c": 3, "d": 2, "e": 1}, {"a": 0.9995, "b": 0.0005}, {"big": 9990} | {f"s{i}": 1 for i in range(9)},
     {f"s{i}": 0.1 * (i + 1) ** 0.7 for i in range(40)}, {"a": 1e-300, "b": 1e300}, {"a": 5e-324, "b": 3e-324}],
)
def test_slots_deviate_by_less_than_one_block(weights):
    order = mixing.deal(weights, dict.fromkeys(weights, 5000))
    assert max(deviations(order, weights).values()) < 1


def test_a_small_target_is_not_raised():
    weights = {"a": 0.99999, "b": 0.00001}
    order = mixing.deal(weights, {"a": 1_000_000, "b": 10**9})
    assert order.count("b") in (10, 11) and max(deviations(order, weights).values()) < 1


def test_many_sources_follow_their_targets():
    weights = {f"s{i:03}": 1.0 for i in range(499)} | {"hot": 249.5}  # a third for one, the rest alike
    order = mixing.deal(weights, dict.fromkeys(weights, 130) | {"hot": 130_000})
    assert max(deviations(order, weights).values()) < 1


def slow_schedule(sizes, weights, block_rows):
    """Earliest deadline first, slot by slot, phase by phase, in exact fractions."""
    left = {s: -(-n // block_rows) for s, n in sizes.items() if n}
    done, order = dict.fromkeys(sizes, 0), []
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        apart = {s: total / Fraction(weights[s]) for s in left}
        taken = dict.fromkeys(left, 0)
        now = 0
        while all(left.values()):
            ready = [s for s in left if floor(taken[s] * apart[s]) <= now]
            s = min(ready, key=lambda s: (ceil((taken[s] + 1) * apart[s]), floor(taken[s] * apart[s]), s))
            order.append((s, done[s]))
            taken[s] += 1
            done[s] += 1
            left[s] -= 1
            now += 1
        left = {s: n for s, n in left.items() if n}
    return order


def test_blocks_grow_beyond_a_number_of_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SLOTS", 20)
    sizes, weights = {"a": 300, "b": 90}, {"a": 1.0, "b": 2.0}
    rows = [(i, None, None, s, None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.schedule(frame(spark, rows), weights, block_rows=4).collect()
    assert [(s, b) for _, s, b in sorted({(x["slot"], x["source"], x["block"]) for x in got})] == slow_schedule(sizes, weights, 20)
    assert len({x["position"] for x in got}) == len(rows)


def test_a_crowd_of_one_id_is_dealt_over_tasks(spark):
    rows = [(None, f"t{i % 5}", "en", "hot", 2) for i in range(400)] + [(7, "x", "en", "hot", 1)] * 300 + [(i, "y", "en", "s", 1) for i in range(50)]
    df = frame(spark, rows).repartition(3)
    ranged = mixing._schedule(df, None, 4, "doc_id", "source")
    assert ranged.count() == 750 and ranged.select("position").distinct().count() == 750
    out = mixing.mix(df)
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    assert Counter(map(key, out.collect())) == Counter(map(key, df.collect()))


@pytest.mark.parametrize("seed", range(5))
def test_schedule_equals_slot_by_slot(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.randrange(1, 90) for i in range(4)} | {"hot": 300}
    weights = {s: r.random() + 0.01 for s in sizes}
    rows = [(i, None, None, s, None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    r.shuffle(rows)
    got = mixing.schedule(frame(spark, rows), weights, block_rows=4).collect()
    assert len(got) == len(rows)
    assert len({x["position"] for x in got}) == len(rows)
    order = slow_schedule(sizes, weights, 4)
    assert [(s, b) for _, s, b in sorted({(x["slot"], x["source"], x["block"]) for x in got})] == order
    for s in sizes:  # ids ascend within a source
        own = sorted((x["position"], x["doc_id"]) for x in got if x["source"] == s)
        assert [i for _, i in own] == sorted(i for _, i in own)


def test_mixing_query_and_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op4_mixing(spark, sf).toPandas()
    counts = Counter(r["source"] for r in docs.select("source").collect())
    weights = {s: n**mixing.TEMPER for s, n in counts.items()}
    want = slow_schedule(counts, weights, mixing.BLOCK_ROWS)
    assert [(s, b) for _, s, b in sorted(set(zip(got["slot"], got["source"], got["block"], strict=True)))] == want
    df = frame(spark, AWKWARD).withColumn("position", F.lit("clash"))
    out = mixing.mix(df)
    assert out.columns == df.columns
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    assert Counter(map(key, out.collect())) == Counter(map(key, df.collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.schedule(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="without a weight"):
        mixing.schedule(df, {"x": 1.0})
    with pytest.raises(ValueError, match="above 0"):
        mixing.schedule(df, dict.fromkeys([r["source"] or "" for r in df.collect()], 0.0))


# --- Pipeline


def test_pipeline_equals_brute_force(spark, sf):
    from test_llm_dedup import slow_groups

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judge = quality_rules.references(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if quality_rules.verdict(judge, r["text"])[6]]
    _, groups = slow_groups(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    length, least = corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS
    count = Counter(b[i : i + length] for b in (t.encode() for _, t in rows) for i in range(len(b) - length + 1))
    enc = bpe.encoding(RANKS, PATTERN)
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
        for x, y in zip(edges[::2], edges[1::2], strict=True):  # runs of few words stay
            if len(b[x:y].split()) < least:
                gone[x:y] = False
        text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert got[i]["ids"] == enc.encode_ordinary(text)
        assert got[i]["exact"]


def test_positions_follow_the_order_of_writing(spark, tmp_path):
    sizes = [30, 4000, 2, 900, 9000, 1]
    path, at, r = f"{tmp_path}/mixed", 0, random.Random(2)
    for k, n in enumerate(sizes):  # files as the tasks of one write name them, each shuffled ids in a fixed order
        frame(spark, [(i * 7919 % 100_003, "a b " * r.randrange(1, 9), None, "s", None) for i in range(at, at + n)]).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (tmp_path / "mixed").mkdir(exist_ok=True)
        next((tmp_path / str(k)).glob("part-*")).rename(tmp_path / "mixed" / f"part-{k:05d}-7b0c.c000.snappy.parquet")
        at += n
    docs = spark.read.parquet(f"file://{path}")
    want = [i * 7919 % 100_003 for i in range(at)]
    assert [r["doc_id"] for r in docs.select("doc_id").collect()] != want
    got = dict(mixing.placed(docs, ["doc_id"]).select("position", "doc_id").collect())
    assert [got[k] for k in range(at)] == want


def test_no_passage_of_fifty_words_is_left_in_two_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def shared(rows):
        held = {}
        for i, text in rows:
            words = text.split()
            for k in range(len(words) - 49):
                held.setdefault(" ".join(words[k : k + 50]), set()).add(i)
        return sum(len(ids) > 1 for w, ids in held.items() if len(w.encode()) >= corpus_pipeline.PASSAGE_BYTES)

    assert shared([(r["doc_id"], r["text"]) for r in docs.collect()]) > 1000
    out = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert len(out) == docs.count()
    assert shared([(r["doc_id"], r["text"]) for r in out]) == 0


def test_pipeline_carries_the_mix(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} of a source " + "word " * (i % 40), "en", "hot" if i % 3 else "rare", 0) for i in range(2000)]
    frame(spark, rows).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    got = {r["position"]: r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    places = mixing.schedule(frame(spark, rows)).orderBy("position").collect()
    assert [got[k] for k in range(2000)] == [r["doc_id"] for r in places]


def test_stages_of_awkward_and_empty_tables(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "repeated_passages", "mixing", "bpe"]
    extra = frame(spark, AWKWARD).withColumn("key", F.lit("clash")).withColumn("kept", F.lit(True))
    for df in (frame(spark, AWKWARD), extra, extra.limit(0)):
        docs = materialise(df, "docs")
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, docs, ""), name)
            if name != "bpe":
                assert out.columns == df.columns
                assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            docs = out if name != "quality_rules" else docs  # the short rows go there; the other stages shall see them
        if df.columns and df.limit(1).count():
            assert docs.count() == 6


def test_each_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in quality_rules.keep(docs).collect()}
    long_enough = {r["doc_id"] for r in docs.collect() if len(r["text"].split()) >= 20}
    assert len(clean & long_enough - kept) <= 0.01 * len(clean)
    one = {r["doc_id"] for r in near_dedup.keep_one(docs).collect()}
    groups = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert {groups[i] for i in one} == set(groups.values())
    assert len(one) == len(set(groups.values()))
    assert substrings.without_repeats(docs).count() == docs.count()
