from datetime import datetime

from pyspark.sql import functions as F

from corpuloom import schemas
from corpuloom.functions import text
from corpuloom.operators import mining, paths, search, traces, vault
from corpuloom.sources import files


def test_path_index_is_complete_once_marked(spark, tmp_path):
    e = spark.createDataFrame([(bytearray(b"a\xff"), "a\ufffd", "", "a\ufffd", "file", 3, 1.0), (bytearray(b"d"), "d", "", "d", "dir", 0, 1.0)], schemas.ENTRIES)
    paths.build(e, str(tmp_path / "i"), 5.0)
    assert spark.read.parquet(str(tmp_path / "i" / "complete")).first().asDict() == {"entries": 2, "paths_not_utf8": 1, "built_at": 5.0}
    assert paths.mangled(spark.read.parquet(str(tmp_path / "i" / "entries"))).count() == 1
    assert paths.shown_of(e.limit(1), e).first().asDict() == {"shown": 1, "total": 2}


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, paths.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, paths.insert_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_chunks_by_address(spark):
    rows = [(1, bytearray(b"x/a.txt"), "x/a.txt", "h", "file", None, None, 0, 10, False, None, False, None), (2, bytearray(b"b\xff"), "shown b", "h", "file", None, None, 5, 9, False, None, False, "cp1252")]
    c = spark.createDataFrame(rows, schemas.CHUNKS)
    asked = spark.createDataFrame([("x/a.txt#L0-10",), ("shown b#L5-9",), ("x/a.txt#L0-11",), ("junk",)], "address string")
    assert {(r["address"], r["id"]) for r in search.addressed(c, asked).collect()} == {("x/a.txt#L0-10", 1), ("shown b#L5-9", 2)}
    line = spark.createDataFrame([("see x/a.txt#L0-10 [file]\nbody y.txt#L1-2",)], "l string")
    assert line.select(search.address_of_line(F.col("l"))).first()[0] == "x/a.txt#L0-10"
    known = spark.createDataFrame([(bytearray(b"x/a.txt"), "latin-1"), (bytearray(b"b\xff"), "cp1252")], "raw binary, encoding string")
    assert [bytes(r["source"]) for r in search.repairs(c, known).collect()] == [b"x/a.txt"]


def test_plans(spark):
    ranked = spark.createDataFrame([("a", 3, 0, "prose"), ("b", 1, 2, "code")], "source string, served int, cited int, class string")
    assert [r["source"] for r in traces.selected(ranked).collect()] == ["b", "a"]
    assert [r["source"] for r in traces.selected(ranked, 5, True).collect()] == ["b"]
    assert traces.plan_histogram(ranked).count() == 2


def test_members(spark):
    df = spark.createDataFrame([("a/B.TXT", "bad Passphrase"), ("a.png", None)], "m string, e string")
    assert [tuple(r) for r in df.select(mining.is_text_member(F.col("m")), mining.fault_class(F.col("e"))).collect()] == [(True, "encrypted"), (False, "failed")]
    refs = spark.createDataFrame([("c.rar!x", "c.rar", "x")], "ref string, container string, member string")
    e = spark.createDataFrame([("c.rar", bytearray(b"c.rar"))], "path string, raw binary")
    k = spark.createDataFrame([(bytearray(b"c.rar"), "hash")], "raw binary, head_hash string")
    src = spark.createDataFrame([("hash", "data")], "source_hash string, content string")
    cache = mining.derive(src, spark.createDataFrame([], schemas.DERIVED), lambda d: d.select("key", F.upper("content").alias("text")), "extract_text")
    assert [tuple(r) for r in mining.member_text(refs, e, k, cache).collect()] == [("c.rar!x", "DATA")]


def test_notes_of_a_model(spark):
    rows = spark.createDataFrame([("p", "First Berlin. Then."), ("q", "Other words here.")], "path string, body string")
    said = spark.createDataFrame([("p", "A model's line", ["x"])], "path string, said string, words array<string>")
    got = {r["path"]: (r["summary"], r["keywords"]) for r in vault.described(rows, said).collect()}
    assert got == {"p": ("A model's line", ["x"]), "q": ("Other words here.", ["other"])}


def test_questions_and_types(spark, tmp_path):
    asked = spark.createDataFrame([(1, "alpha", "A?"), (2, "beta", "B?")], "place int, id string, question string")
    assert files.select_questions(asked, "2").first()["id"] == "beta"
    assert files.select_questions(asked, "alp").first()["place"] == 1
    files.write_questions(asked, str(tmp_path / "q"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "q")).count() == 2
    files.append_lines(asked, str(tmp_path / "e"))
    files.append_lines(asked, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 4
    assert spark.range(1).select(files.media_type(F.lit("a/B.PDF")), files.media_type(F.lit("x"))).first() == ("application/pdf", None)


def test_next_at(spark):
    now = F.lit("2024-01-01 10:30:00").cast("timestamp")
    got = spark.range(1).select(text.next_at(now, "11:00").alias("a"), text.next_at(now, "10:30:00").alias("b")).first()
    assert (got["a"], got["b"]) == (datetime(2024, 1, 1, 11), datetime(2024, 1, 2, 10, 30))


def test_a_note_last_read_now_is_touched_only_if_returned(spark, tmp_path):
    from corpuloom.plans.more import _NOW
    from corpuloom.plans.stored import QUERIES

    n = int(_NOW // 3600)  # this page's own last access is the query's now
    rows = [(n, "no word of the search", "en", "s", 21)] + [(i, "ble ly " + "x " * (i % 7), "en", "s", 10) for i in range(1, 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["path"]: (r["access_count"], r["now"]) for r in QUERIES["mem_touched"](spark, str(tmp_path)).collect()}
    assert got[f"notes/page-{n}.md"] == (0, False) and sum(now for _, now in got.values()) == 5
