import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuloom.sources import files, tree
from corpuloom.streaming import jobs


@pytest.fixture()
def root(tmp_path):
    top = tmp_path / "corpus"
    (top / "a" / "b").mkdir(parents=True)
    (top / "a" / "x.txt").write_text("hello")
    (top / "a" / "b" / "deep.txt").write_text("deep")
    (top / "top.txt").write_bytes(b"t")
    with open(os.path.join(os.fsencode(top), b"bad\xff.txt"), "wb") as f:
        f.write(b"z")
    os.symlink("/etc", top / "a" / "link")
    return str(top)


def test_tree(spark, root):
    tree.register(spark)
    rows = {bytes(r["raw"]): r for r in spark.read.format("filetree").load(root).collect()}
    assert set(rows) == {b"a", b"a/x.txt", b"a/b", b"a/b/deep.txt", b"top.txt", b"bad\xff.txt", b"a/link"}
    assert rows[b"a/link"]["kind"] == "symlink"
    assert rows[b"bad\xff.txt"]["path"] == "bad�.txt"
    assert rows[b"a/x.txt"]["parent"] == "a" and rows[b"a/x.txt"]["size"] == 5
    read = spark.read.format("filetree").option("content", "true").option("maxBytes", "3").load(root)
    assert {bytes(r["raw"]): r["content"] for r in read.where("kind = 'file'").collect()}[b"a/x.txt"] == b"hel"
    assert spark.read.format("filetree").load(root + "/nowhere").count() == 0


def test_containment(root):
    assert tree.contained(root.encode(), b"a/x.txt").endswith(b"a/x.txt")
    for bad in (b"/etc/passwd", b"../x", b"a/link/passwd", b"a\x00b", b"C:x"):
        with pytest.raises(ValueError, match="tree"):
            tree.contained(root.encode(), bad)
    with pytest.raises(ValueError, match="within"):
        tree.assert_outside(root, root + "/out")


def test_trajectories(spark, tmp_path):
    lines = [json.dumps({"event": "start", "timestamp": 1.0, "query": "q"}), json.dumps({"event": "corpus_served", "timestamp": 2.0, "turn": 1, "addresses": [{"address": "a#L0-1", "band": "strong"}]}), json.dumps({"event": "new_kind"}), "[1]", '{"event": "en']
    (tmp_path / "run1.jsonl").write_text("\n".join(lines))
    events, told = files.trajectories(spark, str(tmp_path))
    assert {r["event"] for r in events.collect()} == {"start", "corpus_served"}
    got = told.first()
    assert (got["run_id"], got["torn"], got["unknown"], got["ended"]) == ("run1", 2, 1, False)


def test_metrics_log(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"kind": "end", "model": "m", "seconds": 2.5}\n{"kind"')
    got = sorted((r["model"], r["torn"], r["seconds"]) for r in files.metrics(spark, str(tmp_path)).collect())
    assert got == [("m", False, 2.5), ("unknown", True, None)]


def test_pages(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text('---\nid: X1\nkind: note\ntitle: "A title"\ntags: [a, "b"]\nschema: 1\nupdated: 2024-01-02T00:00:00Z\n---\nBody [[B]]\n')
    (tmp_path / "notes" / "b.md").write_text("---\nid: X2\nkind: topic\ntags:\n  - c\n  - d\n---\nB")
    (tmp_path / "bad.md").write_text("no head")
    pages, faults = files.pages(spark, str(tmp_path))
    got = {r["path"]: r for r in pages.collect()}
    assert set(got) == {"notes/a.md", "notes/b.md"}
    assert got["notes/a.md"]["tags"] == ["a", "b"] and got["notes/b.md"]["tags"] == ["c", "d"]
    assert got["notes/a.md"]["title"] == "A title" and got["notes/a.md"]["schema_version"] == 1
    assert got["notes/a.md"]["body"] == "Body [[B]]\n"
    assert [r["path"] for r in faults.collect()] == ["bad.md"]


def test_questions_and_plan(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# head\nfirst\tWhat is it?\nWho came?\nfirst\tAgain?\n\n")
    got = [tuple(r) for r in files.questions(spark, str(tmp_path / "q.txt")).orderBy("place").collect()]
    assert got == [(1, "first", "What is it?"), (2, "q2", "Who came?"), (3, "first-2", "Again?")]
    (tmp_path / "plan.tsv").write_text("source\tserved\tcited\na\t3\tx\n\t1\t1\nb\t-2\t4\n")
    plan, dropped = files.read_plan(spark, str(tmp_path / "plan.tsv"))
    assert sorted(tuple(r) for r in plan.collect()) == [("a", 3, 0), ("b", 0, 4)]
    assert dropped.first()["dropped"] == 1


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("t/x")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    rows = [(b"1", "a.bin", zipped({"d/x.txt": "hello"})), (b"2", "b", tar.getvalue()), (b"3", "c.txt.gz", gzip.compress(b"zz")), (b"4", "d", b"plain"), (b"5", "e.zip", zipped({"x": "y"})[:-5])]
    df = spark.createDataFrame([(bytearray(a), b, bytearray(c)) for a, b, c in rows], "raw binary, name string, content binary")
    got = {(bytes(r["container"]), r["member"], r["size"]) for r in files.list_archives(df).collect()}
    assert {(b"1", "d/x.txt", 5), (b"2", "t/x", 3), (b"3", "c.txt", 2)} <= got
    assert all(k != b"4" for k, _, _ in got)


def test_document_text(spark):
    docx = zipped({"word/document.xml": "<w:t>Hello &amp; good</w:t><w:t>bye</w:t>", "word/media/x.png": "zz"})
    df = spark.createDataFrame([(bytearray(b"1"), bytearray(docx)), (bytearray(b"2"), bytearray(b"junk"))], "raw binary, content binary")
    got = {bytes(r["raw"]): (r["text"], r["note"]) for r in files.document_text(df).collect()}
    assert got == {b"1": ("Hello & good bye", None), b"2": ("", "needs_ocr")}


def test_model_ids(spark):
    df = spark.createDataFrame([('{"data": [{"id": "a", "status": {"value": "loaded"}}, {"id": "b", "status": {"value": "unloaded"}}, {"id": "c"}, {"id": "d", "status": "Loading"}]}',)], "value string")
    held = files.model_ids(df)
    assert {r["id"] for r in held.collect()} == {"a", "d"}  # c does not say, which means unknown
    assert [tuple(r) for r in files.resident_conflict(held, "a").collect()] == [(1, ["d"])]
    assert files.resident_conflict(held.where("id = 'a'"), "a").count() == 0


# --- Streams give what tables give


def test_stream_of_sessions_equals_batch(spark, tmp_path, sf):
    src = tmp_path / "src"
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    e.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(e.schema).parquet(str(src))
    q = jobs.sessions(stream, "user_id", delay="60 days").writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in jobs.sessions(e, "user_id").collect()}
    got = {tuple(r) for r in spark.table("sess").collect()}
    assert got <= batch  # the last sessions wait for the watermark
    state = jobs.stateful_states(stream.withColumnRenamed("event_type", "state"), ["user_id"], "event_id")
    q = state.writeStream.outputMode("complete").format("memory").queryName("st").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in jobs.stateful_states(e.withColumnRenamed("event_type", "state"), ["user_id"], "event_id").collect()}
    assert {tuple(r) for r in spark.table("st").collect()} == want


def test_work_is_done_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("q", "out", "ck"))
    spark.range(10).select(F.col("id").cast("string").alias("raw")).repartition(2).write.parquet(src)

    def handler(rows):
        return rows.withColumn("state", F.lit("done"))

    for _ in range(2):
        stream = spark.readStream.schema("raw string").option("maxFilesPerTrigger", 1).parquet(src)
        jobs.work(stream, handler, out, ck).awaitTermination(120)
    done = spark.read.parquet(out)
    assert done.count() == 10
    assert done.select("raw").distinct().count() == 10


def test_event_stream_drops_torn_lines(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.jsonl").write_text('{"event": "start", "timestamp": 1.5}\n{"event": "en')
    q = jobs.event_log(spark, str(tmp_path / "e")).writeStream.format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["event"] for r in spark.table("ev").collect()] == ["start"]


def test_in_flight(spark):
    a = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01 00:00:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2024-01-01 00:00:00'")
    b = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01 00:10:00' AS ts")
    got = {r["k"]: r["ended"] is None for r in jobs.in_flight(a, b, ["k"]).collect()}
    assert got == {1: False, 2: True}


def renamed(page):
    """The head's old key renamed, or dropped where the new one is there, line by line."""
    parts = page.split("\n")
    if parts[0].rstrip() != "---" or "---" not in [p.rstrip() for p in parts[1:]]:
        return page
    end = next(i for i, p in enumerate(parts) if i and p.rstrip() == "---")
    if end == len(parts) - 1 or end == 1:
        return page
    head = parts[1:end]
    at = next((i for i, h in enumerate(head) if h.startswith("schema:")), None)
    if at is None:
        return page
    if any(h.startswith("schema_version:") for h in head):
        head = head[:at] + head[at + 1 :] if at else ["", *head[1:]]
    else:
        head[at] = "schema_version:" + head[at][len("schema:") :]
    return "\n".join([parts[0], *head, *parts[end:]])


def test_heads_are_migrated_and_nothing_else(spark, tmp_path):
    import itertools

    from corpuloom.functions import text
    from corpuloom.operators import vault
    from corpuloom.sources.commits import Table

    lines = ["schema: 1", "schema:", "schema_version: 2", "kind: note", "myschema: 3"]
    pages = ["---\n" + "\n".join(h) + "\n---\nschema: body\n" for n in (1, 2, 3) for h in itertools.permutations(lines, n)] + ["", "schema: 1", "---\nschema: 1", "--- \nschema: 1\n---\n", "x\n---\nschema: 1\n---\n"]
    df = spark.createDataFrame(list(enumerate(pages)), "i long, page string")
    got = dict(df.select("i", text.migrated_head(F.col("page"))).collect())
    assert {pages[i]: p for i, p in got.items()} == {p: renamed(p) for p in pages}
    kept = Table(spark, f"file://{tmp_path}/p", "path string, content string", ["path"])
    kept.upsert(spark.createDataFrame([("a", pages[0]), ("b", "none")], "path string, content string"))
    assert vault.migrate(kept) == (2, 1) and vault.migrate(kept) == (2, 0)
    assert {r["path"]: r["content"] for r in kept.read().collect()} == {"a": renamed(pages[0]), "b": "none"}


def test_paths_are_checked_by_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    os.symlink("/etc", tmp_path / "in" / "out")
    rows = spark.createDataFrame([("a/../b", 1), ("out/passwd", 2), ("/a", 3), (None, 4), ("c:x", 5), ("", 6)], "p string, real_ int")
    got = {r["real_"]: r["real"] for r in tree.checked(rows, "p", str(tmp_path / "in")).collect()}
    top = os.path.realpath(tmp_path / "in")
    assert got == {1: top + "/b", 2: None, 3: None, 4: None, 5: None, 6: top}
    pairs = spark.createDataFrame([("/c", "/c/d"), ("/c", "/cd"), ("/c", None), ("/c", "/c")], "a string, b string")
    assert [r["outside"] for r in tree.outside(pairs, "a", "b").collect()] == [False, True, None, False]


def test_tasks_that_read_pages_do_not_grow_with_the_files(spark, tmp_path):
    """Pages below a folder are read by a number of tasks that the cores give; hidden files and other endings are left out."""
    for i in range(40 * files.FILE_TASKS * spark.sparkContext.defaultParallelism):
        at = tmp_path / f"d{i % 3}" / f"p{i}.md"
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"---\nid: d%d\nkind: note\n---\r\nbody %d" % (i, i))
    for other in ("x.txt", "_p.md", ".p.md"):
        (tmp_path / other).write_text("---\nid: x\nkind: note\n---\n")
    (tmp_path / "bare.md").write_text("no head")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found, faults = files.pages(spark, path)
        assert found.rdd.getNumPartitions() <= files.FILE_TASKS * spark.sparkContext.defaultParallelism
        rows = {r["path"]: (r["id"], r["body"]) for r in found.collect()}
        assert rows == {f"d{i % 3}/p{i}.md": (f"d{i}", f"body {i}") for i in range(i + 1)}
        assert [r["path"] for r in faults.collect()] == ["bare.md"]
