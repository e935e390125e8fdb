import random
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuloom import schemas
from corpuloom.operators import context, metrics, mining, paths, traces, vault


@pytest.fixture(scope="module")
def entries(spark):
    names = ["a/readme.md", "a/x.txt", "a/b/x.txt", "ab/y.txt", "c.zip", "a/100%_x.txt"]
    rows = [(bytearray(n.encode()), n, n.rpartition("/")[0], n.rpartition("/")[2], "file", len(n), float(i)) for i, n in enumerate(names)]
    rows.append((bytearray(b"a"), "a", "", "a", "dir", 0, 5.0))
    return spark.createDataFrame(rows, schemas.ENTRIES)


def test_find_and_scope(entries):
    assert [r["path"] for r in paths.find(entries, "X.TXT").collect()] == ["a/b/x.txt", "a/x.txt", "a/100%_x.txt"]
    assert [r["path"] for r in paths.find(entries, "b/x").collect()] == ["a/b/x.txt"]
    assert [r["path"] for r in paths.find(entries, "%_").collect()] == ["a/100%_x.txt"]
    assert {r["path"] for r in paths.scope(entries, "file", "a").collect()} == {"a/readme.md", "a/x.txt", "a/b/x.txt", "a/100%_x.txt"}
    assert paths.clamp(0) == 1 and paths.clamp(999) == 200 and paths.clamp("x") == 200
    assert paths.count(entries, "dir").first()["n"] == 1
    assert paths.raw_for(entries, "a/x.txt").first()["raw"] == b"a/x.txt"
    assert paths.raw_for(entries.union(entries), "a/x.txt").first()["raw"] is None


def test_container_reference(spark, entries):
    refs = spark.createDataFrame([("c.zip!in/x",), ("zz!y",), ("a/x.txt",)], "ref string")
    assert [tuple(r) for r in paths.container_of(entries, refs).collect()] == [("c.zip!in/x", "c.zip", "in/x")]


def test_digest_is_alike_however_dealt(entries):
    a = paths.digest(entries.repartition(1)).first()
    b = paths.digest(entries.repartition(7)).first()
    assert a == b
    assert paths.compare_digests(paths.digest(entries), paths.digest(entries)).first()["verdict"] == "equal"
    assert paths.compare_digests(paths.digest(entries), paths.digest(entries.where("kind = 'file'"))).first()["verdict"] == "count"


def test_digest_sum_and_xor_modulo(entries):
    from corpuloom.functions.binary import _entry_digest

    whole = [int.from_bytes(_entry_digest(bytes(r["raw"]), r["kind"], r["size"], r["mtime"]), "big") for r in entries.collect()]
    got = paths.digest(entries).first()
    x = 0
    for w in whole:
        x ^= w
    assert int(got["xor"], 16) == x
    assert int(got["sum"], 16) == sum(whole) % 2**256


def test_newer_than(entries):
    got = paths.newer_than(entries, 2.0, 3.0, slack=1.0).first()
    assert (got["newer"], got["in_window"], got["future"], got["stale"]) == (4, 2, 2, 3)


def test_classify_and_copies(spark):
    files = spark.createDataFrame([(bytearray(b"1"), bytearray(b"same")), (bytearray(b"2"), bytearray(b"same")), (bytearray(b"3"), bytearray(b"\x1f\x8b\x08z"))], "raw binary, content binary")
    c = paths.classify(files)
    assert sorted(r["kind"] for r in c.collect()) == ["archive", "text", "text"]
    sized = c.join(files.select("raw", F.octet_length("content").alias("size")), "raw")
    got = paths.copies(sized, "head_hash", "size").first()
    assert (got["files"], got["distinct_contents"], got["duplicate_bytes"]) == (3, 2, 4)
    assert paths.pending(files, c).count() == 0
    assert [r["encoding"] for r in paths.by_encoding(c).collect()] == ["utf-8", "(none)"]


def test_planning_twice_plans_nothing(spark):
    rows = [("x.docx", "archive"), ("y.rar", "archive"), ("z.zip", "archive"), ("t.txt", "text"), ("p.pdf", "document"), ("t.docx", "text"), ("i.png", "media")]
    e = spark.createDataFrame([(bytearray(n.encode()), n) for n, _ in rows], "raw binary, name string")
    c = spark.createDataFrame([(bytearray(n.encode()), k) for n, k in rows], "raw binary, kind string")
    none = spark.createDataFrame([], schemas.QUEUE)
    new = mining.plan(e, c, none)
    got = sorted((bytes(r["raw"]).decode(), r["task"], r["priority"]) for r in new.collect())
    assert got == [("p.pdf", "extract_text", 10), ("t.docx", "index_text", 20), ("t.txt", "index_text", 20), ("x.docx", "extract_text", 10), ("y.rar", "extract_text", 10), ("y.rar", "list_archive", 30), ("z.zip", "list_archive", 30)]
    assert mining.plan(e, c, new).count() == 0
    queue = new.withColumn("state", F.lit("pending")).withColumn("note", F.lit("n"))
    assert bytes(mining.claim(queue, list(mining.TASKS), 1).first()["raw"]) == b"p.pdf"
    failed = queue.withColumn("state", F.lit("failed"))
    assert mining.reopen(failed, "failed", "list_archive").where("state = 'pending'").count() == 2


def test_derivation_runs_once_for_copies(spark):
    asked = []
    src = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "source_hash string, content string")
    cache = spark.createDataFrame([], schemas.DERIVED)

    def engine(df):
        asked.append(df.count())
        return df.select("key", F.upper("content").alias("text"))

    out = mining.derive(src, cache, engine, "upper").withColumn("chars", F.length("text"))
    assert asked == [2]
    assert sorted(r["text"] for r in out.collect()) == ["A", "B"]
    assert mining.derive(src, out, engine, "upper").count() == 0


def test_snapshots_and_freshness(spark):
    snap = mining.publish(spark.range(1).select(F.lit(3).alias("n")), "coverage", 10.0).union(mining.publish(spark.range(1).select(F.lit(4).alias("n")), "coverage", 20.0))
    assert mining.published(snap, "coverage", 25.0).first().asDict() == {"value": '{"n":4}', "age": 5.0}
    assert mining.published(snap, "other", 25.0).first()["value"] is None
    live = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, fingerprint string")
    was = spark.createDataFrame([("a", "1"), ("b", "9")], "name string, fingerprint string")
    assert {r["name"]: r["verdict"] for r in mining.freshness(was, live).collect()} == {"a": "current", "b": "stale", "c": "unknown"}


def page(path, **kw):
    t = datetime(2024, 1, 1, tzinfo=UTC)
    base = dict(path=path, id=path, kind="note", name=path.rsplit("/", 1)[-1][:-3], title="T", summary="S", tags=["x"], version=1, hash=None, status="active", superseded_by=None, created=t, updated=t, access_count=0, last_access=None, schema_version=1, body="some body")
    return base | kw


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        page("notes/alpha.md", body="cat and dog [[Beta|b]]", tags=["a", "b"]), page("notes/beta.md", body="dog only [[alpha]] [[nowhere]]", tags=["b"]), page("notes/old.md", body="dog dog", status="deprecated"),
        page("quarantine/q.md", body="dog", status="pending"), page("helpers/peek.md", kind="helper", body="cat"), page("memory/notes/core-memory.md", body="dog core", updated=datetime(2020, 1, 1, tzinfo=UTC)),
    ]
    return spark.createDataFrame([tuple(r.values()) for r in rows], schemas.PAGES)


def test_vault_search_and_links(spark, pages):
    index = vault.tables(pages)
    assert {r["path"] for r in vault.find(index, "dog").collect()} == {"notes/alpha.md", "notes/beta.md", "memory/notes/core-memory.md"}
    assert {r["path"] for r in vault.find(index, "dog", tags=["a"]).collect()} == {"notes/alpha.md"}
    assert {r["path"] for r in vault.find(index, "dog", states=["deprecated"]).collect()} == {"notes/old.md"}
    assert {r["path"] for r in vault.find(index, "cat", kinds=["helper"]).collect()} == {"helpers/peek.md"}
    got = {(r["src"], r["dst"]): r["path"] for r in vault.resolve_links(index["links"], pages).collect()}
    assert got[("notes/alpha.md", "Beta")] == "notes/beta.md"
    assert got[("notes/beta.md", "nowhere")] is None
    assert [r["path"] for r in vault.listed(pages, "quarantine").collect()] == ["quarantine/q.md"]
    assert "quarantine/q.md" not in [r["path"] for r in vault.listed(pages).collect()]
    assert vault.search_quarantine(pages, "DOG").count() == 1


def test_delta_equals_rebuild(spark, pages):
    hashed = vault.content_hash(pages)
    live = hashed.where("path <> 'notes/old.md'").withColumn("status", F.when(F.col("path") == "notes/beta.md", "deprecated").otherwise(F.col("status")))
    assert {(r["path"], r["change"]) for r in vault.delta(hashed, live).collect()} == {("notes/old.md", "removed"), ("notes/beta.md", "changed")}
    assert {(r["path"], r["change"]) for r in vault.delta(hashed, live, state=False).collect()} == {("notes/old.md", "removed")}


def test_review(spark, pages):
    code = "## Signature\n\n```python\nf(x)\n```\n## Implementation\n\n```python\nimport os\ndef g(x):\n    return x\n```"
    rows = [page("q/1.md", kind="helper", name="f", body=code), page("q/2.md", kind="note", name="alpha", body="ok [[zzz]]"), page("q/3.md", kind="note", name="fresh", body="fine")]
    new = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.PAGES)
    told = {r["path"]: r for r in vault.validate(new, pages).collect()}
    assert told["q/1.md"]["errors"] == ["does not define its name", "import of os"]
    assert told["q/2.md"]["warnings"] == ["link to nothing: zzz"]
    out = {r["path"]: r for r in vault.promote(new, pages, vault.validate(new, pages)).collect()}
    assert (out["q/1.md"]["outcome"], out["q/2.md"]["outcome"], out["q/3.md"]["outcome"]) == ("invalid", "occupied", "promoted")
    assert out["q/3.md"]["version"] == 2
    assert vault.demote(pages, ["notes/alpha.md", "notes/old.md"]).where("status IN ('deprecated', 'superseded')").count() == 2
    assert vault.propose(new).first()["status"] == "pending"


def test_isolation_and_new_only(spark, pages):
    index = pages.select("path").where("path <> 'quarantine/q.md'")
    assert vault.isolation(index, pages).first().asDict() == {"strays": 0, "leaked": 0}
    incoming = spark.createDataFrame([("h1", " some  "), ("h2", "new"), ("h3", "x")], "hash string, body string")
    stored = spark.createDataFrame([("h3", "y"), ("h9", "some")], "hash string, body string")
    assert [r["hash"] for r in vault.new_only(incoming, stored).collect()] == ["h2"]


def test_memory(spark, pages):
    scored = spark.createDataFrame([("notes/alpha.md", 3.0), ("notes/beta.md", 1.0)], "doc string, score double")
    now = datetime(2024, 1, 2, tzinfo=UTC).timestamp()
    assert [r["path"] for r in vault.recall(scored, pages, now).collect()] == ["notes/beta.md", "notes/alpha.md"]
    hit = vault.recall(scored, pages, now, corrected=True, k=1)
    assert [r["path"] for r in hit.collect()] == ["notes/alpha.md"]
    assert {r["path"] for r in vault.touched(pages, hit, now).where("access_count = 1").collect()} == {"notes/alpha.md"}
    memory = pages.withColumn("path", F.when(F.col("path").startswith("notes/"), F.concat(F.lit("memory/"), "path")).otherwise(F.col("path")))
    assert {r["path"] for r in vault.forget(memory, "dog", 3600.0, now).where("status = 'deprecated'").collect()} == {"memory/notes/alpha.md", "memory/notes/beta.md", "memory/notes/old.md"}
    assert vault.forget(memory).where("status = 'deprecated'").count() == 1


def test_compaction(spark):
    rows = spark.createDataFrame([("s", "1", "Deploy the server", "old", datetime(2024, 1, 1)), ("s", "2", "Deploy the servers", "new", datetime(2024, 1, 3)), ("s", "3", "Cats", "c", datetime(2024, 1, 2)), ("t", "4", "Cats", "d", datetime(2024, 1, 2))], "scope string, path string, title string, body string, updated timestamp")
    found = vault.clusters(rows)
    assert {(r["path"], r["keeper"]) for r in found.collect()} == {("1", "2"), ("2", "2"), ("3", "3"), ("4", "4")}
    merged = vault.compact(rows, found).collect()
    assert [(r["path"], r["body"], r["absorbed"]) for r in merged] == [("2", "new\n\n---\n\nold", ["1"])]
    assert len(merged) == found.where("path <> keeper").select("keeper").distinct().count()


def test_traces(spark):
    served = spark.createDataFrame([("r", "a#L0-9", "strong"), ("r", "b#L0-9", None), ("r", "c#L10-19", "weak")], "run_id string, address string, band string")
    cited = spark.createDataFrame([("r", "a#L0-9"), ("r", "b#L0-9"), ("r", "c#L10-91"), ("q", "z#L0-1")], "run_id string, address string")
    got = {r["run_id"]: r for r in traces.audit(served, cited).collect()}
    assert (got["r"]["answering"], got["r"]["non_answering"], got["r"]["unserved"], got["r"]["left"]) == (["a#L0-9"], ["b#L0-9"], ["c#L10-91"], ["c#L10-19"])
    assert got["q"]["unknown"] == ["z#L0-1"]
    assert [tuple(r) for r in traces.corruption(served, cited).collect()] == [("r", "c#L10-91", "c#L10-19")]
    answers = spark.createDataFrame([("r",), ("q",), ("n",)], "run_id string")
    assert {r["run_id"]: r["refusal"] for r in traces.refusals(traces.audit(served, cited), answers).collect()} == {"r": "unserved", "q": None, "n": "uncited"}
    used = traces.usage(served, cited).collect()
    assert [(r["source"], r["served"], r["cited"]) for r in used] == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("z", 0, 1)]


def test_metrics(spark):
    rows = [("start", "m", "t1"), ("end", "m", "t1"), ("start", "m", "t2")]
    df = spark.createDataFrame([(k, m, 4.0 if k == "end" else None, s, *[None] * 15) for k, m, s in rows], schemas.METRICS)
    got = metrics.by_model(df).first()
    assert (got["attempted"], got["in_flight"], got["usable"], got["seconds_median"], got["prompt_ms_median"]) == (1, 1, 1, 4.0, None)
    probes = spark.createDataFrame([("m", "P1", 10.0, 20.0), ("m", "P4", 15.0, 15.0)], "model string, probe string, score double, max_score double")
    weights = spark.createDataFrame(list(metrics.PROFILES["default"].items()), "probe string, weight int")
    assert metrics.weighted_scores(probes, weights).first()["score"] == 83.3
    trials = spark.createDataFrame([("m", "voluntary"), ("m", "forced"), ("m", "none")], "model string, outcome string")
    assert tuple(metrics.trial_score(trials).first()) == ("m", 7.7, False)
    tasks = spark.createDataFrame([("s", "a", "4[12]"), ("s", "b", "x")], "suite string, name string, expected_pattern string")
    answers = spark.createDataFrame([("s", "a", "it is 42")], "suite string, name string, answer string")
    assert metrics.evaluate(answers, tasks).first()["score"] == 0.5
    was = spark.createDataFrame([("train", 0.5), ("held_out", 0.5)], "split string, score double")
    now = spark.createDataFrame([("train", 0.6), ("held_out", 0.5)], "split string, score double")
    assert metrics.gate(now, was).first()["accepted"] is True
    assert metrics.gate(was, was).first()["accepted"] is False


def test_context(spark):
    docs = spark.createDataFrame([(1, "é1\r\nb\n"), (2, None)], "id long, t string")
    got = [tuple(r) for r in context.lines(docs, "id", "t").where("id = 1").orderBy("line_no").collect()]
    assert got == [(1, 0, 0, 4, "é1"), (1, 1, 5, 6, "b"), (1, 2, 7, 7, "")]
    assert [tuple(r) for r in context.grep(docs, "id", "t", "[a-z]").collect()] == [(1, 1, "b")]
    assert context.byte_slice(docs, "id", "t", 0, 1).first()["text"] is None
    assert context.byte_slice(docs, "id", "t", 0, 2).first()["text"] == "é"


def test_map_query_asks_once(spark, tmp_path):
    log = tmp_path / "asked"

    def model(prompts):
        with log.open("a") as f:
            f.writelines(p + "\n" for p in prompts)
        if "boom" in prompts:
            raise ValueError("boom")
        return [p.upper() for p in prompts]

    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, text string")
    got = {r["id"]: r["answer"] for r in context.map_query(items, "<{text}>", model).collect()}
    assert got == {1: "<A>", 2: "<A>", 3: "<>"}
    assert sorted(log.read_text().split("\n")) == ["", "<>", "<a>"]
    bad = context.map_query(spark.createDataFrame([(1, "boom")], "id long, text string"), "{text}", model).first()
    assert bad["answer"] == "[error: boom]"


def test_budget_equals_a_loop(spark):
    r = random.Random(5)
    rows = [(i % 3, i, r.randrange(50)) for i in range(90)]
    got = {(x["g"], x["o"]): x["accepted"] for x in context.budgeted(spark.createDataFrame(rows, "g long, o long, c long"), "g", "o", "c", 12, 300).collect()}
    for g in range(3):
        n = used = 0
        for _, o, c in [x for x in rows if x[0] == g]:
            ok = n < 12 and used + c <= 300
            n, used = n + ok, used + c * ok
            assert got[(g, o)] == ok


def test_islands_and_recovery(spark):
    df = pd.DataFrame({"r": ["a"] * 5, "turn": range(5), "failed": [True, True, False, True, False]})
    rows = spark.createDataFrame(df)
    assert sorted((x["length"], x["first"]) for x in traces.islands(rows, "r", "turn", "failed").collect()) == [(1, 3), (2, 0)]
    assert traces.recovered(rows, "r").first()["recovered"] is True
    assert traces.recovered(rows.where("turn < 2"), "r").first()["recovered"] is False


def test_retention_ranks_only_what_is_kept(spark):
    rows = [(f"f{i}", float(i % 7) if i % 5 else None) for i in range(40)] + [(None, 3.0), (None, None)]
    df = spark.createDataFrame(rows, "name string, mtime double")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or ""))
    for keep in (0, 1, 9, 20, 35, 41, 42, 60):
        got = [tuple(r) for r in traces.retention(df, keep).collect()]
        assert sorted(got, key=str) == sorted(order[keep:], key=str), keep
    assert "Window" not in traces.retention(df, 9)._jdf.queryExecution().executedPlan().toString()


def test_needles_count_every_task(spark):
    from corpuloom.operators import probes

    answers = spark.createDataFrame([("m", 1, "The-Needle"), ("m", 2, "none"), ("m", 2, "B b"), ("n", 9, "x"), ("o", 1, None)], "model string, task int, answer string")
    tasks = spark.createDataFrame([(1, "needle"), (2, "bb"), (3, "c")], "task int, needle string")
    got = sorted(map(tuple, probes.needles(answers, tasks).collect()))
    assert got == [("m", 10.0, 20.0, True), ("n", 0.0, 15.0, False), ("o", 0.0, 15.0, False)]
