"""Registered queries of what is stored and changes: committed tables, indexes of segments, stateful events.

Documents are pages and cache entries here, orders rows that are written again, and
events the log of queues, locks and cells.
"""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..operators import merkle, search, segments, vault
from ..sources import archives, files, tree
from ..sources.commits import Table
from ..streaming import stateful
from .more import QUERIES, SQL
from .queries import _bm25_sql, folder, query, table

__all__ = ["QUERIES", "SQL"]

# --- Committed tables


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS v, o_custkey FROM orders WHERE o_orderkey % 11 <> 3 AND (o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0)")
def jn_upsert_committed(spark, sf):
    """JN-08: rows of later commits in place of the same keys, deleted ones gone, after a compaction."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kept = Table(spark, folder(spark, "orders"), "o_orderkey bigint, v string, o_custkey bigint", ["o_orderkey"])
    kept.upsert(o.where("o_orderkey % 7 <> 0").withColumn("v", F.lit("old")))
    kept.upsert(o.where("o_orderkey % 5 = 0").withColumn("v", F.lit("new")))
    kept.delete(o.where("o_orderkey % 11 = 3"))
    kept.compact()
    return kept.read().select("o_orderkey", "v", "o_custkey")


@query("SELECT source || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'again: ' || text ELSE text END AS body, doc_id % 3 <> 0 AS as_first FROM documents WHERE doc_id % 5 <> 1")
def snk_page_put(spark, sf):
    """SNK-05: pages put, put again and deleted, each a commit; whether a page is as the first version has it."""
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("body"), "doc_id")
    pages = Table(spark, folder(spark, "pages"), "path string, status string, body string", ["path"])
    first = pages.upsert(d.withColumn("status", F.lit("first")))
    pages.upsert(d.where("doc_id % 3 = 0").select("path", F.lit("second").alias("status"), F.concat(F.lit("again: "), "body").alias("body")))
    pages.delete(d.where("doc_id % 5 = 1"))
    old = pages.read(first).select("path", F.col("status").alias("was"))
    return pages.read().join(old, "path").select("path", "status", "body", (F.col("status") == F.col("was")).alias("as_first"))


@query("WITH e AS (SELECT md5(text) AS key, doc_id, lang, length(text) AS chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) SELECT key, lang AS task, chars FROM e WHERE n = 1")
def snk_cache_put(spark, sf):
    """SNK-03: cache entries by their content's key, put once: what is there stays as it is when its key is put again."""
    d = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id", F.col("lang").alias("task"), F.length("text").alias("chars"))
    once = d.groupBy("key").agg(F.min_by(F.struct("task", "chars"), "doc_id").alias("e")).select("key", "e.*")
    cache = Table(spark, folder(spark, "cache"), "key string, task string, chars int", ["key"])
    cache.upsert(once.where(F.col("key") < "8"))
    cache.upsert(once.withColumn("task", F.when(F.col("key") < "8", F.lit("again")).otherwise(F.col("task"))).join(cache.read().select("key"), "key", "left_anti"))
    return cache.read()


def _heads(spark, sf) -> DataFrame:
    """Documents as pages with heads of old and new keys, with both, with neither, and without a head."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    n = F.col("doc_id") % 5
    keys = F.when(n == 0, "schema: 1\nkind: note").when(n == 1, "kind: note\nschema:\t2").when(n == 2, "kind: note\nschema_version: 3\nschema: 1").when(n == 3, "schema: 1\nschema_version: 3").otherwise("kind: note\nmyschema: 1")
    page = F.concat(F.lit("---\nid: d"), F.col("doc_id").cast("string"), F.lit("\n"), keys, F.lit("\n---\n"), "text", F.lit("\nschema: of the body"))
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 11 == 7, F.concat(F.lit("schema: 1\n"), "text")).otherwise(page).alias("content"))


@query(r"""WITH k AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, text, CASE doc_id % 5 WHEN 0 THEN 'schema_version: 1' || chr(10) || 'kind: note' WHEN 1 THEN 'kind: note' || chr(10) || 'schema_version:' || chr(9) || '2' WHEN 2 THEN 'kind: note' || chr(10) || 'schema_version: 3' WHEN 3 THEN 'schema_version: 3' ELSE 'kind: note' || chr(10) || 'myschema: 1' END AS keys FROM documents WHERE text IS NOT NULL)
SELECT path, CASE WHEN doc_id % 11 = 7 THEN 'schema: 1' || chr(10) || text ELSE '---' || chr(10) || 'id: d' || doc_id || chr(10) || keys || chr(10) || '---' || chr(10) || text || chr(10) || 'schema: of the body' END AS content, doc_id % 11 <> 7 AND doc_id % 5 <> 4 AS changed FROM k""")
def str_migrate_heads(spark, sf):
    """STR-23, SNK-05: pages written with the old key's name in their heads, and written again where a migration changes them."""
    pages = Table(spark, folder(spark, "pages"), "path string, content string", ["path"])
    first = pages.upsert(_heads(spark, sf))
    vault.migrate(pages)
    old = pages.read(first).select("path", F.col("content").alias("was"))
    return pages.read().join(old, "path").select("path", "content", (F.col("content") != F.col("was")).alias("changed"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '/x' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN source WHEN 4 THEN NULL ELSE 'y' END AS inside FROM documents")
def src_contained(spark, sf):
    """SRC-05: relative paths that stay within a tree, with what their dots come to, and those that don't."""
    root, n = folder(spark, "root"), F.col("doc_id") % 6
    top = os.path.realpath(root.removeprefix("file://"))
    said = F.when(n == 0, F.concat("source", F.lit("/x"))).when(n == 1, F.concat(F.lit("../"), "source")).when(n == 2, F.concat(F.lit("/"), "source")).when(n == 3, F.concat("source", F.lit("/a/.."))).when(n == 4, F.concat(F.lit("c:"), "source")).otherwise(F.lit("a/../y"))
    rows = tree.checked(table(spark, sf, "documents").select("doc_id", said.alias("said")), "said", root)
    return rows.select("doc_id", F.expr(f"substring(real, {len(top) + 2})").alias("inside"))


@query("SELECT doc_id, doc_id % 4 IN (1, 3) AS outside FROM documents")
def src_outside(spark, sf):
    """SRC-07: places for derived data within the corpus they are derived from are refused, also by way of dots."""
    corpus, n = F.concat(F.lit("/c/"), "source"), F.col("doc_id") % 4
    place = F.when(n == 0, F.concat(corpus, F.lit("/derived"))).when(n == 1, F.concat(corpus, F.lit("-derived"))).when(n == 2, F.concat(F.lit("/d/../c/"), "source")).otherwise(F.concat(corpus, F.lit("/../other/"), "lang"))
    return tree.outside(table(spark, sf, "documents").select("doc_id", corpus.alias("corpus"), place.alias("place")), "corpus", "place").select("doc_id", "outside")


@query("""SELECT event_id, array_to_string(list_transform(range(9, -1, -1), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (((1700000000000 + event_id * 977) >> (5 * i)) & 31)::INT + 1, 1)), '') AS head , true AS valid, true AS again FROM events""")
def hsh_ulid(spark, sf):
    """HSH-09: ids that sort by their time, the same for the same row; the time's digits are the SQL's too."""
    e = table(spark, sf, "events").select("event_id", (F.lit(1_700_000_000_000) + F.col("event_id") * 977).alias("t"))
    made = e.withColumn("id", replies.ulid(F.col("t"), F.col("event_id").cast("string"))).withColumn("twin", replies.ulid(F.col("t"), F.col("event_id").cast("string")))
    return made.select("event_id", F.left("id", F.lit(10)).alias("head"), F.col("id").rlike("^[0-9A-HJKMNP-TV-Z]{26}$").alias("valid"), (F.col("id") == F.col("twin")).alias("again"))


@query("SELECT 'p' || doc_id || '.md' AS path, 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'note' ELSE 'topic' END AS kind, 'Title of ' || doc_id AS title, lang || ' ' || source AS tags, (doc_id % 9)::INT AS version, replace(text, chr(13) || chr(10), chr(10)) AS body FROM documents WHERE doc_id % 140 <> 0")
def src_pages(spark, sf):
    """SRC-15: Markdown files with heads, one page each; a file without a kind is a fault and no page."""
    path = folder(spark, "vault")
    top = path.removeprefix("file://")
    os.makedirs(top, exist_ok=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, lang, source, said in frame.itertuples(index=False):
                kind = "" if i % 140 == 0 else f"kind: {'note' if i % 2 == 0 else 'topic'}\n"
                with open(f"{top}/p{i}.md", "w", encoding="utf-8", newline="") as f:
                    f.write(f'---\nid: d{i}\n{kind}title: "Title of {i}"\ntags: [{lang}, {source}]\nversion: {i % 9}\n---\n{said}')
            yield frame[["doc_id"]]

    table(spark, sf, "documents").select("doc_id", "lang", "source", "text").mapInPandas(write, "doc_id long").count()
    found, _ = files.pages(spark, path)
    return found.select("path", "id", "kind", "title", F.concat_ws(" ", "tags").alias("tags"), "version", "body")


# --- Indexes of segments


def _index(spark, sf) -> segments.Index:
    """Documents added in two parts, some dropped, some replaced, all in one folder of their own."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    index = segments.Index(spark, folder(spark, "segments"))
    index.add(d.where("doc_id % 4 = 0"), "doc_id", "text")
    index.add(d.where("doc_id % 5 <> 0"), "doc_id", "text")
    index.drop(d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("doc")))
    index.replace(d.where("doc_id % 11 = 0").select("doc_id", F.concat(F.lit("ble ly "), "text").alias("text")), "doc_id", "text")
    return index


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'ble ly ' || text ELSE text END AS text FROM documents WHERE doc_id % 11 = 0 OR ((doc_id % 4 = 0 OR doc_id % 5 <> 0) AND doc_id % 7 <> 0))"


def _changed(terms: list[str], every: bool) -> str:
    return _bm25_sql(terms, every).replace("FROM documents)", f"FROM {_CHANGED})")


@query(_changed(["the", "of", "and"], False))
def fts_segments_or(spark, sf):
    """FTS-02, FTS-06, FTS-17, TOP-01: the ten best with any of the commonest words, by blocks, of an index that was added to, dropped from and replaced in."""
    return _index(spark, sf).search(search.or_phrases("the of and"), False, 10).select("doc", F.round("score", 6).alias("score"))


@query(_changed(["ble", "ly"], True))
def fts_segments_merged(spark, sf):
    """FTS-02, FTS-17: the ten best with all words after all segments were merged into one."""
    index = _index(spark, sf)
    index.merge(everything=True)
    return index.search(search.and_phrases("ble ly"), True, 10).select("doc", F.round("score", 6).alias("score"))


@query(rf"SELECT doc_id AS doc, len(regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+'))::BIGINT AS len FROM {_CHANGED}")
def fts_segments_documents(spark, sf):
    """FTS-02, FTS-17: what an index holds after its changes."""
    return _index(spark, sf).documents()


# --- Trees and containers


def _files(d: DataFrame) -> DataFrame:
    """Documents as files in folders by source and by tens, and the folders themselves."""
    folder_ = F.concat(F.lit("t/"), "source", F.lit("/"), F.floor(F.col("doc_id") / 10).cast("string"))
    files = d.select(F.concat(folder_, F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), F.col("mtime"))
    dirs = d.select(F.explode(F.array(F.lit("t"), F.concat(F.lit("t/"), "source"), folder_)).alias("path")).distinct().select("path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"))
    rows = files.union(dirs)
    return rows.select(F.col("path").cast("binary").alias("raw"), "path", "kind", "size", "mtime")


_FOLDER = "'t/' || source || '/' || (doc_id // 10)"


@query(f"""WITH n AS (SELECT doc_id, {_FOLDER} AS folder, source, doc_id % 97 <> 5 AS before, doc_id % 89 <> 3 AS after, doc_id % 61 = 2 AS touched FROM documents
), f AS (SELECT folder || '/' || doc_id AS path, CASE WHEN NOT before THEN 'added' WHEN NOT after THEN 'removed' ELSE 'changed' END AS change FROM n WHERE before <> after OR (before AND after AND touched)
), d AS (SELECT unnest(['t', 't/' || source, folder]) AS path, before, after FROM n
), g AS (SELECT path, bool_or(before) AS b, bool_or(after) AS a FROM d GROUP BY 1)
SELECT path, change FROM f UNION ALL SELECT path, CASE WHEN b THEN 'removed' ELSE 'added' END FROM g WHERE b <> a""")
def pth_folder_changes(spark, sf):
    """SRC-08, AGG-16, AGG-17: what changed between two trees, found by the digests of their folders."""
    d = table(spark, sf, "documents").withColumn("mtime", F.col("doc_id").cast("double"))
    old = _files(d.where("doc_id % 97 <> 5"))
    new = _files(d.where("doc_id % 89 <> 3").withColumn("mtime", F.when(F.col("doc_id") % 61 == 2, F.col("mtime") + 1).otherwise(F.col("mtime"))))
    where, _ = merkle.unequal(merkle.folders(old), merkle.folders(new))
    return merkle.changed(old, new, where).select(F.decode("raw", "utf-8").alias("path"), "change")


@query("SELECT source || '-' || (doc_id // 100) || ['.zip', '.tar', '.tgz'][(doc_id // 100 % 3)::INT + 1] AS container, doc_id || '.txt' AS member, strlen(text)::BIGINT AS size, 'file' AS kind FROM documents")
def src_archive_members(spark, sf):
    """SRC-17, SRC-19: the members of containers of up to a hundred documents each, read as streams where they lie."""
    path = folder(spark, "archives")
    top = path.removeprefix("file://")
    os.makedirs(top, exist_ok=True)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, part = io.BytesIO(), rows["doc_id"].iloc[0] // 100
        end = (".zip", ".tar", ".tgz")[part % 3]
        if end == ".zip":
            with zipfile.ZipFile(out, "w") as z:
                for i, said in zip(rows["doc_id"], rows["text"], strict=True):
                    z.writestr(f"{i}.txt", said)
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for i, said in zip(rows["doc_id"], rows["text"], strict=True):
                    info = tarfile.TarInfo(f"{i}.txt")
                    info.size = len(said.encode())
                    t.addfile(info, io.BytesIO(said.encode()))
        with open(f"{top}/{rows['source'].iloc[0]}-{part}{end}", "wb") as f:
            f.write(gzip.compress(out.getvalue()) if end == ".tgz" else out.getvalue())
        return pd.DataFrame({"part": [part]})

    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    d.groupBy("source", F.floor(F.col("doc_id") / 100)).applyInPandas(pack, "part long").count()
    tree.register(spark)
    found = archives.listed(spark.read.format("filetree").load(path), path, 1 << 30)
    return found.select(F.decode("container", "utf-8").alias("container"), "member", "size", "kind")


# --- Stateful events


def _at() -> Column:
    return F.timestamp_seconds(F.col("event_id") * 7)


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS raw, 'task' AS task, event_id, ['add', 'done', 'failed', 'retry', 'skipped', 'reopen'][(event_id * 7919 % 6)::INT + 1] AS event, ['x', 'y'][(event_id % 2)::INT + 1] AS note, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), s AS (
  SELECT raw, task, event, event_id, i, NULL::VARCHAR AS was, CASE WHEN event = 'add' THEN 'pending' END AS now, CASE WHEN event = 'add' THEN 0 END AS attempts, NULL::VARCHAR AS note, event = 'add' AS legal FROM e WHERE i = 1
  UNION ALL
  SELECT e.raw, e.task, e.event, e.event_id, e.i, s.now, CASE WHEN NOT l.legal THEN s.now WHEN e.event = 'add' THEN coalesce(s.now, 'pending') WHEN e.event IN ('retry', 'reopen') THEN 'pending' ELSE e.event END,
    CASE WHEN NOT l.legal THEN s.attempts WHEN e.event = 'add' THEN coalesce(s.attempts, 0) WHEN e.event IN ('retry', 'reopen') THEN s.attempts ELSE s.attempts + 1 END,
    CASE WHEN NOT l.legal OR e.event IN ('add', 'retry') THEN s.note WHEN e.event = 'reopen' THEN NULL ELSE e.note END, l.legal
  FROM s JOIN e ON e.raw = s.raw AND e.i = s.i + 1, LATERAL (SELECT coalesce(e.event = 'add' OR (e.event IN ('done', 'failed', 'skipped') AND s.now = 'pending') OR (e.event = 'retry' AND s.now = 'failed') OR (e.event = 'reopen' AND s.now = 'skipped' AND s.note = e.note), false) AS legal) l
) SELECT raw, task, event, event_id * 7 AS at, was, now, attempts::INT AS attempts, note, legal FROM s""")
def stm_queue_states(spark, sf):
    """STM-02, STM-03: every event on a queue row with the state before and after, illegal ones too."""
    kinds = F.array(*map(F.lit, ["add", "done", "failed", "retry", "skipped", "reopen"]))
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("raw"), F.lit("task").alias("task"), F.get(kinds, (F.col("event_id") * 7919 % 6).cast("int")).alias("event"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("note"), F.array().cast("array<string>").alias("follow"), _at().alias("at"), "event_id")
    stateful.store_states(spark)
    return stateful.queue(e, order="event_id").withColumn("at", F.unix_seconds("at"))


@query("""WITH RECURSIVE e AS (SELECT (user_id % 5)::VARCHAR AS lock, user_id::VARCHAR AS worker, event_id * 7 AS t, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i, CASE WHEN event_id % 13 = 0 THEN 'release' WHEN event_id % 3 = 0 THEN 'beat' ELSE 'acquire' END AS event FROM events WHERE event_id * 7 % 3000 < 1000
), s AS (
  SELECT lock, worker, event, t, i, CASE WHEN event = 'acquire' THEN worker END AS holder, CASE WHEN event = 'acquire' THEN t END AS beat, CASE WHEN event = 'acquire' THEN 'taken' ELSE 'not held' END AS said, NULL::BIGINT AS stale, NULL::VARCHAR AS who, false AS told FROM e WHERE i = 1
  UNION ALL
  SELECT e.lock, e.worker, e.event, e.t, e.i,
    CASE WHEN e.event = 'acquire' AND (s.holder IS NULL OR e.t >= s.beat + 300) THEN e.worker WHEN e.event = 'release' AND s.holder = e.worker THEN NULL ELSE s.holder END,
    CASE WHEN e.event = 'acquire' AND (s.holder IS NULL OR e.t >= s.beat + 300) THEN e.t WHEN e.event = 'beat' AND s.holder = e.worker THEN e.t WHEN e.event = 'release' AND s.holder = e.worker THEN NULL ELSE s.beat END,
    CASE WHEN e.event = 'acquire' THEN CASE WHEN s.holder IS NULL THEN 'taken' WHEN e.t >= s.beat + 300 THEN 'taken over' ELSE 'refused' END WHEN s.holder = e.worker THEN CASE WHEN e.event = 'release' THEN 'released' END ELSE 'not held' END,
    CASE WHEN e.t >= s.beat + 300 AND NOT s.told THEN s.beat + 300 END, s.holder,
    CASE WHEN e.event = 'acquire' AND (s.holder IS NULL OR e.t >= s.beat + 300) THEN false WHEN e.event IN ('beat', 'release') AND s.holder = e.worker THEN false ELSE s.told OR coalesce(e.t >= s.beat + 300, false) END
  FROM s JOIN e ON e.lock = s.lock AND e.i = s.i + 1
) SELECT lock, worker, said AS event, t AS at FROM s WHERE said IS NOT NULL UNION ALL SELECT lock, who, 'stale', stale FROM s WHERE stale IS NOT NULL""")
def stm_lock_changes(spark, sf):
    """STM-05: what becomes of each lock: taken, refused, stale after 300 silent seconds, taken over, released."""
    event = F.when(F.col("event_id") % 13 == 0, "release").when(F.col("event_id") % 3 == 0, "beat").otherwise("acquire")
    e = table(spark, sf, "events").where("event_id * 7 % 3000 < 1000").select((F.col("user_id") % 5).cast("string").alias("lock"), F.col("user_id").cast("string").alias("worker"), event.alias("event"), _at().alias("at"), "event_id")
    stateful.store_states(spark)
    return stateful.locks(e, order="event_id").withColumn("at", F.unix_seconds("at"))


@query("""WITH e AS (SELECT (user_id % 7)::VARCHAR AS run, event_id // 40 AS cell, event_id * 7 AS t, event_id, min(event_id * 7) OVER w AS started, row_number() OVER (PARTITION BY user_id % 7, event_id // 40 ORDER BY event_id) AS i, event_type FROM events WINDOW w AS (PARTITION BY user_id % 7, event_id // 40)
), k AS (SELECT *, CASE WHEN i = 1 THEN 'start' WHEN event_type = 'purchase' THEN 'result' ELSE 'request' END AS event FROM e
), c AS (SELECT run, cell, started, min(t) FILTER (event = 'result') AS result, count(*) FILTER (event = 'request' AND t < started + 60) > 0 AS early FROM k GROUP BY ALL
), q AS (SELECT *, CASE WHEN result < started + 60 THEN result WHEN NOT early THEN started + 60 WHEN result < started + 180 THEN result ELSE started + 180 END AS stop FROM c
), ended AS (SELECT q.run, q.cell, started, stop, early, result, EXISTS (SELECT 1 FROM k WHERE k.run = q.run AND k.cell = q.cell AND k.t >= stop) AS reached, (SELECT count(*) FROM k WHERE k.run = q.run AND k.cell = q.cell AND event = 'request' AND k.t < stop) AS requests, (SELECT count(*) FROM k WHERE k.run = q.run AND k.cell = q.cell AND event = 'request' AND k.t < started + 60) AS soft, EXISTS (SELECT 1 FROM k WHERE k.run = q.run AND k.cell = q.cell AND k.t >= started + 60) AS past FROM q)
SELECT run, cell, CASE WHEN stop = result THEN 'result' WHEN early THEN 'hard limit' ELSE 'soft limit' END AS event, requests::INT AS requests, (stop - started)::DOUBLE AS seconds, stop AS at FROM ended WHERE reached
UNION ALL SELECT run, cell, 'extended', soft::INT, 60.0::DOUBLE, started + 60 FROM ended WHERE early AND past AND coalesce(result, started + 60) >= started + 60
UNION ALL SELECT k.run, k.cell, 'discarded', d.requests::INT, (k.t - d.started)::DOUBLE, k.t FROM k JOIN ended d USING (run, cell) WHERE k.t >= d.stop AND NOT (k.event = 'result' AND k.t = d.stop)""")
def stm_cell_limits(spark, sf):
    """STM-09: cells stopped at a soft limit, extended by what they ask for, stopped at a hard one; without more events of a cell, none is told."""
    e = table(spark, sf, "events").select((F.col("user_id") % 7).cast("string").alias("run"), F.floor(F.col("event_id") / 40).cast("long").alias("cell"), _at().alias("at"), "event_id", "event_type")
    first = e.groupBy("run", "cell").agg(F.min("event_id").alias("first"))
    event = F.when(F.col("event_id") == F.col("first"), "start").when(F.col("event_type") == "purchase", "result").otherwise("request")
    stateful.store_states(spark)
    return stateful.cells(e.join(first, ["run", "cell"]).withColumn("event", event), 60, 180, order="event_id").withColumn("at", F.unix_seconds("at"))
