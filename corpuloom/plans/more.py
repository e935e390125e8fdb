"""More registered queries: entries, classification, queues, pages, memory and runs, each through its operator.

Roles of the tables beside those of :mod:`queries`: documents are also typed
pages and queue rows, events the log of runs. What a table lacks (magic
numbers, folders, links) is made from its rows by a rule that the SQL repeats.
"""

from __future__ import annotations

import hashlib
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import binary, edit, fixed, replies, text
from ..operators import aliases, context, metrics, mining, paths, probes, search, traces, vault
from ..sources import files, tree
from ..streaming import jobs
from .queries import _CHUNKED, QUERIES, SQL, _bm25_sql, folder, query, table

__all__ = ["QUERIES", "SQL"]

# --- A tree: documents as files and links, sources as folders


def _tree(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat("source", F.lit("/"), name)
    kind = F.when(F.col("doc_id") % 10 == 3, "symlink").otherwise("file")
    files = d.select(path.cast("binary").alias("raw"), path.alias("path"), F.col("source").alias("parent"), name.alias("name"), kind.alias("kind"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").cast("double").alias("mtime"))
    folders = d.select("source").distinct().select(F.col("source").cast("binary").alias("raw"), F.col("source").alias("path"), F.lit("").alias("parent"), F.col("source").alias("name"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"))
    return files.union(folders)


_TREE = """e AS (SELECT source || '/' || doc_id || '.txt' AS path, source AS parent, doc_id::VARCHAR || '.txt' AS name, CASE WHEN doc_id % 10 = 3 THEN 'symlink' ELSE 'file' END AS kind, strlen(text)::BIGINT AS size, doc_id::DOUBLE AS mtime, lang, doc_id
FROM documents UNION ALL SELECT source, '', source, 'dir', 0, 0.0::DOUBLE, NULL, NULL FROM (SELECT DISTINCT source FROM documents))"""


@query(f"WITH {_TREE} SELECT count(*) AS n FROM e WHERE kind = 'file' AND path >= 'src3/' AND path < 'src3/' || chr(65535)")
def pth_count(spark, sf):
    """AGG-01: files below a folder."""
    return paths.count(_tree(spark, sf), "file", "src3")


@query(f"WITH {_TREE} SELECT kind, count(*) AS n, coalesce(sum(CASE WHEN kind = 'file' THEN size END), 0)::BIGINT AS bytes FROM e GROUP BY 1")
def agg_count_by_kind(spark, sf):
    """AGG-03: entries by kind, and the bytes of files."""
    return paths.summary(_tree(spark, sf))


@query(f"WITH {_TREE} SELECT path, kind, size, lower(hex(encode(path))) AS raw FROM e WHERE path = 'src3'")
def pth_stat(spark, sf):
    """FLT-03, SRC-04: one path's entry and its bytes."""
    t = _tree(spark, sf)
    return paths.stat(t, "src3").select("path", "kind", "size").crossJoin(paths.raw_for(t, "src3").select(F.lower(F.hex("raw")).alias("raw")))


@query(f"""WITH {_TREE}, r AS (SELECT path AS container, CASE WHEN doc_id % 3 = 0 THEN path || '.gone' ELSE path END || '!in/' || lang AS ref FROM e WHERE kind = 'file')
SELECT ref, container, 'in/' || split_part(ref, '!in/', 2) AS member FROM r WHERE NOT contains(ref, '.gone')""")
def pth_container(spark, sf):
    """FLT-05: containers of members that exist."""
    t = _tree(spark, sf).where("kind = 'file'")
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "lang", "doc_id")
    gone = F.when(F.col("doc_id") % 3 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    refs = t.select("path").join(d, "path").select(F.concat(gone, F.lit("!in/"), "lang").alias("ref"))
    return paths.container_of(_tree(spark, sf), refs)


@query(f"WITH {_TREE} SELECT lower(hex(encode(path))) AS raw, path, kind FROM e WHERE kind <> 'dir' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY path")
def jn_pending_anti(spark, sf):
    """FLT-18, JN-02: entries that a pass has not done."""
    t = _tree(spark, sf).where("kind <> 'dir'")
    done = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).cast("binary").alias("raw"))
    return paths.pending(t, done).select(F.lower(F.hex("raw")).alias("raw"), "path", "kind")


#: What each magic number of the sniffing tables makes of a file whose further bytes are text.
_MADE = [(m, k, None) for m, k in binary.STRONG] + [(b"\xff\xd8\xff", "media", None), (b"BM", "text", "utf-8"), (b"II*\x00", "media", None), (b"{\\rtf", "text", "utf-8"), (b"MZ", "text", "utf-8"), (b"", "text", "utf-8")]
_MADE_SQL = "m(i, magic, kind, encoding) AS (VALUES " + ", ".join(f"({i}, unhex('{m.hex()}'), '{k}', {'NULL' if e is None else repr(e)})" for i, (m, k, e) in enumerate(_MADE)) + ")"


def _marked(spark, sf) -> DataFrame:
    """Documents behind one of the magic numbers each, by id; every 50th can't be read."""
    magic = F.get(F.array(*[F.lit(m) for m, _, _ in _MADE]), (F.col("doc_id") % len(_MADE)).cast("int"))
    content = F.when(F.col("doc_id") % 50 != 49, F.concat(magic, F.lit(b"x"), F.col("text").cast("binary")))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").cast("binary").alias("raw"), "doc_id", F.octet_length("text").cast("long").alias("size"), content.alias("content"))


_MARKED = f"""{_MADE_SQL}, d AS (SELECT doc_id, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 50 <> 49 THEN magic || encode('x' || text) END AS content, CASE WHEN doc_id % 50 <> 49 THEN kind ELSE 'unreadable' END AS kind,
CASE WHEN doc_id % 50 <> 49 THEN encoding END AS encoding FROM documents JOIN m ON doc_id % {len(_MADE)} = i)"""


@query(f"WITH {_MARKED} SELECT lower(hex(encode(doc_id::VARCHAR))) AS raw, kind, encoding, CASE WHEN kind = 'unreadable' THEN 'unreadable' END AS note, sha256(unhex(substr(hex(content), 1, 131072)) || encode(chr(0) || octet_length(content))) AS head_hash FROM d")
def bin_magic(spark, sf):
    """BIN-01 to BIN-03, HSH-01: every magic number before a text, files that can't be read noted; hashes of the first 64 KiB and the size."""
    return paths.classify(_marked(spark, sf)).select(F.lower(F.hex("raw")).alias("raw"), "kind", "encoding", "note", "head_hash")


@query(f"WITH {_MARKED} SELECT kind, count(*) AS files, sum(size)::BIGINT AS bytes FROM d GROUP BY 1")
def agg_classification_report(spark, sf):
    """AGG-04, JN-01: a classification joined with its entries."""
    m = _marked(spark, sf)
    return paths.by_kind(paths.classify(m), m)


@query(f"WITH {_MARKED} SELECT coalesce(encoding, '(none)') AS encoding, count(*) AS files FROM d GROUP BY 1 ORDER BY 2 DESC, 1")
def pth_by_encoding(spark, sf):
    """AGG-05."""
    return paths.by_encoding(paths.classify(_marked(spark, sf)))


# The bits of a whole number from 1 on as a big-endian double: exponent from the number of binary digits, the rest shifted up.
_BITS = "CASE WHEN t = 0 THEN 0 ELSE ((1022 + length(bin(t))) << 52) | ((t - (1::BIGINT << (length(bin(t)) - 1))) << (53 - length(bin(t)))) END"
_DIGEST = f"""h AS (SELECT sha256(encode(path) || unhex('00') || encode(kind) || unhex('00') || unhex(printf('%016x', size)) || unhex(printf('%016x', {_BITS}))) AS h FROM (SELECT path, kind, size, CASE WHEN kind = 'dir' THEN 0 ELSE mtime::BIGINT END AS t FROM e)),
l AS (SELECT {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS l{i}" for i in range(8))} FROM h),
s AS (SELECT count(*) AS n, {", ".join(f"bit_xor(l{i}) AS x{i}, sum(l{i})::BIGINT AS s{i}" for i in range(8))} FROM l),
c7 AS (SELECT *, s7 AS t7 FROM s), {", ".join(f"c{i} AS (SELECT *, s{i} + (t{i + 1} >> 32) AS t{i} FROM c{i + 1})" for i in reversed(range(7)))}"""


@query(f"WITH {_TREE}, {_DIGEST} SELECT n, " + " || ".join(f"printf('%08x', x{i})" for i in range(8)) + " AS xor, " + " || ".join(f"printf('%08x', t{i} & 4294967295)" for i in range(8)) + " AS sum FROM c0")
def hsh_entry_digest(spark, sf):
    """AGG-16, HSH-06: XOR and sum of all entries' digests."""
    return paths.digest(_tree(spark, sf))


@query(f"""WITH {_TREE} SELECT 'same' AS case_, 'equal' AS verdict UNION ALL SELECT 'touched', CASE WHEN count(*) FILTER (kind = 'file') > 0 THEN 'content' ELSE 'equal' END FROM e
UNION ALL SELECT 'fewer', CASE WHEN count(*) FILTER (kind = 'dir') > 0 THEN 'count' ELSE 'equal' END FROM e""")
def pth_digest_verdict(spark, sf):
    """AGG-17: an index against itself, against one with later files, and against one without folders."""
    t = _tree(spark, sf)
    cases = {"same": t.repartition(3), "touched": t.withColumn("mtime", F.col("mtime") + 1), "fewer": t.where("kind <> 'dir'")}
    rows = [paths.compare_digests(paths.digest(t), paths.digest(o)).select(F.lit(n).alias("case_"), "verdict") for n, o in cases.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS v, o_custkey FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0")
def jn_upsert_latest(spark, sf):
    """JN-08, SNK-05: stored rows with new ones in place of the same keys."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    old, new = (o.where(w).select("o_orderkey", F.lit(v).alias("v"), "o_custkey") for w, v in (("o_orderkey % 7 <> 0", "old"), ("o_orderkey % 5 = 0", "new")))
    return paths.upsert(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'old' ELSE 'new' END AS v FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0")
def pth_insert_new(spark, sf):
    """JN-07: new rows only where their key is not stored, once each."""
    o = table(spark, sf, "orders").select("o_orderkey")
    old, new = (o.where(w).withColumn("v", F.lit(v)) for w, v in (("o_orderkey % 7 <> 0", "old"), ("o_orderkey % 5 = 0", "new")))
    return paths.insert_new(old, new.union(new), ["o_orderkey"])


@query(f"WITH {_TREE} SELECT path || CASE WHEN doc_id % 50 = 0 THEN chr(65533) ELSE '' END AS path, kind, size FROM e WHERE doc_id % 50 = 0 ORDER BY kind, size DESC, path LIMIT 20")
def pth_mangled(spark, sf):
    """FLT-20: entries whose display lost bytes; the limit is the feature."""
    t = _tree(spark, sf)
    bad = F.col("mtime") % 50 == 0
    shown = text.display(F.concat("raw", F.when(bad & (F.col("kind") != "dir"), F.lit(b"\xe9")).otherwise(F.lit(b""))))
    return paths.mangled(t.orderBy("path").withColumn("path", shown), 20).select("path", "kind", "size")


@query("SELECT DISTINCT source FROM documents WHERE lang NOT IN ('en', 'es')")
def pth_needs_repair(spark, sf):
    """FLT-19: sources that were read in another encoding than UTF-8."""
    encoding = F.when(F.col("lang") == "en", "utf-8").when(F.col("lang") != "es", "cp1252")
    return paths.needs_repair(table(spark, sf, "documents").select("source", encoding.alias("encoding")))


@query(f"WITH {_TREE} SELECT kind, count(*) AS newer FROM e WHERE mtime > 20 GROUP BY 1")
def pth_newer_kinds(spark, sf):
    """AGG-18: what is newer, by kind."""
    return paths.newer_kinds(_tree(spark, sf), 20.0)


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n, sum(strlen(text)) AS total, min(strlen(text)) AS least FROM documents GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS files, count(*) AS distinct_contents, coalesce(sum(CASE WHEN n > 1 THEN total - least END), 0)::BIGINT AS duplicate_bytes, sum(total)::BIGINT AS bytes FROM g)
SELECT files, distinct_contents, duplicate_bytes, bytes, round(100.0::DOUBLE * (files - distinct_contents) / files, 1) AS percent_files, round(100.0::DOUBLE * duplicate_bytes / bytes, 1) AS percent_bytes FROM s""")
def pth_copy_report(spark, sf):
    """AGG-08: the shares of files and bytes that are copies."""
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size"))
    return paths.copy_report(rows, "h", "size").drop("factor")


@query(f"WITH {_TREE} SELECT least(count(*) FILTER (contains(path, 'src1/')), 20) AS shown, count(*) AS total FROM e")
def pth_shown(spark, sf):
    """AGG-31: lines shown of all entries in scope."""
    t = _tree(spark, sf)
    return paths.shown_of(paths.find(t, "src1/", 20), t).select(F.col("shown").cast("long"), "total")


@query(f"WITH {_TREE} SELECT path FROM (SELECT path FROM e WHERE contains(path, 'src1/') ORDER BY length(name), path LIMIT 1)")
def pth_least_limit(spark, sf):
    """TOP-09: a limit of nothing counts as one."""
    return paths.find(_tree(spark, sf), "src1/", 0).select("path")


@query(f"WITH {_TREE} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '[^/]*$') AS name FROM e")
def pth_split(spark, sf):
    """PRJ-02, STR-01: parent and name of a path's display."""
    shown = text.display(F.col("raw"))
    return _tree(spark, sf).select(shown.alias("path"), text.parent(shown).alias("parent"), text.name(shown).alias("name"))


@query("SELECT p_partkey FROM part WHERE contains(p_name || '%_' || p_partkey, '%_1')")
def str_literal(spark, sf):
    """STR-02: signs of patterns are text."""
    return table(spark, sf, "part").where(F.concat("p_name", F.lit("%_"), "p_partkey").rlike(text.quote("%_1"))).select("p_partkey")


_ENDED = "source || '/x' || doc_id || list_extract([" + ", ".join(f"'{e}'" for e in (*fixed.NON_PROSE_ENDINGS, ".txt", ".md", ".rss", "")) + f"], (doc_id % {len(fixed.NON_PROSE_ENDINGS) + 4})::INT + 1)"
_LONGEST = sorted(fixed.NON_PROSE_ENDINGS, key=lambda e: (-len(e), e))


def _ended(spark, sf) -> DataFrame:
    endings = F.array(*map(F.lit, (*fixed.NON_PROSE_ENDINGS, ".txt", ".md", ".rss", "")))
    return table(spark, sf, "documents").withColumn("path", F.concat("source", F.lit("/x"), "doc_id", F.get(endings, (F.col("doc_id") % F.size(endings)).cast("int"))))


@query(f"WITH p AS (SELECT doc_id, {_ENDED} AS path FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN ends_with(path, '{e}') THEN '{e}'" for e in _LONGEST) + " END AS ending FROM p")
def flt_non_prose(spark, sf):
    """FLT-07: the longest ending of a path that is no prose."""
    return _ended(spark, sf).select("doc_id", text.non_prose_ending(F.col("path")).alias("ending"))


@query(f"WITH p AS (SELECT doc_id, lower({_ENDED}) AS path FROM documents) SELECT doc_id FROM p WHERE " + " OR ".join(f"ends_with(path, '{e}')" for e in mining.MEMBER_ENDINGS))
def flt_text_member(spark, sf):
    """FLT-23: members that are read for their text."""
    return _ended(spark, sf).where(mining.is_text_member(F.col("path"))).select("doc_id")


@query("""WITH m AS (SELECT source AS container, doc_id::VARCHAR || CASE WHEN lang = 'en' THEN '/The/' ELSE '/der/' END || lang AS member FROM documents) SELECT container, member FROM m WHERE contains(lower(member), 'the') ORDER BY length(member), member LIMIT 20""")
def mng_find_members(spark, sf):
    """FLT-04: members whose name holds a word; the limit is the feature."""
    return mining.find_members(_members(spark, sf), "THE", 20).select("container", "member")


def _members(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    member = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", "/The/").otherwise("/der/"), "lang")
    return d.select(F.col("source").alias("container"), member.alias("member"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 9 == 0, "dir").otherwise("file").alias("kind"))


@query("SELECT source AS container, count(*) AS members, sum(strlen(text))::BIGINT AS declared_bytes, count(*) FILTER (doc_id % 9 = 0) AS dirs FROM documents GROUP BY 1")
def mng_archive_totals(spark, sf):
    """AGG-11: members, bytes and kinds of archives."""
    m = _members(spark, sf)
    dirs = mining.archive_kinds(m).where("kind = 'dir'").select("container", F.col("members").alias("dirs"))
    return mining.archive_totals(m).join(dirs, "container", "left").withColumn("dirs", F.coalesce("dirs", F.lit(0)))


@query("""SELECT source AS container, doc_id::VARCHAR || CASE WHEN lang = 'en' THEN '/The/' ELSE '/der/' END || lang AS member, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 9 = 0 THEN 'dir' ELSE 'file' END AS kind FROM documents""")
def mng_member_lines(spark, sf):
    """STR-28: a listing as lines and back."""
    return mining.members_of_lines(mining.member_lines(_members(spark, sf)))


# --- Queues


def _queue(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    state = F.when(F.col("doc_id") % 4 == 0, "done").when(F.col("doc_id") % 4 == 1, "failed").otherwise("pending")
    task = F.when(F.col("doc_id") % 3 == 0, "extract_text").otherwise("index_text")
    note = F.when(F.col("doc_id") % 12 == 0, "needs_ocr").when(F.col("doc_id") % 4 == 1, "timeout")
    return d.select(F.col("doc_id").cast("string").cast("binary").alias("raw"), "doc_id", task.alias("task"), state.alias("state"), note.alias("note"), (F.col("doc_id") % 7).cast("int").alias("priority"), F.lit(1).alias("attempts"), F.col("doc_id").cast("double").alias("updated_at"))


_QUEUE = """q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'extract_text' ELSE 'index_text' END AS task, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS state,
CASE WHEN doc_id % 12 = 0 THEN 'needs_ocr' WHEN doc_id % 4 = 1 THEN 'timeout' END AS note, doc_id % 7 AS priority FROM documents)"""

_EXT = (".pdf", ".docx", ".zip", ".rar", ".txt")


@query(f"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'archive' ELSE 'text' END AS kind, list_extract(['.pdf', '.docx', '.zip', '.rar', '.txt'], (doc_id % 5)::INT + 1) AS ext FROM documents),
t AS (SELECT doc_id, 'extract_text' AS task, 10 AS priority FROM c WHERE kind IN ('document', 'archive') AND ext IN ('.pdf', '.docx', '.rar') UNION ALL SELECT doc_id, 'list_archive', 30 FROM c WHERE kind = 'archive' AND ext NOT IN ('.pdf', '.docx')
UNION ALL SELECT doc_id, 'index_text', 20 FROM c WHERE kind = 'text'), {_QUEUE} SELECT t.doc_id, t.task, t.priority FROM t WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = t.doc_id AND q.task = t.task)""")
def jn_plan_join(spark, sf):
    """JN-03: tasks from a classification that are not queued yet."""
    raw = F.col("doc_id").cast("string").cast("binary")
    ext = F.get(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 5).cast("int"))
    kind = F.when(F.col("doc_id") % 3 == 0, "document").when(F.col("doc_id") % 3 == 1, "archive").otherwise("text")
    d = table(spark, sf, "documents")
    planned = mining.plan(d.select(raw.alias("raw"), F.concat(F.lit("f"), ext).alias("name")), d.select(raw.alias("raw"), kind.alias("kind")), _queue(spark, sf))
    return planned.select(F.col("raw").cast("string").cast("long").alias("doc_id"), "task", "priority")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def win_latest_snapshot(spark, sf):
    """WIN-04: the last row of every key of a log."""
    return mining.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query(f"WITH {_QUEUE} SELECT count(*) AS processed, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, 0 AS skipped, count(*) FILTER (doc_id % 5 = 0) AS cache_hits FROM q")
def mng_run_stats(spark, sf):
    """AGG-10: what a run did."""
    return mining.run_stats(_queue(spark, sf).withColumn("cached", F.when(F.col("doc_id") % 5 == 0, F.lit(True))))


@query(f"WITH {_QUEUE} SELECT doc_id, task, CASE WHEN state = 'failed' AND task = 'index_text' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'failed' AND task = 'index_text' THEN NULL ELSE note END AS note FROM q")
def mng_reopen(spark, sf):
    """STM-03: failed rows of a task open again."""
    return mining.reopen(_queue(spark, sf), "failed", "index_text").select("doc_id", "task", "state", "note")


@query(f"WITH {_QUEUE} SELECT doc_id, 'ocr_page' AS task, 50 AS priority FROM q WHERE task = 'extract_text' AND note = 'needs_ocr'")
def mng_follow_on(spark, sf):
    """STM-04: OCR for extractions that ask for it."""
    return mining.follow_on(_queue(spark, sf)).select(F.col("raw").cast("string").cast("long").alias("doc_id"), "task", "priority")


@query(f"WITH {_QUEUE} SELECT doc_id, priority FROM q WHERE state = 'pending' AND task = 'index_text' ORDER BY priority, doc_id::VARCHAR LIMIT 30")
def mng_window(spark, sf):
    """STM-02, TOP-05: the rows that one bounded run takes."""
    return mining.window_of(_queue(spark, sf), ["index_text"], 30)[0].select("doc_id", "priority")


@query(f"WITH {_QUEUE} SELECT 'bounded' AS run, CASE WHEN count(*) > 30 THEN 'max_items' ELSE 'drained' END AS reason FROM q WHERE state = 'pending' UNION ALL SELECT 'late', 'deadline' UNION ALL SELECT 'stopped', 'paused' UNION ALL SELECT 'wide', 'drained'")
def mng_stop_reasons(spark, sf):
    """STM-02: why runs stop."""
    q, tasks = _queue(spark, sf), ["index_text", "extract_text"]
    runs = {"bounded": (30, False, None), "late": (30, False, 0.0), "stopped": (30, True, None), "wide": (1 << 30, False, 9.0)}
    rows = [mining.window_of(q, tasks, *how)[1].select(F.lit(name).alias("run"), "reason") for name, how in runs.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("""WITH s AS (SELECT sha256(text) AS h, min(text) AS t FROM documents GROUP BY 1), k AS (SELECT sha256(h || chr(0) || '1' || chr(0)) AS key, h, t FROM s), c AS (SELECT sha256(sha256(text) || chr(0) || '1' || chr(0)) AS key FROM documents WHERE doc_id % 4 = 0)
SELECT 'summarise' AS task, key, md5(t) AS text FROM k WHERE key NOT IN (SELECT key FROM c)""")
def jn_memo_dedup(spark, sf):
    """JN-22, HSH-04, HSH-05, SNK-03: each content that a cache lacks is derived once."""
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("source_hash"), F.col("text").alias("content"), "doc_id")
    key = binary.derivation_key(F.col("source_hash"), F.lit(mining.VERSION), F.lit(""))
    cache = d.where("doc_id % 4 = 0").select(F.lit("summarise").alias("task"), key.alias("key"))
    return mining.derive(d, cache, lambda rows: rows.select("key", F.md5(F.col("content").cast("binary")).alias("text")), "summarise")


@query("SELECT lang AS task, count(*) AS entries, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def mng_cache_stats(spark, sf):
    """SNK-04."""
    return mining.cache_stats(table(spark, sf, "documents").select(F.col("lang").alias("task"), "text"))


@query("SELECT '{\"n\":' || count(*) || '}' AS value, 25.0::DOUBLE AS age FROM documents WHERE lang = 'en'")
def mng_published(spark, sf):
    """AGG-14, STM-08: the newest snapshot of two and its age."""
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    en = table(spark, sf, "documents").where("lang = 'en'").agg(F.count(F.lit(1)).alias("n"))
    return mining.published(mining.publish(n, "coverage", 50.0).union(mining.publish(en, "coverage", 75.0)), "coverage", 100.0)


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown' WHEN n_nationkey % 3 = 1 THEN 'current' ELSE 'stale' END AS verdict FROM nation")
def mng_freshness(spark, sf):
    """STM-07: recorded fingerprints against live ones."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), F.md5("n_name").alias("fingerprint"))
    recorded = n.where("k % 3 <> 0").withColumn("fingerprint", F.when(F.col("k") % 3 == 1, F.col("fingerprint")).otherwise("old"))
    return mining.freshness(recorded, n)


@query(f"""WITH {_TREE} SELECT path || '!a' AS ref, 'words of ' || doc_id AS text FROM e WHERE kind = 'file' AND doc_id % 6 = 0""")
def mng_member_text(spark, sf):
    """JN-18: a member's text by its container's bytes, their hash and the cache's key."""
    t = _tree(spark, sf).where("kind = 'file'")
    some = t.where("mtime % 6 = 0").withColumn("head_hash", F.sha2("path", 256))
    refs = some.select(F.concat("path", F.lit("!a")).alias("ref"), F.col("path").alias("container"))
    key = binary.derivation_key(F.col("head_hash"), F.lit(mining.VERSION), F.lit(""))
    cache = some.select(F.lit("extract_text").alias("task"), key.alias("key"), F.concat(F.lit("words of "), F.col("mtime").cast("long").cast("string")).alias("text"))
    return mining.member_text(refs, t, some.select("raw", "head_hash"), cache)


_SAID = ("Passphrase required", "Truncated input file", "Unrecognized archive format", "Damaged RAR: checksum error", "no idea")


@query("SELECT doc_id, list_extract(['encrypted', 'truncated', 'unsupported', 'damaged', 'failed'], (doc_id % 5)::INT + 1) AS class FROM documents")
def mng_fault_class(spark, sf):
    """STR-29: what an archive tool complains of."""
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", mining.fault_class(said).alias("class"))


# --- Pages

_KINDS, _STATES = ("note", "topic", "definition", "template"), ("active", "active", "deprecated", "pending", "superseded")


def _pick(values, by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _pages(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    d = table(spark, sf, "documents").withColumn("kind", _pick(_KINDS, n)).withColumn("name", F.concat(F.lit("page-"), n.cast("string")))
    stamp = F.timestamp_micros(n * 3_600_000_000)
    return d.select(
        F.concat("kind", F.lit("s/"), "name", F.lit(".md")).alias("path"), F.lpad(n.cast("string"), 8, "0").alias("id"), "kind", "name", F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 60).alias("summary"),
        F.array("lang", "source").alias("tags"), (n % 3).cast("int").alias("version"), F.md5("text").alias("hash"), _pick(_STATES, n).alias("status"), F.col("text").alias("body"), n.alias("n"),
        stamp.alias("created"), stamp.alias("updated"), (n % 5).cast("int").alias("access_count"), F.when(n % 2 == 0, stamp).alias("last_access"),
    )


_PAGES = """p AS (SELECT kind || 's/page-' || doc_id || '.md' AS path, *, 'page-' || doc_id AS name FROM (SELECT doc_id, lang, source, lpad(doc_id::VARCHAR, 8, '0') AS id, list_extract(['note', 'topic', 'definition', 'template'], (doc_id % 4)::INT + 1) AS kind,
substr(text, 1, 40) AS title, substr(text, 41, 60) AS summary, list_extract(['active', 'active', 'deprecated', 'pending', 'superseded'], (doc_id % 5)::INT + 1) AS status, text AS body, doc_id % 3 AS version FROM documents))"""
_PAGE_TEXTS = f"FROM (WITH {_PAGES} SELECT path AS doc_id, concat_ws(chr(10), path, kind, name, title, summary, body) AS text, kind, lang, status, title AS head FROM p)"
_FOUND = _bm25_sql(["ble", "ly"], False, "kind IN ('note', 'topic') AND lang = 'en' AND status = 'active'").replace("FROM documents", _PAGE_TEXTS)


def _hits(spark, sf, k=10) -> DataFrame:
    return vault.find(vault.tables(_pages(spark, sf)), "ble ly", k, kinds=("note", "topic"), tags=("en",), states=("active",))


@query(f"WITH f AS ({_FOUND}), {_PAGES} SELECT p.path, p.kind, p.name, p.title, p.summary, f.score, p.status FROM f JOIN p ON p.path = f.doc")
def jn_tag_semi(spark, sf):
    """JN-05, JN-06, FLT-10, FTS-20, FTS-21, PRJ-01: cards of the ten best pages of some kinds, a tag and a state."""
    return vault.cards(_hits(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH f AS ({_FOUND}), {_PAGES}, x AS (SELECT doc AS path, 0 AS place, score FROM f UNION ALL SELECT 'quarantine/' || id || '.md', 1, NULL FROM p WHERE doc_id % 9 = 0) SELECT path FROM (SELECT path FROM x ORDER BY place, score DESC, path LIMIT 14)")
def vlt_with_quarantine(spark, sf):
    """SET-07: hits, then quarantined pages up to fourteen; the limit is the feature."""
    hidden = vault.propose(_pages(spark, sf).where("n % 9 = 0")).select("path")
    return vault.with_quarantine(_hits(spark, sf).select("path", "score"), hidden, 14).select("path")


@query(f"WITH {_PAGES} SELECT path, title FROM p WHERE kind = 'note' ORDER BY path")
def vlt_listed(spark, sf):
    """FLT-11, SRC-16."""
    return vault.listed(_pages(spark, sf).union(vault.propose(_pages(spark, sf).where("n % 9 = 0"))), "", "note").select("path", "title")


@query(f"WITH {_PAGES} SELECT 'quarantine/' || id || '.md' AS path FROM p WHERE doc_id % 2 = 0 AND contains(lower(body), 'ering') ORDER BY id DESC")
def vlt_search_quarantine(spark, sf):
    """FLT-12."""
    return vault.search_quarantine(vault.propose(_pages(spark, sf).where("n % 2 = 0")), "ERING").select("path")


def _linked(spark, sf) -> DataFrame:
    links = F.concat(F.lit(" [[page-"), (F.col("n") + 1).cast("string"), F.lit("|next]] [[Nowhere#part]] [[page-"), (F.col("n") + 1).cast("string"), F.lit("]]"))
    return _pages(spark, sf).withColumn("body", F.concat("body", links))


@query(f"WITH {_PAGES}, l AS (SELECT path AS src, 'page-' || (doc_id + 1) AS dst FROM p UNION ALL SELECT path, 'Nowhere' FROM p) SELECT l.src, l.dst, p.path FROM l LEFT JOIN p ON p.name = l.dst")
def fts_links(spark, sf):
    """FTS-22, JN-19, FTS-21: links of every page, once each, and the pages that they mean."""
    pages = _linked(spark, sf)
    return vault.resolve_links(vault.tables(pages)["links"], pages)


def _faulty(spark, sf) -> DataFrame:
    n = F.col("n")
    p = _linked(spark, sf).withColumn("kind", F.when(n % 13 == 0, "odd").otherwise(F.col("kind"))).withColumn("name", F.when(n % 11 == 0, F.concat(F.lit("a b "), "name")).otherwise(F.col("name")))
    p = p.withColumn("title", F.when(n % 23 == 0, F.repeat(F.lit("t"), 300)).otherwise(F.col("title"))).withColumn("hash", F.when(n % 17 == 0, "bad"))
    return p.withColumn("body", F.when(n % 19 == 0, F.lit("  ")).when(n % 8 == 3, F.lit("say {a} and {a}")).otherwise(F.col("body")))


@query(f"""WITH {_PAGES}, f AS (SELECT *, doc_id % 13 = 0 AS odd, CASE WHEN doc_id % 19 = 0 THEN 'empty' WHEN doc_id % 8 = 3 THEN 'slots' ELSE 'links' END AS holds FROM p)
SELECT path, concat_ws(', ', CASE WHEN odd THEN 'unknown kind' END, CASE WHEN doc_id % 11 = 0 THEN 'bad name' END, CASE WHEN doc_id % 17 = 0 THEN 'bad hash' END, CASE WHEN doc_id % 23 = 0 THEN 'long title' END,
CASE WHEN holds = 'empty' THEN 'empty body' END, CASE WHEN NOT odd AND kind = 'template' AND holds = 'slots' THEN 'slot repeated' END) AS errors,
CASE WHEN holds = 'links' AND NOT odd AND kind IN ('note', 'definition') THEN concat_ws(', ', 'link to nothing: Nowhere', CASE WHEN NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = f.doc_id + 1) OR (doc_id + 1) % 11 = 0 THEN 'link to nothing: page-' || (doc_id + 1) END) ELSE '' END AS warnings FROM f""")
def vlt_validate(spark, sf):
    """VLT-02, STR-24: errors and warnings of every page by the rules of its kind."""
    pages = _faulty(spark, sf)
    out = vault.validate(pages, pages)
    return out.select("path", F.concat_ws(", ", "errors").alias("errors"), F.concat_ws(", ", "warnings").alias("warnings"))


def _helper(spark, sf) -> DataFrame:
    code = F.concat(F.lit("def f"), F.col("n").cast("string"), F.lit("(x):\n"))
    more = F.when(F.col("n") % 3 == 0, F.lit("    import socket\n    return x\n")).when(F.col("n") % 3 == 1, F.lit("    return x\n")).otherwise(F.lit("    return (x\n"))
    body = F.concat(F.lit("## Signature\n```python\n"), code, F.lit("```\n\n## Implementation\n```python\n"), code, more, F.lit("```\n"))
    return _pages(spark, sf).withColumn("kind", F.lit("helper")).withColumn("name", F.concat(F.lit("f"), F.col("n").cast("string"))).withColumn("hash", F.lit(None).cast("string")).withColumn("body", body)


@query(f"WITH {_PAGES} SELECT path, CASE doc_id % 3 WHEN 0 THEN 'import of socket' WHEN 1 THEN '' ELSE 'syntax error' END AS errors FROM p")
def vlt_helper_faults(spark, sf):
    """VLT-02, STR-22: helpers' code, read as syntax."""
    pages = _helper(spark, sf)
    return vault.validate(pages, pages).select("path", F.concat_ws(", ", "errors").alias("errors"))


@query(f"WITH {_PAGES} SELECT path, 'f' || doc_id AS name, 'def f' || doc_id || '(x):' || chr(10) AS signature FROM p WHERE status = 'active' ORDER BY path LIMIT 25")
def vlt_helpers(spark, sf):
    """VLT-08, TOP-10: the first helpers by path; the limit is the feature."""
    return vault.helpers(_helper(spark, sf), 25).select("path", "name", "signature")


@query(f"WITH {_PAGES} SELECT 'quarantine/' || id || '.md' AS path, 'pending' AS status, 0 AS version, lang || ' ' || source || ' proposed' AS tags FROM p")
def vlt_propose(spark, sf):
    """VLT-01."""
    return vault.propose(_pages(spark, sf)).select("path", "status", "version", F.concat_ws(" ", "tags").alias("tags"))


@query(f"""WITH {_PAGES} SELECT 'quarantine/' || id || '.md' AS path, path AS target, CASE WHEN doc_id % 10 = 0 THEN 'invalid' WHEN doc_id % 6 = 0 AND status = 'active' THEN 'occupied' WHEN doc_id % 6 = 0 THEN 'needs force' ELSE 'promoted' END AS outcome,
CASE WHEN doc_id % 10 <> 0 AND doc_id % 6 <> 0 THEN 1 END AS version FROM p WHERE doc_id % 2 = 0""")
def vlt_promote(spark, sf):
    """VLT-03: faults, places that are held, and versions."""
    pages = _pages(spark, sf)
    asked = vault.propose(pages.where("n % 2 = 0"))
    faults = asked.where("n % 10 = 0").select("path", F.array(F.lit("empty body")).alias("errors"))
    return vault.promote(asked, pages.where("n % 6 = 0"), faults).select("path", "target", "outcome", "version")


@query(f"WITH {_PAGES} SELECT path, CASE WHEN doc_id IN (0, 4, 8, 12) AND status = 'active' THEN 'deprecated' WHEN doc_id IN (0, 4, 8, 12) AND status = 'deprecated' THEN 'superseded' ELSE status END AS status FROM p")
def vlt_demote(spark, sf):
    """VLT-04."""
    return vault.demote(_pages(spark, sf), [f"notes/page-{i}.md" for i in (0, 4, 8, 12)]).select("path", "status")


_REJECTED = ["quarantine/00000002.md", "quarantine/00000006.md", "topics/page-1.md"]


@query(f"WITH {_PAGES}, a AS (SELECT path, false AS refused FROM p UNION ALL SELECT 'quarantine/' || id || '.md', false FROM p WHERE doc_id % 2 = 0), b AS (SELECT * FROM a WHERE path NOT IN ('quarantine/00000002.md', 'quarantine/00000006.md')) SELECT * FROM b UNION ALL SELECT path, true FROM a WHERE path = 'topics/page-1.md'")
def vlt_reject(spark, sf):
    """VLT-05: rejected pages go, those outside quarantine are refused."""
    pages = _pages(spark, sf).select("path").union(vault.propose(_pages(spark, sf).where("n % 2 = 0")).select("path"))
    left, refused = vault.reject(pages, _REJECTED)
    return left.withColumn("refused", F.lit(False)).union(refused.withColumn("refused", F.lit(True)))


@query(f"WITH {_PAGES} SELECT count(*) FILTER (doc_id % 5 = 0) AS strays, count(*) FILTER (doc_id % 7 = 0) AS leaked FROM p")
def vlt_isolation(spark, sf):
    """VLT-06, SET-05: index paths without a page, and quarantined ones in the index."""
    pages = _pages(spark, sf)
    hidden = vault.propose(pages.where("n % 7 = 0"))
    index = pages.select("path").union(hidden.select("path"))
    return vault.isolation(index, pages.where("n % 5 <> 0").union(hidden))


@query("WITH s AS (SELECT md5(text) AS h, trim(text, ' ') AS t FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT h FROM s) AND trim(text, ' ') NOT IN (SELECT t FROM s)")
def vlt_new_only(spark, sf):
    """JN-16, SNK-06, HSH-03: incoming pages that no stored one equals by hash or trimmed text."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"), F.col("text").alias("body"))
    return vault.new_only(d, d.where("doc_id % 3 = 0").select("hash", F.concat(F.lit("  "), "body").alias("body"))).select("doc_id")


@query(f"""WITH {_PAGES}, o AS (SELECT path, doc_id, md5(body) AS h, CASE WHEN doc_id % 8 = 0 THEN 'active' ELSE status END AS s, status FROM p) SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM o
WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND s <> status)""")
def vlt_delta(spark, sf):
    """VLT-07, JN-09: what changed since pages were indexed, their states included."""
    p = _pages(spark, sf)
    was = p.where("n % 5 <> 0")
    now = p.where("n % 7 <> 0").withColumn("status", F.when(F.col("n") % 8 == 0, "active").otherwise(F.col("status")))
    return vault.delta(was, now)


# --- Memory

_POOL = _bm25_sql(["ble", "ly"], False, k=20).replace("SELECT doc_id AS doc, round(", "SELECT doc_id AS doc, (").replace(", 6) AS score", ") AS score").replace("FROM documents", _PAGE_TEXTS)
_NOW = 90_000_000.0


def _recalled(spark, sf, corrected=False) -> DataFrame:
    pages = _pages(spark, sf)
    index = vault.tables(pages)
    return vault.recall(search.bm25(index["postings"], index["stats"], search.or_phrases("ble ly"), every=False), pages, _NOW, 5, 4, corrected)


@query(f"""WITH f AS ({_POOL}), {_PAGES}, r AS (SELECT path, 1 / (1 + score) * exp(-greatest(0, {_NOW}::DOUBLE - doc_id * 3600) / (86400::DOUBLE * (1 + ln(1 + (doc_id % 5)::DOUBLE)))) AS rank FROM f JOIN p ON p.path = f.doc)
SELECT path, round(rank, 6) AS rank FROM r ORDER BY r.rank DESC, path LIMIT 5""")
def mem_decay_rerank(spark, sf):
    """MEM-02, TOP-03, DT-04: a pool of twenty by relevance, the best five by relevance and decay."""
    return _recalled(spark, sf).select("path", F.round("rank", 6).alias("rank"))


@query(f"""WITH f AS ({_POOL}), {_PAGES}, r AS (SELECT path, 1 / (1 + score) * exp(-greatest(0, {_NOW}::DOUBLE - doc_id * 3600) / (86400::DOUBLE * (1 + ln(1 + (doc_id % 5)::DOUBLE)))) AS rank FROM f JOIN p ON p.path = f.doc)
, b AS (SELECT path FROM r ORDER BY r.rank DESC, path LIMIT 5) SELECT p.path, (p.doc_id % 5 + CASE WHEN b.path IS NULL THEN 0 ELSE 1 END)::BIGINT AS access_count, b.path IS NOT NULL AS now FROM p LEFT JOIN b USING (path)""")
def mem_touched(spark, sf):
    """MEM-02: one more access for the returned notes only."""
    out = vault.touched(_pages(spark, sf).withColumn("was", F.col("access_count")), _recalled(spark, sf), _NOW)
    now = F.coalesce(F.unix_micros("last_access") == int(_NOW * 1e6), F.lit(False)) & (F.col("access_count") > F.col("was"))  # a note's last access may have been now already
    return out.select("path", F.col("access_count").cast("long"), now.alias("now"))


@query("SELECT 'memory/notes/core-memory.md' AS path, 'Core facts' AS title, 'Alpha rules.' AS summary, 3 AS version, 'core pinned' AS tags")
def mem_core(spark, sf):
    """MEM-01: the core page written twice over a vault of notes, its version counted up."""
    pages = _pages(spark, sf).select("path", "kind", "name", "title", "summary", "tags", "status", "version", "created", "updated", "body")
    for i, said in enumerate(("first", "second", "# Core facts\nAlpha rules. Beta follows.")):
        pages = vault.write_core(pages, said, float(i))
    return pages.where(F.col("path") == vault.CORE).select("path", "title", "summary", "version", F.concat_ws(" ", "tags").alias("tags"))


@query(f"""WITH f AS ({_POOL}), {_PAGES}, r AS (SELECT path, 1 / (1 + score) * exp(-greatest(0, {_NOW}::DOUBLE - doc_id * 3600) / (86400::DOUBLE * (1 + ln(1 + (doc_id % 5)::DOUBLE)))) AS rank FROM f JOIN p ON p.path = f.doc)
, b AS (SELECT path, row_number() OVER (ORDER BY rank DESC, path) AS place FROM r) SELECT path, CASE WHEN place = 1 THEN 'Alpha rules.' END AS core_memory FROM b WHERE place <= 5""")
def mem_with_core(spark, sf):
    """MEM-02: the core page's summary with the first of the recalled notes."""
    pages = vault.write_core(_pages(spark, sf), "# Core facts\nAlpha rules. Beta follows.", 1.0)
    return vault.with_core(_recalled(spark, sf), pages).select("path", "core_memory")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own FROM documents), h AS (SELECT doc_id, trim(regexp_extract(own, '^#+\s+([^\n]+)', 1)) AS heading, trim(split_part(own, chr(10), 1)) AS first FROM t),
n AS (SELECT doc_id, substr(CASE WHEN heading <> '' THEN heading WHEN length(first) > 4 THEN first ELSE 'untitled' END, 1, 256) AS title FROM h),
s AS (SELECT doc_id, title, regexp_replace(substr(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), 1, 64), '^-+|-+$', '', 'g') AS slug FROM n)
SELECT doc_id, title, CASE WHEN slug = '' THEN 'untitled' ELSE slug END AS slug FROM s""")
def mem_notes(spark, sf):
    """MEM-01, STR-03, STR-06: the title of every text as a note, and its slug."""
    return vault.notes(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))).select("doc_id", "title", "slug")


@query("SELECT doc_id, doc_id % 4 = 0 AS said, CASE WHEN doc_id % 2 = 0 THEN 'a b' END AS words FROM documents")
def mem_described(spark, sf):
    """MEM-05: a model's summary and keywords where it gave any, the text's own else."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    said = rows.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("said by "), "path")).otherwise(" ").alias("said"), F.array(F.lit("a"), F.lit("b")).alias("words"))
    out = vault.described(rows, said)
    own = F.col("keywords") == text.keywords(F.col("body"))
    return out.select("doc_id", F.startswith("summary", F.lit("said by ")).alias("said"), F.when(~own, F.concat_ws(" ", "keywords")).alias("words"))


# --- Runs

_EVENTS = {"view": "corpus_served", "click": "guardrail", "purchase": "end", "signup": "repl_result", "error": "root_message"}


def _log(spark, sf) -> DataFrame:
    e, n = table(spark, sf, "events"), F.col("event_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in _EVENTS.items()])
    band = F.when(F.col("value") >= 60, "strong").when(F.col("value") >= 30, "partial").when(F.col("value") >= 10, "weak").otherwise("none")
    spot = lambda by: F.concat(F.lit("d"), (n % by).cast("string"), F.lit("#L0-10"))
    served = F.array(F.struct(spot(50).alias("address"), band.alias("band")), F.struct(spot(70).alias("address"), F.lit(None).cast("string").alias("band")))
    return e.select(
        F.col("user_id").alias("run_id"), kind.alias("event"), (n % 9).cast("int").alias("turn"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"), n.alias("event_id"),
        _pick(("citations_recorded", "citations_repaired", "citations_weak"), n).alias("guardrail"), F.when(kind == "corpus_served", served).alias("addresses"), F.concat(F.lit("q"), (n % 5).cast("string")).alias("query"),
        F.when(kind == "end", F.concat(F.lit("see "), spot(50), F.lit(", "), spot(50), F.lit("; "), spot(999))).alias("final_answer"), F.when(F.col("value") < 30, "ValueError: no").alias("stderr"),
        _pick(("assistant", "user"), n).alias("role"), _pick(("```repl\ngrep('a')\n```", "so it is", "x = “1”", "```python\nllm_query('p')\n```", "no"), n).alias("content"), _pick(("m1", "m2", "m3"), F.col("user_id")).alias("model"),
    )


_LOG = """l AS (SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'corpus_served' WHEN 'click' THEN 'guardrail' WHEN 'purchase' THEN 'end' WHEN 'signup' THEN 'repl_result' ELSE 'root_message' END AS event, event_id % 9 AS turn, epoch_us(ts)::DOUBLE AS timestamp, event_id,
list_extract(['citations_recorded', 'citations_repaired', 'citations_weak'], (event_id % 3)::INT + 1) AS guardrail, 'd' || (event_id % 50) || '#L0-10' AS one, 'd' || (event_id % 70) || '#L0-10' AS two, 'd' || (event_id % 999) || '#L0-10' AS far,
CASE WHEN value >= 60 THEN 'strong' WHEN value >= 30 THEN 'partial' WHEN value >= 10 THEN 'weak' ELSE 'none' END AS band, 'q' || (event_id % 5) AS query, value, CASE WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, event_id % 5 AS c,
list_extract(['m1', 'm2', 'm3'], (user_id % 3)::INT + 1) AS model FROM events)"""
_SERVED = """s AS (SELECT run_id, address, min(CASE band WHEN 'strong' THEN 0 WHEN 'partial' THEN 1 WHEN 'weak' THEN 2 WHEN 'none' THEN 3 END) AS r FROM (SELECT run_id, one AS address, band FROM l WHERE event = 'corpus_served' UNION ALL SELECT run_id, two, NULL FROM l WHERE event = 'corpus_served') GROUP BY 1, 2)"""
_CITED = "c AS (SELECT run_id, one AS address FROM l WHERE event = 'end' UNION SELECT run_id, far FROM l WHERE event = 'end')"


@query(f"""WITH {_LOG} SELECT run_id, max(turn) AS turns, count(*) FILTER (event = 'corpus_served') AS searches, count(*) FILTER (event = 'guardrail') AS guardrails, min(turn) FILTER (event = 'repl_result' AND turn > 0) AS first_helper_turn, bool_or(event = 'end') AS ended FROM l GROUP BY 1""")
def trj_run_facts(spark, sf):
    """TRJ-01, AGG-28: one row of facts a run."""
    return traces.run_facts(_log(spark, sf)).drop("final_answer")


@query(f"WITH {_LOG} SELECT run_id, guardrail, count(*) AS n FROM l WHERE event = 'guardrail' GROUP BY 1, 2")
def trj_guardrails(spark, sf):
    """AGG-28, TRJ-08: guardrails by name; citations recorded, repaired and weak."""
    return traces.guardrails(_log(spark, sf))


@query(f"WITH {_LOG} SELECT run_id, band, count(*) AS n FROM (SELECT run_id, band FROM l WHERE event = 'corpus_served' UNION ALL SELECT run_id, 'untold' FROM l WHERE event = 'corpus_served') GROUP BY 1, 2")
def trj_bands(spark, sf):
    """AGG-28: bands served to each run."""
    return traces.bands(_log(spark, sf))


@query(f"WITH {_LOG} SELECT run_id, turn, query, " + ", ".join(f"(band = '{b}')::INT AS {b}" for b in ("strong", "partial", "weak", "none")) + " FROM l WHERE event = 'corpus_served'")
def trj_search_quality(spark, sf):
    """AGG-30: how many hits of every search have each band."""
    return traces.search_quality(_log(spark, sf))


@query(f"WITH {_LOG}, {_SERVED} SELECT run_id, address, list_extract(['strong', 'partial', 'weak', 'none'], r + 1) AS band FROM s")
def trj_served(spark, sf):
    """AGG-29, TRJ-05: every served address with its strongest band."""
    return traces.served(_log(spark, sf))


def _cited(spark, sf) -> DataFrame:
    return traces.cited(_log(spark, sf).where("event = 'end'"))


@query(f"WITH {_LOG}, {_CITED} SELECT run_id, address FROM c")
def trj_cited(spark, sf):
    """WIN-03, STR-25: addresses in answers, once a run."""
    return _cited(spark, sf)


@query(f"WITH {_LOG}, {_SERVED}, {_CITED} SELECT c.run_id, c.address FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.run_id = c.run_id AND s.address = c.address) AND c.run_id IN (SELECT run_id FROM s)")
def set_cited_unserved(spark, sf):
    """SET-03, JN-21: citations that no search of their run served."""
    told = traces.audit(traces.served(_log(spark, sf)), _cited(spark, sf))
    return told.select("run_id", F.explode("unserved").alias("address"))


@query(f"WITH {_LOG}, {_SERVED}, {_CITED} SELECT s.run_id, s.address FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE s.run_id = c.run_id AND s.address = c.address)")
def trj_left(spark, sf):
    """SET-04: served and never cited."""
    told = traces.audit(traces.served(_log(spark, sf)), _cited(spark, sf))
    return told.select("run_id", F.explode("left").alias("address"))


@query(f"""WITH {_LOG}, {_SERVED}, {_CITED}, a AS (SELECT c.run_id, count(*) FILTER (s.address IS NULL AND c.run_id IN (SELECT run_id FROM s)) AS unserved, count(*) FILTER (s.address IS NOT NULL AND coalesce(s.r, 9) <= 1) AS answering,
count(*) FILTER (s.address IS NOT NULL AND coalesce(s.r, 9) > 1) AS non, count(*) FILTER (c.run_id NOT IN (SELECT run_id FROM s)) AS unknown FROM c LEFT JOIN s ON s.run_id = c.run_id AND s.address = c.address GROUP BY 1), r AS (SELECT DISTINCT run_id FROM l)
SELECT run_id, CASE WHEN coalesce(unserved, 0) > 0 THEN 'unserved' WHEN coalesce(non, 0) > 0 AND answering = 0 THEN 'weak' WHEN coalesce(answering + non + unknown, 0) = 0 THEN 'uncited' END AS refusal FROM r LEFT JOIN a USING (run_id)""")
def trj_refusal_rule(spark, sf):
    """TRJ-07: why an answer is refused."""
    log = _log(spark, sf)
    return traces.refusals(traces.audit(traces.served(log), _cited(spark, sf)), log.select("run_id").distinct())


_USED = f"""{_LOG}, {_SERVED}, {_CITED}, u AS (SELECT source, coalesce(a.n, 0) AS served, coalesce(b.n, 0) AS cited FROM (SELECT split_part(address, '#', 1) AS source, count(*) AS n FROM s GROUP BY 1) a FULL JOIN (SELECT split_part(address, '#', 1) AS source, count(*) AS n FROM c GROUP BY 1) b USING (source))"""


def _used(spark, sf) -> DataFrame:
    return traces.usage(traces.served(_log(spark, sf)), _cited(spark, sf))


@query(f"WITH {_USED} SELECT source, served, cited, 'prose' AS class FROM u ORDER BY cited DESC, served DESC, source")
def set_rank_usage(spark, sf):
    """AGG-19, SET-01, TOP-06, TRJ-06: how often each document was served and cited."""
    return _used(spark, sf)


@query(f"WITH {_USED} SELECT source, served, cited FROM u WHERE cited > 0 ORDER BY cited DESC, served DESC, source LIMIT 30")
def trj_selected(spark, sf):
    """FLT-14, WIN-10: the first thirty cited documents of a plan; the limit is the feature."""
    return traces.selected(_used(spark, sf), 30, cited_only=True).select("source", "served", "cited")


@query(f"WITH {_USED} SELECT 'prose' AS class, count(*) AS documents, sum(cited)::BIGINT AS cited, round(count(*) * 29.3::DOUBLE / 3600, 2) AS hours_least, round(count(*) * 802.9::DOUBLE / 3600, 2) AS hours_most FROM u")
def trj_plan(spark, sf):
    """AGG-20: what a plan would describe, and its cost."""
    used = _used(spark, sf)
    return traces.plan_histogram(used).join(traces.cost_range(used, 29.3, 802.9), "documents")


@query(f"WITH {_LOG} SELECT 'messages' AS kind, count(*) FILTER (event = 'root_message' AND role = 'assistant') AS n FROM l UNION ALL SELECT 'results', count(*) FILTER (event = 'repl_result') FROM l UNION ALL SELECT 'searches', count(*) FILTER (event = 'corpus_served') FROM l")
def trj_filters(spark, sf):
    """FLT-24: an assistant's messages, what cells gave, and searches."""
    log = _log(spark, sf)
    rows = [part.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n")) for name, part in (("messages", traces.messages(log)), ("results", traces.results(log)), ("searches", traces.searches(log)))]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"WITH {_LOG} SELECT query IN ('q1', 'q2') AS shares, band, count(*) AS n FROM l WHERE event = 'corpus_served' GROUP BY 1, 2")
def trj_band_crosstab(spark, sf):
    """TRJ-09: searches that share no term with the question, by band."""
    rows = _log(spark, sf).where("event = 'corpus_served'").select(F.lit("about one1 and two2").alias("question"), _pick(("none", "one1", "two2", "three", "four"), F.col("event_id")).alias("query"), F.col("addresses")[0]["band"].alias("band"))
    return probes.off_question(rows)


_MESSAGES = f"{_LOG}, a AS (SELECT * FROM l WHERE event = 'root_message' AND role = 'assistant')"


@query(f"""WITH {_MESSAGES}, t AS (SELECT model, run_id, bool_or(c IN (0, 3)) AS met FROM a GROUP BY 1, 2) SELECT model, round(20.0::DOUBLE * count(*) FILTER (met) / count(*)) AS score, 20.0::DOUBLE AS max_score, count(*) FILTER (met) >= count(*) * 2.0::DOUBLE / 3 AS passed FROM t GROUP BY 1""")
def prb_emission(spark, sf):
    """TRJ-11: trials with a runnable block."""
    return probes.emission(traces.messages(_log(spark, sf)))


@query(f"WITH {_MESSAGES} SELECT model, CASE WHEN count(*) FILTER (c = 0) > 0 THEN 15.0::DOUBLE ELSE 0 END AS score, 15.0::DOUBLE AS max_score, count(*) FILTER (c = 0) > 0 AS passed FROM a GROUP BY 1")
def prb_helper_calls(spark, sf):
    """TRJ-11, STR-21: helper calls whose brackets balance."""
    return probes.helper_calls(traces.messages(_log(spark, sf)))


@query(f"""WITH {_LOG}, r AS (SELECT model, run_id, turn, value < 30 AS failed FROM l WHERE event = 'repl_result'), f AS (SELECT model, run_id, min(turn) FILTER (failed) AS first FROM r GROUP BY 1, 2),
o AS (SELECT f.model, f.run_id, f.first IS NULL OR bool_or(NOT r.failed AND r.turn > f.first) AS ok FROM f JOIN r USING (model, run_id) GROUP BY f.model, f.run_id, f.first), t AS (SELECT DISTINCT model, run_id FROM l),
p AS (SELECT model, bool_and(coalesce(ok, false)) AS passed FROM t LEFT JOIN o USING (model, run_id) GROUP BY 1) SELECT model, CASE WHEN passed THEN 15.0::DOUBLE ELSE 0 END AS score, 15.0::DOUBLE AS max_score, passed FROM p""")
def prb_recovery(spark, sf):
    """TRJ-11, WIN-06: clean cells in a later turn than the first failed one."""
    return probes.recovery(_log(spark, sf))


@query(f"WITH {_MESSAGES} SELECT model, greatest(0, 10.0::DOUBLE - 5 * count(*) FILTER (c IN (1, 2))) AS score, 10.0::DOUBLE AS max_score, count(*) FILTER (c IN (1, 2)) = 0 AS passed FROM a GROUP BY 1")
def prb_format(spark, sf):
    """TRJ-11: replies without a runnable block."""
    return probes.format_discipline(traces.messages(_log(spark, sf)))


@query("""WITH a AS (SELECT 'm' || n_regionkey AS model, 't' || (n_nationkey % 4) AS task, n_nationkey FROM nation), t(task) AS (VALUES ('t0'), ('t1'), ('t2')), m AS (SELECT DISTINCT model FROM a)
SELECT m.model, 5.0::DOUBLE * count(*) FILTER (n_nationkey % 2 = 0) AS score, 5.0::DOUBLE * count(*) AS max_score, count(*) FILTER (n_nationkey % 2 = 0) >= 2 AS passed FROM m CROSS JOIN t LEFT JOIN a ON a.model = m.model AND a.task = t.task GROUP BY 1""")
def prb_needles(spark, sf):
    """TRJ-11: needles in answers, case and hyphens aside."""
    n = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model"), F.concat(F.lit("t"), (n % 4).cast("string")).alias("task"), F.when(n % 2 == 0, F.lit("It is O Negative.")).otherwise("none").alias("answer"))
    tasks = spark.createDataFrame([(f"t{i}", "o-negative") for i in range(3)], "task string, needle string")
    return probes.needles(rows, tasks)


@query(f"WITH {_MESSAGES} SELECT model, CASE WHEN bool_or(c = 3) THEN 5.0::DOUBLE ELSE 3 END AS score, 5.0::DOUBLE AS max_score, bool_or(c = 3) AS passed FROM a GROUP BY 1")
def prb_subcalls(spark, sf):
    """TRJ-11: replies that ask a further model."""
    return probes.subcalls(traces.messages(_log(spark, sf)))


_CELLS = "m AS (SELECT (conv_id % 40)::VARCHAR AS model, (conv_id * 7 + turn) % 97 = 0 AS bent FROM conversations)"


@query(f"WITH {_CELLS} SELECT model, CASE WHEN count(*) FILTER (bent) = 0 THEN 5.0::DOUBLE ELSE 0 END AS score, 5.0::DOUBLE AS max_score, count(*) FILTER (bent) = 0 AS passed FROM m GROUP BY 1")
def prb_quotes(spark, sf):
    """TRJ-11, STR-21: whether a runnable block holds typographic quotes."""
    mark = F.when((F.col("conv_id") * 7 + F.col("turn")) % 97 == 0, "\u201d").otherwise('"')
    said = F.concat(F.lit("\u201csaid\u201d\n```repl\nx = "), mark, F.regexp_replace("text", "[`\u201c\u201d\u201e\u2018\u2019\u201a]", ""), mark, F.lit("\n```"))
    return probes.quotes(table(spark, sf, "conversations").select((F.col("conv_id") % 40).cast("string").alias("model"), said.alias("content")))


@query("""SELECT (conv_id % 40)::VARCHAR AS model, (coalesce(sum(length(text)) FILTER (turn > 0 AND role = 'assistant'), 0) // 4)::BIGINT AS tokens, count(*) FILTER (turn = 0) AS turns,
max(turn * 10.0 + conv_id)::DOUBLE - min(turn * 10.0 + conv_id)::DOUBLE AS seconds FROM conversations GROUP BY 1""")
def prb_speed(spark, sf):
    """TRJ-11: a report of estimated tokens over turns and time."""
    c = table(spark, sf, "conversations")
    events = c.select((F.col("conv_id") % 40).cast("string").alias("model"), F.when(F.col("turn") == 0, "turn_start").otherwise("root_message").alias("event"), "role", F.col("text").alias("content"), (F.col("turn") * 10.0 + F.col("conv_id")).alias("timestamp"))
    return probes.speed(events).drop("tokens_per_second")


@query("""WITH s AS (SELECT n_regionkey, count(*) AS n, string_agg('### ' || n_name || ' — ' || (n_nationkey % 3) || '.0/2.0 (' || CASE WHEN n_nationkey % 3 = 2 THEN 'PASS' ELSE 'FAIL' END || ')' || chr(10), chr(10) ORDER BY n_name) AS parts, count(*) FILTER (n_nationkey % 3 = 2) AS p FROM nation GROUP BY 1)
SELECT r_name AS model, '---' || chr(10) || 'model: ' || r_name || chr(10) || 'score: 50' || chr(10) || 'verdict: MARGINAL' || chr(10) || 'weights: default' || chr(10) || 'date: 2026-01-02' || chr(10) || '---' || chr(10) || '# Model Suitability Report: ' || r_name || chr(10) || chr(10)
|| '**Score:** 50/100' || chr(10) || '**Verdict:** MARGINAL' || chr(10) || '**Probes:** ' || p || '/' || n || ' passed' || chr(10) || chr(10) || '## Per-Probe Results' || chr(10) || chr(10) || parts AS page FROM s JOIN region ON r_regionkey = n_regionkey""")
def prb_report(spark, sf):
    """SNK-09: a page on every model's check."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scores = rows.select(F.col("r_name").alias("model"), F.col("n_name").alias("probe"), (F.col("n_nationkey") % 3).cast("double").alias("score"), F.lit(2.0).alias("max_score"), (F.col("n_nationkey") % 3 == 2).alias("passed"))
    totals = table(spark, sf, "region").select(F.col("r_name").alias("model"), F.lit(50).alias("score"), F.lit("MARGINAL").alias("verdict"))
    return probes.report_page(scores, totals, "2026-01-02")


_WHOLE = "answer['ready'] = True"
_SUBMITTED = (f"```repl\nx = '''{_WHOLE}'''\n```", f"```repl\n{_WHOLE}\n```", f"```bash\n{_WHOLE}\n```", f"say {_WHOLE}", "nothing here")


@query("""WITH m AS (SELECT user_id, event_id, (user_id + event_id % 2) % 5 AS c FROM events), r AS (SELECT user_id, min(CASE c WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 4 END WHEN 2 THEN 5 WHEN 3 THEN 6 END) AS k FROM m WHERE c <> 4 GROUP BY 1)
SELECT user_id AS run_id, list_extract(['submission_text_is_quoted_or_commented', 'submission_block_raised', 'submission_answer_rebound', 'submission_state_inconsistent', 'submission_not_reached_at_runtime', 'submission_text_in_unexecutable_fence', 'submission_text_outside_fence'], k + 1) AS code FROM r""")
def trj_missing_submission(spark, sf):
    """TRJ-10: why a submission's text never became an answer, by the first code that holds."""
    n, user = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf, "events").select(user.alias("run_id"), _pick(_SUBMITTED, user + n % 2).alias("content"), (n % 3 == 0).alias("raised"), F.lit(False).alias("rebound"), F.lit(None).cast("boolean").alias("inconsistent"))
    return probes.missing_submission(rows)


@query("SELECT source || '/' || doc_id || '#L2-' || (12 + doc_id % 5) AS address, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')[3:(12 + doc_id % 5)::INT] AS text FROM documents")
def trj_passages(spark, sf):
    """TRJ-04, SRC-22: the bytes that addresses name."""
    source = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents").select(source.alias("source"), "doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("content"))
    return probes.passages(d.select(F.concat("source", F.lit("#L2-"), (12 + F.col("doc_id") % 5).cast("string")).alias("address")), d)


# --- Metrics


@query("""WITH r AS (SELECT event_type AS model, event_id // 2 AS k, event_id % 2 AS odd, value FROM events), s AS (SELECT model, k FROM r WHERE odd = 0), e AS (SELECT model, k, value FROM r WHERE odd = 1), f AS (SELECT model, count(*) AS n FROM s ANTI JOIN e USING (model, k) GROUP BY 1)
SELECT e.model, count(*) AS attempted, round(median(value), 1) AS seconds_median, coalesce(any_value(f.n), 0) AS in_flight FROM e LEFT JOIN f USING (model) GROUP BY 1""")
def jn_start_end_pairing(spark, sf):
    """JN-13, STM-06, AGG-21: calls that started and have not ended."""
    n = F.col("event_id")
    e = table(spark, sf, "events").select(F.when(n % 2 == 0, "start").otherwise("end").alias("kind"), F.col("event_type").alias("model"), F.floor(n / 2).cast("string").alias("started_at"), F.col("value").alias("seconds"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("output_chars", "long"), ("input_chars", "long"), ("compression", "double"), ("groundedness", "double"), ("client_residual_seconds", "double"), ("boilerplate", "boolean"), ("cap_hit", "boolean"), ("empty", "boolean"), ("torn", "boolean"), ("error", "string"))}
    server = F.lit(None).cast("struct<prompt_tokens:long,predicted_tokens:long,cached_tokens:long,prompt_ms:double,predicted_ms:double>")
    return metrics.by_model(e.withColumns(nothing).withColumn("server", server)).select("model", "attempted", "seconds_median", "in_flight")


@query("""WITH t AS (SELECT event_type AS model, CASE WHEN value > 60 THEN 'voluntary' WHEN value > 30 THEN 'forced' ELSE 'none' END AS o FROM events) SELECT model, round(15.0::DOUBLE * (count(*) FILTER (o = 'voluntary') + 8.0::DOUBLE / 15 * count(*) FILTER (o = 'forced')) / count(*), 1) AS score,
count(*) FILTER (o = 'voluntary') > count(*) / 2.0::DOUBLE AS passed FROM t GROUP BY 1""")
def mtr_trial_score(spark, sf):
    """AGG-24."""
    outcome = F.when(F.col("value") > 60, "voluntary").when(F.col("value") > 30, "forced").otherwise("none")
    return metrics.trial_score(table(spark, sf, "events").select(F.col("event_type").alias("model"), outcome.alias("outcome")))


@query("SELECT lang AS suite, count(*) FILTER (doc_id % 3 <> 0 AND regexp_matches(text, 'th[aeiou]{1,2}r')) AS passed, count(*) AS total, round(count(*) FILTER (doc_id % 3 <> 0 AND regexp_matches(text, 'th[aeiou]{1,2}r'))::DOUBLE / count(*), 6) AS score FROM documents GROUP BY 1")
def mtr_evaluate(spark, sf):
    """AGG-26: answers that match their task's pattern; a missing one fails."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("suite"), F.col("doc_id").alias("name"), F.col("text").alias("answer"))
    tasks = d.select("suite", "name", F.lit("th[aeiou]{1,2}r").alias("expected_pattern"))
    return metrics.evaluate(d.where("name % 3 <> 0"), tasks).withColumn("score", F.round("score", 6))


@query("WITH f AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1 ORDER BY doc_id LIMIT 12) SELECT doc_id AS place FROM f ORDER BY length(text), doc_id")
def mtr_few_shots(spark, sf):
    """TOP-08: the first passing answers, the shortest first; the limit is the feature."""
    return metrics.few_shots(table(spark, sf, "documents").select(F.col("doc_id").alias("place"), F.col("text").alias("answer"), (F.col("doc_id") % 2 == 1).alias("passed")), 12).select("place")


# --- Search


def _read_files(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    source = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", "lang", source.cast("binary").alias("source"), source.alias("display"), F.col("text").cast("binary").alias("data"))


def _chunks(spark, sf) -> DataFrame:
    """All chunks of every document, read in an encoding by its language."""
    d = _read_files(spark, sf)
    encoding = F.when(F.col("lang") == "en", "utf-8").when(F.col("lang") == "fr", "cp1252")
    return search.chunks(d, "doc_id", "data").join(d.drop("data"), "doc_id").withColumn("encoding", encoding)


@query(f"""WITH RECURSIVE {_CHUNKED}, {_QUEUE}, k AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'document' ELSE 'archive' END AS kind FROM documents), i AS (SELECT count(DISTINCT doc_id) AS sources_indexed, count(*) AS chunks, sum(byte_end - byte_start)::BIGINT AS bytes FROM chunked JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT i.*, (SELECT count(*) FROM k WHERE kind = 'text') AS text_files_in_map, (SELECT count(*) FROM k WHERE kind <> 'text') AS documents_in_map, (SELECT count(*) FROM q WHERE task = 'extract_text' AND state = 'done') AS documents_extracted,
(SELECT count(*) FROM q WHERE task = 'extract_text' AND note = 'needs_ocr') AS documents_needing_ocr, round(sources_indexed::DOUBLE / (SELECT count(*) FROM k WHERE kind = 'text'), 6) AS text_coverage FROM i""")
def agg_coverage(spark, sf):
    """AGG-12, AGG-13: the eight figures of what is indexed of what there is."""
    known = table(spark, sf, "documents").select(_pick(("text", "document", "archive"), F.col("doc_id")).alias("kind"))
    out = search.coverage(_chunks(spark, sf).where("lang = 'en'"), known, _queue(spark, sf))
    return out.withColumn("text_coverage", F.round("text_coverage", 6))


@query(f"WITH RECURSIVE {_CHUNKED} SELECT source || '/' || doc_id || '#L' || byte_start || '-' || byte_end AS address, doc_id FROM chunked JOIN documents USING (doc_id) WHERE (doc_id + byte_start) % 7 = 0")
def fts_addressed(spark, sf):
    """JN-17, FTS-14: chunks that addresses name; other byte ranges name none."""
    c = _chunks(spark, sf)
    end = F.when((F.col("doc_id") + F.col("byte_start")) % 7 == 0, F.col("byte_end")).otherwise(F.col("byte_end") + 1)
    asked = c.select(F.concat("display", F.lit("#L"), F.col("byte_start").cast("string"), F.lit("-"), end.cast("string")).alias("address"))
    return search.addressed(c, asked).select("address", "doc_id")


@query("SELECT doc_id, 'src/' || doc_id || '#L0-9' AS address FROM documents")
def fts_hit_lines(spark, sf):
    """FTS-13, PRJ-03, TRJ-05: a printed hit and the address read back from its first line."""
    address = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("#L0-9"))
    line = search.hit_line(address, F.col("text"), [F.col("lang"), F.lit("derived:x")])
    return table(spark, sf, "documents").select("doc_id", search.address_of_line(line).alias("address"))


@query("SELECT doc_id, 'd' || doc_id || ' [' || lang || ']' || chr(10) || substr(trim(regexp_replace(html_text, '[\\s\\x0B\\x{85}\\p{Z}]+', ' ', 'g'), ' '), 1, 300) AS line FROM (SELECT doc_id, lang, text AS html_text FROM documents)")
def fts_snippets(spark, sf):
    """FTS-13, PRJ-03: white space collapsed, 300 characters."""
    return table(spark, sf, "documents").select("doc_id", search.hit_line(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text"), [F.col("lang")]).alias("line"))


@query(f"WITH RECURSIVE {_CHUNKED} SELECT DISTINCT source || '/' || doc_id AS source, 'latin-1' AS encoding FROM chunked JOIN documents USING (doc_id) WHERE doc_id % 2 = 0")
def fts_repairs(spark, sf):
    """FTS-18: sources whose chunks were read in another encoding than they have."""
    c = _chunks(spark, sf)
    known = _read_files(spark, sf).select(F.col("source").alias("raw"), F.when(F.col("doc_id") % 2 == 0, "latin-1").when(F.col("lang") == "fr", "cp1252").alias("encoding"))
    return search.repairs(c, known).select(F.col("source").cast("string").alias("source"), "encoding")


@query(f"""WITH RECURSIVE {_CHUNKED}, d AS (SELECT doc_id, strlen(text) AS size, CASE WHEN doc_id % 2 = 0 THEN 'latin-1' WHEN lang = 'fr' THEN 'cp1252' END AS now, CASE lang WHEN 'en' THEN 'utf-8' WHEN 'fr' THEN 'cp1252' END AS was FROM documents WHERE doc_id IN (SELECT doc_id FROM chunked))
SELECT CASE WHEN now = was THEN 'current' WHEN doc_id % 11 = 0 THEN 'missing' WHEN size > 3000 THEN 'too large' ELSE 'replaced' END AS cause, count(*) AS sources FROM d WHERE now IS NOT NULL GROUP BY 1""")
def fts_repair_report(spark, sf):
    """FTS-18: what a pass of repair does with its candidates, by cause."""
    c = _chunks(spark, sf)
    known = _read_files(spark, sf).select(F.col("source").alias("raw"), F.when(F.col("doc_id") % 2 == 0, "latin-1").when(F.col("lang") == "fr", "cp1252").alias("encoding"))
    size = table(spark, sf, "documents").where("doc_id % 11 <> 0").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).cast("binary").alias("source"), F.octet_length("text").alias("size"))
    return search.repair_report(c, known, size, 3000)


def _counts(index) -> DataFrame:
    postings, stats = index
    return stats.groupBy("doc").agg(F.max("len").alias("len")).join(postings.groupBy("doc").agg(F.count(F.lit(1)).alias("terms")), "doc", "left").select("doc", "len", F.coalesce("terms", F.lit(0)).alias("terms"))


_INDEXED = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"


@query(f"WITH t AS (SELECT doc_id AS doc, {_INDEXED} AS w FROM documents WHERE doc_id % 3 <> 0) SELECT doc, len(w) AS len, len(list_distinct(w)) AS terms FROM t")
def fts_drop_sources(spark, sf):
    """FTS-17: an index without some sources."""
    index = search.index(table(spark, sf, "documents"), "doc_id", "text")
    return _counts(search.drop_sources(*index, table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"))))


@query(f"WITH t AS (SELECT doc_id AS doc, {_INDEXED} AS w FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'One two two' ELSE text END AS text FROM documents)) SELECT doc, len(w) AS len, len(list_distinct(w)) AS terms FROM t")
def fts_replace_sources(spark, sf):
    """FTS-02: sources read again stand for what was there."""
    d = table(spark, sf, "documents")
    return _counts(search.replace_sources(*search.index(d, "doc_id", "text"), d.where("doc_id % 3 = 0").withColumn("text", F.lit("One two two")), "doc_id", "text"))


@query(f"WITH t AS (SELECT doc_id AS doc, {_INDEXED} AS w FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'One two two' END AS text FROM documents)) SELECT doc, len(w) AS len, len(list_distinct(w)) AS terms FROM t")
def fts_add_sources(spark, sf):
    """FTS-02: sources that an index holds already are skipped."""
    d = table(spark, sf, "documents")
    return _counts(search.add_sources(*search.index(d.where("doc_id % 3 = 0"), "doc_id", "text"), d.withColumn("text", F.lit("One two two")), "doc_id", "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cp850' WHEN lang = 'fr' THEN 'cp1252' ELSE 'utf-8' END AS encoding FROM documents")
def fts_encoding_for(spark, sf):
    """FTS-02: the caller's encoding, else the classification's, else UTF-8."""
    return table(spark, sf, "documents").select("doc_id", search.encoding_for(F.when(F.col("doc_id") % 2 == 0, "cp850"), F.when(F.col("lang") == "fr", "cp1252")).alias("encoding"))


_PATHED = "CASE WHEN doc_id % 4 = 0 THEN 'node_modules/' ELSE 'a/' END || doc_id || '.txt'"


def _sources(spark, sf) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 4 == 0, "node_modules/").otherwise("a/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), path.alias("path"), (F.col("doc_id") % 2 == 1).alias("derived"))


@query(_bm25_sql(["ble", "ly"], True, "doc_id % 4 <> 0 AND doc_id % 2 = 1", 8))
def flt_combined(spark, sf):
    """FLT-21, FTS-19: a command's search: no vendored paths, derived text only."""
    index = search.index(table(spark, sf, "documents"), "doc_id", "text")
    return search.run_search(index, _sources(spark, sf), "ble ly", 8, derived_only=True).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT doc_id, {_INDEXED} AS w FROM documents) SELECT count(*) AS total FROM t WHERE doc_id % 4 <> 0 AND list_contains(w, 'ble') AND list_contains(w, 'ly')")
def fts_count_only(spark, sf):
    """FTS-19, FLT-21: the number of hits alone."""
    index = search.index(table(spark, sf, "documents"), "doc_id", "text")
    return search.run_search(index, _sources(spark, sf), "ble ly", count_only=True)


@query(f"SELECT doc_id FROM documents WHERE NOT contains({_PATHED}, 'node_modules') AND doc_id % 2 = 0 ORDER BY md5(doc_id || '|s2') LIMIT 15")
def fts_sample_options(spark, sf):
    """FTS-15: a draw without vendored paths and derived text; sampling is the feature."""
    rows = _sources(spark, sf).withColumnRenamed("doc", "doc_id")
    return search.sample(search.drawable(rows, "path", derived=False, prose=True), "doc_id", "s2", 15).select("doc_id")


@query("SELECT * EXCLUDE n FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def win_top_per(spark, sf):
    """WIN-07: the three best rows of every key, ties in order; the limit is the feature."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return search.top_per(rows, "l_suppkey", 3, "l_extendedprice", "line").drop("place", "line")


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN '[match quality: none: no hit holds any of the 5 content words of the question]' ELSE '[match quality: ' || CASE WHEN n >= 3 THEN 'strong' WHEN n = 2 THEN 'partial' ELSE 'weak' END || ': the best hit covers ' || n || ' of 5 content words of the question]' END AS note
FROM (SELECT doc_id, """ + " + ".join(rf"CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){t}') THEN 1 ELSE 0 END" for t in ("one", "ther", "ionic", "bles", "are")) + " AS n FROM documents)")
def fts_match_notes(spark, sf):
    """FTS-12: what is said of how well a hit matches."""
    terms = F.array(*map(F.lit, ("one", "ther", "ionic", "bles", "are")))
    return table(spark, sf, "documents").select("doc_id", text.match_note(text.term_coverage(F.col("text"), terms), F.lit(5)).alias("note"))


@query(f"SELECT doc_id, score >= {fixed.PROSE_FLOOR} AS prose FROM ({SQL['str_prose_score']})")
def flt_prose_floor(spark, sf):
    """FLT-09."""
    return table(spark, sf, "documents").select("doc_id", text.looks_like_prose(F.col("text")).alias("prose"))


# --- Texts


@query(r"SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS slug FROM pages")
def str_ingest_slug(spark, sf):
    """STR-07."""
    return table(spark, sf, "pages").select("page_id", text.ingest_slug(F.col("url")).alias("slug"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^\p{L}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def str_question_slug(spark, sf):
    """STR-08."""
    return table(spark, sf, "pages").select("page_id", text.question_slug(F.col("url")).alias("slug"))


@query(r"SELECT doc_id, substr(coalesce(list_filter(list_transform(string_split('# head' || chr(10) || '  ' || chr(10) || text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], ''), 1, 200) AS summary FROM documents")
def str_quarantine_summary(spark, sf):
    """STR-09: the first line that is no comment."""
    return table(spark, sf, "documents").select("doc_id", text.quarantine_summary(F.concat(F.lit("# head\n  \n"), "text")).alias("summary"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'KeyError' WHEN 1 THEN 'DeprecationWarning' ELSE 'killed by ' || lang END AS kind FROM documents")
def str_error_kind(spark, sf):
    """STR-16: the last word of an error, else the last line."""
    n = F.col("doc_id")
    said = F.when(n % 3 == 0, F.lit("ValueError: x\nKeyError: y\n")).when(n % 3 == 1, F.lit("a.py:1: DeprecationWarning: old")).otherwise(F.concat(F.lit("first\n killed by "), "lang", F.lit("\n\n")))
    return table(spark, sf, "documents").select("doc_id", text.error_kind(said).alias("kind"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'What is ' || doc_id || '?' WHEN 1 THEN 'Who won?' ELSE '' END AS question FROM documents")
def str_clean_question(spark, sf):
    """STR-17: the first question of a reply, bare of decoration; commentary is none."""
    n = F.col("doc_id")
    said = F.when(n % 4 == 0, F.concat(F.lit("Sure.\n**Question:** What  is "), n.cast("string"), F.lit("?**\nmore?"))).when(n % 4 == 1, F.lit("> 1. Q: Who won?")).when(n % 4 == 2, F.lit("I cannot ask. Why?")).otherwise("no question")
    return table(spark, sf, "documents").select("doc_id", replies.clean_question(said).alias("question"))


_CONTENT = r"""list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[.,;:!?()\[\]{}<>"''`*#]+|[.,;:!?()\[\]{}<>"''`*#]+$', '', 'g')),
lambda x: length(x) >= 4 AND regexp_matches(x, '[\p{L}\p{N}]') AND x NOT IN (""" + ", ".join(f"'{w}'" for w in fixed.SUMMARY_STOPWORDS) + ")))"


@query(f"WITH w AS (SELECT item_id, {_CONTENT} AS words, lower(substr(text, 1, 80)) AS own FROM benchmark) SELECT item_id, round(CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(own, x)))::DOUBLE / len(words) ELSE 0 END, 6) AS share FROM w")
def str_groundedness(spark, sf):
    """STR-19: the share of a passage's words that its beginning holds."""
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", F.round(text.groundedness(t, F.substring(t, 1, 80)), 6).alias("share"))


@query("SELECT event_id, value >= 0.9 * 80 AS hit FROM events")
def str_cap_hit(spark, sf):
    """STR-20: replies near the most tokens."""
    return table(spark, sf, "events").select("event_id", text.cap_hit(F.col("value"), F.lit(80)).alias("hit"))


@query("SELECT doc_id, 'def f(x):' || chr(10) AS signature, CASE WHEN doc_id % 2 = 0 THEN 'return ' || doc_id || chr(10) END AS code FROM documents")
def str_sections(spark, sf):
    """STR-22: code below headings."""
    n = F.col("doc_id")
    body = F.concat(F.lit("## Signature\n\n```python\ndef f(x):\n```\n"), F.when(n % 2 == 0, F.concat(F.lit("## implementation\n```\nreturn "), n.cast("string"), F.lit("\n```\n"))).otherwise(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", text.section(body, "Signature").alias("signature"), text.section(body, "Implementation").alias("code"))


@query("SELECT doc_id, 'a lang_' || lang || ' a' AS slots FROM documents")
def str_slots(spark, sf):
    """STR-24: names in braces, in order."""
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", text.slots(F.concat(F.lit("x {a} { no } {lang_"), "lang", F.lit("} {1} {a}")))).alias("slots"))


@query("SELECT doc_id, source || '; ' || lang AS items, 'ok' || chr(10) || chr(10) || 'Citations: ' || source || '; ' || lang AS answer FROM documents")
def str_citations(spark, sf):
    """STR-25: a list of citations split, and merged with its answer."""
    items = text.citations(F.concat(F.lit(" "), "source", F.lit(";, "), "lang", F.lit(", "), "source"))
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("; ", items).alias("items"), text.with_citations(F.lit("ok \n"), items).alias("answer"))


@query("SELECT doc_id, 'é' || CASE WHEN doc_id % 3 = 2 THEN chr(65533) ELSE '' END AS text FROM documents")
def str_decode(spark, sf):
    """STR-27: bytes in their declared encoding; errors replaced, unknown encodings read as UTF-8."""
    n = F.col("doc_id")
    data = F.when(n % 3 == 0, F.lit(b"\xe9")).when(n % 3 == 1, F.lit(b"\xc3\xa9")).otherwise(F.lit(b"\xc3\xa9\xff"))
    return table(spark, sf, "documents").select("doc_id", binary.decode(data, _pick(("latin-1", "utf-8", "no-such"), n)).alias("text"))


@query("SELECT p_partkey, list_extract(['text/plain', 'text/html', 'application/pdf', 'image/png', NULL], (p_partkey % 5)::INT + 1) AS type FROM part")
def str_media_type(spark, sf):
    """STR-30."""
    name = F.concat(F.lit("a/b"), _pick((".TXT", ".htm", ".pdf", ".png", ".odd"), F.col("p_partkey")))
    return table(spark, sf, "part").select("p_partkey", files.media_type(name).alias("type"))


@query("SELECT doc_id, lang || ' B a' AS tags FROM documents")
def str_merge_tags(spark, sf):
    """SET-09: explicit tags in order, then new ones in lower case."""
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", text.merge_tags(F.array("lang", F.lit("B"), "lang"), F.array(F.lit("A"), F.upper("lang")))).alias("tags"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts)::DOUBLE / 1e6 WHEN 1 THEN event_id + 0.5::DOUBLE END AS at FROM events")
def dt_instant(spark, sf):
    """DT-01: ISO times and numbers as seconds; all else is unknown."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    said = F.when(n % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(n % 3 == 1, F.concat(n.cast("string"), F.lit(".5"))).otherwise("soon")
    return table(spark, sf, "events").select("event_id", text.instant(said).alias("at"))


@query("SELECT doc_id, list_extract([doc_id::DOUBLE, doc_id::DOUBLE, doc_id * 60.0::DOUBLE, doc_id * 3600.0::DOUBLE, 0.0::DOUBLE, NULL], (doc_id % 6)::INT + 1) AS seconds FROM documents")
def dt_duration(spark, sf):
    """DT-02."""
    n = F.col("doc_id")
    said = F.coalesce(*[F.when(n % 6 == i, F.concat(F.lit(a), n.cast("string"), F.lit(b))) for i, (a, b) in enumerate((("", ""), ("", "s"), ("", "m"), ("", " h"), ("-", "m"), ("", "x")))])
    return table(spark, sf, "documents").select("doc_id", text.duration(said).alias("seconds"))


@query("SELECT event_id, epoch_us(CASE WHEN date_trunc('day', ts) + INTERVAL 13 HOUR + INTERVAL 30 MINUTE > ts THEN date_trunc('day', ts) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END + INTERVAL 13 HOUR + INTERVAL 30 MINUTE) AS at FROM events")
def dt_next_at(spark, sf):
    """DT-03: the next time clocks show 13:30."""
    return table(spark, sf, "events").select("event_id", F.unix_micros(text.next_at(F.col("ts").cast("timestamp"), "13:30")).alias("at"))


@query("SELECT doc_id, CASE WHEN t < 60 THEN t || 's ago' WHEN t < 3600 THEN (t // 60) || 'min ago' ELSE printf('%.1f', t / 3600.0::DOUBLE) || 'h ago' END AS said FROM (SELECT doc_id, doc_id * 360 + 1 AS t FROM documents)")
def dt_age(spark, sf):
    """DT-05."""
    return table(spark, sf, "documents").select("doc_id", text.age_said(F.col("doc_id") * 360 + 1).alias("said"))


@query("SELECT doc_id, path, doc_id < 50 AS old FROM (SELECT doc_id, 'memory/notes/' || doc_id AS path FROM documents)")
def dt_older_than(spark, sf):
    """DT-06: notes older than a cutoff are forgotten."""
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("memory/notes/"), F.col("doc_id").cast("string")).alias("path"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit("active").alias("status"), F.timestamp_micros(F.col("doc_id") * 1_000_000).alias("updated"))
    return vault.forget(rows, None, older_than=50.0, now=100.0).select("doc_id", "path", (F.col("status") == "deprecated").alias("old"))


# --- Replies of models


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a": {"b": ' || doc_id || '}}' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '{"a": 1' ELSE 'plain' END AS json FROM documents""")
def jsn_repair(spark, sf):
    """JSN-01: the first balanced object of a reply."""
    n = F.col("doc_id")
    said = F.when(n % 4 == 0, F.concat(F.lit('```json\n{"a": {"b": '), n.cast("string"), F.lit("}}\n```"))).when(n % 4 == 1, F.lit('Here: {"a": 1} and {"b": 2}')).when(n % 4 == 2, F.lit('so {"a": 1')).otherwise("'plain'")
    return table(spark, sf, "documents").select("doc_id", replies.repair_json(said).alias("json"))


_CARD_ROOM = 3 * 1023 + 2
_ASKED = sum(len("Question being answered: Why?\n") + len(s) for s in replies.INSTRUCTIONS.values()) + sum(map(len, replies.ACTIONS.values()))


@query(f"SELECT doc_id, length(text) + {_ASKED} <= {_CARD_ROOM} AS sent FROM documents")
def jsn_request_budget(spark, sf):
    """JSN-04: requests that pass the model's tokens, three characters each, are not sent."""
    return table(spark, sf, "documents").select("doc_id", replies.decision_request(F.lit("Why?"), F.col("text")).isNotNull().alias("sent"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'drop' END AS action, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 3)::INT END AS importance, list_extract([NULL, 'unknown action', 'no score for importance', 'no answers'], (doc_id % 4)::INT + 1) AS fault FROM documents")
def jsn_decision(spark, sf):
    """JSN-03: decisions, and what is missing of one."""
    n = F.col("doc_id")
    one = lambda a, s: F.concat(F.lit(f'{{"answers":{{"action":{{"type":"choice","choice":"{a}"}},"relevant":{{"type":"noul","noul":true}}'), s, F.lit("}}"))
    score = F.concat(F.lit(',"importance":{"type":"score","score":'), (n % 3).cast("string"), F.lit("}"))
    said = F.when(n % 4 == 0, one("drop", score)).when(n % 4 == 1, one("burn", score)).when(n % 4 == 2, one("drop", F.lit(""))).otherwise("{}")
    d = replies.decision(said)
    return table(spark, sf, "documents").select("doc_id", d["action"].alias("action"), d["importance"].alias("importance"), d["fault"].alias("fault"))


@query("SELECT doc_id, list_extract(['noul', 'score', 'choice'], (doc_id % 3)::INT + 1) AS type, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS noul, CASE WHEN doc_id % 3 = 1 THEN (doc_id % 4)::INT END AS score, CASE WHEN doc_id % 3 = 2 THEN lang END AS choice FROM documents")
def jsn_labels(spark, sf):
    """JSN-05: a classifier's labels as typed answers."""
    n = F.col("doc_id")
    label = F.when(n % 3 == 0, F.when(n % 2 == 0, "yes").otherwise("no")).when(n % 3 == 1, (n % 4).cast("string")).otherwise(F.col("lang"))
    a = replies.labelled_answer(label)
    return table(spark, sf, "documents").select("doc_id", *[a[c].alias(c) for c in ("type", "noul", "score", "choice")])


@query("SELECT item_id, name, labels FROM benchmark, (VALUES ('action', 'drop,expand,one_line,summarise'), ('importance', '0,1,2,3'), ('relevant', 'no,yes')) AS h(name, labels)")
def jsn_heads(spark, sf):
    """JSN-05: a decision request as a label classifier's heads."""
    heads = replies.classifier_heads(replies.decision_request(F.lit("Why?"), F.lit("card")))
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(heads).alias("name", "head"))
    return rows.select("item_id", "name", F.array_join(F.array_sort(F.map_keys("head.labels")), ",").alias("labels"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'why' END AS content, list_extract([NULL, NULL, 'response message has no ''content''', 'response has no ''choices'' array', 'response was not a JSON object'], (doc_id % 5)::INT + 1) AS fault FROM documents""")
def jsn_content(spark, sf):
    """JSN-07: a completion's text, or why there is none."""
    n = F.col("doc_id")
    body = (
        F.when(n % 5 == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), "lang", F.lit('"}}]}'))).when(n % 5 == 1, F.lit('{"choices":[{"message":{"content":null,"reasoning_content":"why"}}]}'))
        .when(n % 5 == 2, F.lit('{"choices":[{"finish_reason":"length","message":{"content":null}}]}')).when(n % 5 == 3, F.lit('{"choices":[]}')).otherwise("<html>")
    )
    c = replies.reply_content(body)
    return table(spark, sf, "documents").select("doc_id", c["content"].alias("content"), c["fault"].alias("fault"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 100 END AS prompt_tokens, CASE WHEN event_id % 4 = 0 THEN 500.0::DOUBLE END AS prompt_ms, CASE WHEN event_id % 4 = 0 THEN round(value - 0.75::DOUBLE, 3) END AS residual FROM events")
def jsn_timings(spark, sf):
    """JSN-06: what a server tells of a call; what it does not tell is unknown, not 0."""
    n = F.col("event_id")
    usage = F.concat(F.lit('{"usage":{"prompt_tokens":'), (n % 100).cast("string"), F.lit("}"))
    body = F.when(n % 4 == 0, F.concat(usage, F.lit(',"timings":{"prompt_ms":500,"predicted_ms":250}}'))).when(n % 2 == 0, F.concat(usage, F.lit("}"))).otherwise("{}")
    block = replies.server_block(body)
    return table(spark, sf, "events").select("event_id", block["prompt_tokens"].alias("prompt_tokens"), block["prompt_ms"].alias("prompt_ms"), replies.residual_seconds(F.col("value"), block).alias("residual"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 1000 THEN 'oversize' END, CASE WHEN length(text) / 4000.0::DOUBLE > 0.5 THEN 'shortcut' END) AS warned FROM documents")
def map_warnings(spark, sf):
    """MAP-02: calls that are too large, or hold most of the context."""
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(",", context.call_warnings(F.length("text"), 1000, F.lit(4000), 0.5)).alias("warned"))


@query("SELECT doc_id, md5('Say ' || text) AS answer FROM documents")
def map_query(spark, sf):
    """MAP-01, MAP-02, STM-10: a model asked once for each prompt, joined back to every row."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return context.map_query(rows, "Say {text}", lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts]).select("doc_id", "answer")


# --- Aliases

_BODY = "list_extract(string_split('ABCDEFGHIJKMNOPQRSTUVWXYZ', ''), (p_partkey % 25)::INT + 1) || list_extract(string_split('ABCDEFGHIJKMNOPQRSTUVWXYZ', ''), (p_partkey // 25 % 25)::INT + 1) || 'K' || list_extract(string_split('234679', ''), (p_partkey % 6)::INT + 1)"
_CHECKED = f"substr('{edit.CHECK}', (({' + '.join(f'''(instr('{edit.CHECK_DIGEST}', substr(body, {i + 1}, 1)) - 1) * {4**i} % {len(edit.CHECK_DIGEST)}''' for i in range(4))}) % {len(edit.CHECK)} + 1)::INT, 1)"


def _bodies(spark, sf) -> DataFrame:
    n, letters = F.col("p_partkey"), tuple(edit.LETTERS)
    return table(spark, sf, "part").select("p_partkey", F.concat(_pick(letters, n), _pick(letters, F.floor(n / 25)), F.lit("K"), _pick(tuple(edit.DIGITS), n)).alias("body"))


@query(f"WITH b AS (SELECT p_partkey, {_BODY} AS body FROM part) SELECT p_partkey, body, {_CHECKED} AS symbol FROM b")
def ali_check_symbol(spark, sf):
    """HSH-08: the check symbol of a body."""
    return _bodies(spark, sf).select("p_partkey", "body", edit.check_symbol(F.col("body")).alias("symbol"))


@query(f"WITH b AS (SELECT p_partkey, {_BODY} AS body FROM part), a AS (SELECT *, body || '-' || {_CHECKED} AS alias FROM b) SELECT p_partkey, alias AS normal, true AS shaped, true AS checked FROM a")
def ali_normal(spark, sf):
    """ALI-02: spellings in lower case and without their hyphen, their shape and check."""
    b = _bodies(spark, sf).withColumn("alias", F.concat("body", F.lit("-"), edit.check_symbol(F.col("body"))))
    said = F.concat(F.lit(" "), F.lower(F.replace("alias", F.lit("-"), F.lit(""))))
    normal = edit.normalise_alias(said)
    return b.select("p_partkey", normal.alias("normal"), edit.looks_like_alias(said).alias("shaped"), edit.checks(normal).alias("checked"))


def _live(spark, sf) -> DataFrame:
    b = _bodies(spark, sf).groupBy("body").agg(F.min("p_partkey").alias("p_partkey"))
    return b.select(F.concat("body", F.lit("-"), edit.check_symbol(F.col("body"))).alias("alias"), F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("#L0-9")).alias("address"), "p_partkey")


_LIVE = f"a AS (SELECT p_partkey, body || '-' || {_CHECKED} AS alias FROM (SELECT min(p_partkey) AS p_partkey, {_BODY} AS body FROM part GROUP BY 2))"


@query(f"WITH {_LIVE} SELECT lower(alias) AS written, 'normalised' AS status, alias, 'd' || p_partkey || '#L0-9' AS address FROM a UNION ALL SELECT alias, 'exact', alias, 'd' || p_partkey || '#L0-9' FROM a")
def ali_ladder(spark, sf):
    """ALI-03, ALI-05, JN-12: exact and normalised spellings of live aliases."""
    live = _live(spark, sf)
    asked = live.select(F.col("alias").alias("written")).union(live.select(F.lower("alias").alias("written")))
    return aliases.resolve(asked, live).select("written", "status", "alias", "address")


@query(f"WITH {_LIVE} SELECT p_partkey, 'see d' || p_partkey || '#L0-9 and ZZQX7-2.' AS text FROM a")
def ali_substitute(spark, sf):
    """ALI-04: aliases in texts replaced by what they mean; unknown ones stay."""
    live = _live(spark, sf)
    return aliases.substitute(live.withColumn("said", F.concat(F.lit("see "), "alias", F.lit(" and ZZQX7-2."))), live, "p_partkey", "said").select("p_partkey", "text")


@query(f"""WITH {_LIVE}, w AS (SELECT 'no such ' || n_nationkey AS written, 'NOSUCH' || n_nationkey AS normal FROM nation), d AS (SELECT written, alias, row_number() OVER (PARTITION BY written ORDER BY levenshtein(normal, alias), alias) AS place FROM w, a)
SELECT written, 'unknown' AS status, string_agg(alias, ' ' ORDER BY place) AS nearest FROM d WHERE place <= 3 GROUP BY 1""")
def ali_nearest(spark, sf):
    """TOP-07, ALI-03: the three nearest aliases of what means nothing."""
    asked = table(spark, sf, "nation").select(F.concat(F.lit("no such "), F.col("n_nationkey").cast("string")).alias("written"))
    return aliases.resolve(asked, _live(spark, sf)).select("written", "status", F.concat_ws(" ", "candidates").alias("nearest"))


# --- Streams' batch forms


@query("SELECT max_by(user_id, event_id)::VARCHAR AS worker, 100.0::DOUBLE AS age, true AS held FROM events")
def stm_lock_holder(spark, sf):
    """STM-05: whose lock holds, by its last sign of life."""
    last = table(spark, sf, "events").agg(F.max("event_id").alias("last"))
    beats = table(spark, sf, "events").crossJoin(last).select(F.col("user_id").cast("string").alias("worker"), (F.col("event_id") - F.col("last")).cast("double").alias("beat"))
    return jobs.lock_holder(beats, 100.0)


@query("SELECT DISTINCT lang || md5(text) AS k FROM documents")
def stm_once(spark, sf):
    """STM-10: each call once."""
    return jobs.once(table(spark, sf, "documents").select(F.concat("lang", F.md5("text")).alias("k")), "k")


# --- Files: written to the shared folder and read back


_LINE = "CASE WHEN event_id % 97 = 5 THEN 'torn' WHEN event_type = 'error' THEN 'unknown' ELSE CASE event_type WHEN 'view' THEN 'corpus_served' WHEN 'click' THEN 'guardrail' WHEN 'purchase' THEN 'end' ELSE 'turn_start' END END"


@query(f"SELECT {_LINE} AS kind, count(*) AS n FROM events GROUP BY 1")
def src_trajectories(spark, sf):
    """SRC-10, SRC-11, JSN-02: logs of events, their torn lines and unknown events counted."""
    kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in (("view", "corpus_served"), ("click", "guardrail"), ("purchase", "end"), ("signup", "turn_start"), ("error", "odd"))])
    line = F.to_json(F.struct(kind.alias("event"), F.col("event_id").alias("turn")))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 97 == 5, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    path = folder(spark, "logs")
    lines.write.text(path)
    events, logs = files.trajectories(spark, path, pattern="*.txt")
    bad = logs.agg(F.sum("torn").alias("torn"), F.sum("unknown").alias("unknown")).select(F.explode(F.create_map(F.lit("torn"), "torn", F.lit("unknown"), "unknown")).alias("kind", "n"))
    return events.groupBy(F.col("event").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(bad)


@query("SELECT CASE WHEN event_id % 97 = 5 THEN 'unknown' ELSE event_type END AS model, event_id % 97 = 5 AS torn, count(*) AS n, round(sum(CASE WHEN event_id % 97 <> 5 THEN value END), 4) AS seconds FROM events GROUP BY 1, 2")
def src_metrics(spark, sf):
    """SRC-12: a log of metrics; a torn line is a record of an unknown model."""
    line = F.to_json(F.struct(F.col("event_type").alias("model"), F.col("value").alias("seconds")))
    path = folder(spark, "metrics")
    table(spark, sf, "events").select(F.when(F.col("event_id") % 97 == 5, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return files.metrics(spark, path, pattern="*.txt").groupBy("model", "torn").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"))


@query("SELECT event_id, user_id FROM events")
def snk_append_lines(spark, sf):
    """SNK-01, STM-01: rows appended as JSON lines in two runs, and read back."""
    path, e = folder(spark, "appended"), table(spark, sf, "events").select("event_id", "user_id")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        files.append_lines(part, path)
    return spark.read.schema(e.schema).json(path)


@query(r"SELECT n_nationkey + 1 AS place, regexp_replace(lower(n_name), '[^a-z0-9_-]', '-', 'g') AS id, 'Where is ' || n_name || '?' AS question FROM nation")
def src_questions(spark, sf):
    """SRC-14, SNK-07, WIN-02: a set of questions written and read back, numbered in file order."""
    path = folder(spark, "questions")
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("id"), F.format_string("Where is %s?", "n_name").alias("question"))
    files.write_questions(rows, path)
    return files.questions(spark, path)


@query("SELECT n_nationkey + 1 AS place, 'q' || n_nationkey AS id FROM nation WHERE contains('q' || n_nationkey, '1') UNION ALL SELECT 4, 'q3'")
def src_select_questions(spark, sf):
    """FLT-13: questions by part of their id, and by their place."""
    rows = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("place"), F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("id"))
    return files.select_questions(rows, "q1").union(rows.where("id LIKE '%1' AND NOT id LIKE 'q1%'")).union(files.select_questions(rows, "4"))


@query(f"WITH {_USED} SELECT source, served, cited FROM u")
def src_plan(spark, sf):
    """SRC-13, SNK-07: a plan written and read back."""
    path = folder(spark, "plan")
    files.write_plan(_used(spark, sf), path)
    return files.read_plan(spark, path)[0]


@query("SELECT DISTINCT 'lang=' || lang AS name, 'dir' AS kind, 'lang=' || lang AS path FROM documents")
def src_tree(spark, sf):
    """SRC-01 to SRC-04: the folders of a tree of files."""
    tree.register(spark)
    path = folder(spark, "tree")
    table(spark, sf, "documents").select("lang", "doc_id").write.partitionBy("lang").parquet(path)
    return spark.read.format("filetree").load(path).where("kind = 'dir'").select("name", "kind", "path")


@query(f"WITH {_TREE} SELECT count(*) AS entries, count(*) FILTER (doc_id % 50 = 0) AS paths_not_utf8, 7.0::DOUBLE AS built_at FROM e")
def src_build(spark, sf):
    """SRC-08: a path index written by kind, and its marker row."""
    path, t = folder(spark, "index"), _tree(spark, sf)
    bad = (F.col("mtime") % 50 == 0) & (F.col("kind") != "dir")
    paths.build(t.withColumn("path", text.display(F.concat("raw", F.when(bad, F.lit(b"\xe9")).otherwise(F.lit(b""))))), path, 7.0)
    return spark.read.parquet(f"{path}/complete")


@F.pandas_udf(BinaryType())
def _zipped(name: pd.Series, text_: pd.Series) -> pd.Series:
    def one(n: str, t: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:t>{n}</w:t>\n<w:t> is\there</w:t>")
            z.writestr("sub/", "")
            z.writestr(n, t or "")
        return out.getvalue()

    return pd.Series([one(n, t) for n, t in zip(name, text_, strict=True)])


def _archives(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    content = F.when(F.col("doc_id") % 10 == 9, F.lit(b"PK\x03\x04 no archive")).otherwise(_zipped(name, F.col("text")))
    return d.select(name.cast("binary").alias("raw"), F.concat(name, F.lit(".zip")).alias("name"), content.alias("content"))


@query("""WITH d AS (SELECT doc_id, 'f' || doc_id AS f, strlen(text) AS n FROM documents WHERE doc_id % 10 <> 9) SELECT f AS container, f AS member, n::BIGINT AS size, 'file' AS kind FROM d UNION ALL SELECT f, 'sub/', 0, 'dir' FROM d
UNION ALL SELECT f, 'word/document.xml', length('<w:t>' || f || '</w:t>' || '<w:t> is here</w:t>') + 1, 'file' FROM d""")
def src_archives(spark, sf):
    """SRC-17, SRC-19: members of archives, found by their bytes; what is none has no members."""
    return files.list_archives(_archives(spark, sf)).select(F.col("container").cast("string").alias("container"), "member", "size", "kind")


@query("SELECT 'f' || doc_id AS raw, CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'f' || doc_id || ' is here' END AS text, CASE WHEN doc_id % 10 = 9 THEN 'needs_ocr' END AS note FROM documents")
def src_document_text(spark, sf):
    """SRC-18: the words of office files; those without any need OCR."""
    return files.document_text(_archives(spark, sf)).select(F.col("raw").cast("string").alias("raw"), "text", "note")


@query("SELECT n_name AS id FROM nation WHERE n_nationkey % 3 < 2")
def src_models(spark, sf):
    """SRC-23: the models that a box holds; one without a state is not told to be held."""
    n = F.col("n_nationkey")
    state = F.when(n % 3 == 0, F.lit(',"status":{"value":"loaded"}')).when(n % 3 == 1, F.lit(',"status":"loading"')).otherwise(F.when(n % 2 == 0, F.lit("")).otherwise(F.lit(',"status":{"value":"unloaded"}')))
    return files.model_ids(table(spark, sf, "nation").select(F.concat(F.lit('{"data":[{"id":"'), "n_name", F.lit('"'), state, F.lit("}]}")).alias("value")))


@query("SELECT count(*)::INT AS n, string_agg(n_name, ',' ORDER BY n_name) AS others FROM nation WHERE n_name <> 'CHINA'")
def src_conflict(spark, sf):
    """SRC-23: models that stand in the way of another."""
    out = files.resident_conflict(table(spark, sf, "nation").select(F.col("n_name").alias("id")), "CHINA")
    return out.select("n", F.array_join("others", ",").alias("others"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')[6:25] AS part FROM documents")
def ctx_byte_slice(spark, sf):
    """SRC-06, FLT-17: a bounded range of bytes of every text."""
    d = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return context.byte_slice(d, "doc_id", "text", 5, 25).select("doc_id", F.col("text").alias("part"))


@query(f"""WITH p AS ({SQL['str_prose_score']}), c AS (SELECT doc_id, md5(doc_id || '|s3') AS draw, md5(text) AS h, score FROM documents JOIN p USING (doc_id) ORDER BY draw LIMIT 600), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY draw) AS nth FROM c),
t AS (SELECT draw, score, CASE WHEN nth > 1 THEN 'duplicate' WHEN score < {fixed.PROSE_FLOOR} THEN 'rejected' ELSE 'kept' END AS told FROM n), b AS (SELECT *, coalesce(sum(CASE WHEN told = 'kept' THEN 1 ELSE 0 END) OVER (ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT count(*) AS drawn, count(*) FILTER (told = 'kept') AS kept, count(*) FILTER (told = 'rejected') AS rejected_content, 0 AS unreadable, count(*) FILTER (told = 'duplicate') AS duplicates, round(avg(score) FILTER (told = 'kept'), 4) AS mean_score FROM b WHERE before < 20""")
def fts_sample_report(spark, sf):
    """FTS-16: what a draw of twenty prose passages met; sampling is the feature."""
    rows = table(spark, sf, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return search.sample_report(rows, "doc_id", "text", "path", "s3", 20)


@query(f"""WITH {_LOG}, f AS (SELECT run_id, max(turn) AS turns, count(*) FILTER (event = 'corpus_served') AS s, count(*) FILTER (event = 'guardrail') AS g, bool_or(event = 'end') AS ended FROM l GROUP BY 1)
SELECT run_id, '# Run ' || run_id || chr(10) || chr(10) || '- turns: ' || turns || chr(10) || '- searches: ' || s || chr(10) || '- guardrails: ' || g || chr(10) || '- ended: ' || ended || chr(10) AS page FROM f""")
def trj_pages(spark, sf):
    """SNK-08: a page of every run's facts."""
    return probes.run_page(traces.run_facts(_log(spark, sf)).withColumn("final_answer", F.lit(None).cast("string")))


@query(f"""WITH {_LOG}, f AS (SELECT run_id, max(turn) AS turns, bool_or(event = 'end') AS ended FROM l GROUP BY 1) SELECT '# Runs' || chr(10) || chr(10) || string_agg('- [' || run_id || '](' || run_id || '.md): ' || turns || ' turns, ' || CASE WHEN ended THEN 'ended' ELSE 'not ended' END, chr(10) ORDER BY run_id) || chr(10) AS page FROM f""")
def trj_index_page(spark, sf):
    """SNK-08: the index of all runs' pages."""
    return traces.index_page(traces.run_facts(_log(spark, sf)))
