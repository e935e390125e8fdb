"""The registered queries over the driver's tables, each beside its SQL.

A query and its SQL give the same columns and rows. Roles of the tables:
documents are text files (path: source/doc_id.txt), pages marked-up files
(path: url), labels a partial classification, events a log or queue,
conversations messages of runs, benchmark passages that are cited.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, edit, fixed, text
from ..operators import aliases, context, metrics, mining, paths, search, traces, vault
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("path", _path())


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select(
        F.col("path").cast("binary").alias("raw"), "path", F.col("source").alias("parent"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").cast("double").alias("mtime"),
    )


# Pieces of SQL that several oracles share.
_DOC_PATH = "source || '/' || doc_id || '.txt'"
_TOKENS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"


def _any(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


def _ends(column: str, endings: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{e}'" for e in endings) + ")"


# --- Filters and projections


@query("SELECT p_partkey, p_name FROM part WHERE contains(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'al') ORDER BY length(p_name), p_name, p_partkey LIMIT 20")
def flt_find_name_topk(spark, sf):
    """FLT-02, TOP-04: substring of a name, shortest names first; the limit is the feature."""
    hits = table(spark, sf, "part").where(F.contains(text.ascii_lower(F.col("p_name")), F.lit("al")))
    return hits.orderBy(F.length("p_name"), "p_name", "p_partkey").limit(paths.clamp(20)).select("p_partkey", "p_name")


@query(f"SELECT {_DOC_PATH} AS path, strlen(text) AS size FROM documents WHERE contains({_DOC_PATH}, 'src1/') ORDER BY size DESC, path LIMIT 50")
def flt_find_path_by_size(spark, sf):
    """FLT-02 with a slash: the whole path is searched, largest first."""
    return paths.find(_entries(spark, sf), "src1/", 50, order="size").select("path", "size")


@query(f"SELECT {_DOC_PATH} AS path FROM documents WHERE {_DOC_PATH} >= 'src3/' AND {_DOC_PATH} < 'src3/' || chr(65535)")
def flt_under_subtree(spark, sf):
    """FLT-01."""
    return paths.scope(_entries(spark, sf), "file", "src3").select("path")


@query(f"SELECT {_DOC_PATH} AS path, doc_id::VARCHAR || '.txt' AS name FROM documents WHERE source = 'src5' ORDER BY name LIMIT 50")
def flt_list_children(spark, sf):
    """FLT-22."""
    return paths.children(_entries(spark, sf), "src5", 50).select("path", "name")


_ROOTED = "'/' || ltrim(lower(url), '/')"
_SUFFIX = r"lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1))"


@query(f"""SELECT page_id, {_any(_ROOTED, fixed.VENDORED_MARKERS)} AS vendored,
  CASE WHEN {_any(_ROOTED, fixed.VENDORED_MARKERS)} THEN 'vendored' WHEN {_any(_ROOTED, fixed.DOCUMENTATION_MARKERS)} THEN 'documentation'
    WHEN {_ends(_SUFFIX, fixed.MARKUP_ENDINGS)} THEN 'markup' WHEN {_ends(_SUFFIX, fixed.CODE_ENDINGS)} THEN 'code' WHEN {_ends(_SUFFIX, fixed.DATA_ENDINGS)} THEN 'data'
    WHEN {_ends(_SUFFIX, ("", *fixed.PROSE_ENDINGS))} THEN 'prose' ELSE 'other' END AS provenance FROM pages""")
def flt_vendored_prov_class(spark, sf):
    """FLT-06, FLT-08."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.is_vendored(url).alias("vendored"), text.provenance(url).alias("provenance"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines WHERE regexp_matches(line, '[A-Z]{3,}!'))
SELECT doc_id, line_no::BIGINT AS line_no, line FROM hit WHERE n <= 50""")
def flt_grep_lines(spark, sf):
    """FLT-15: the first fifty matching lines of each text."""
    return context.grep(table(spark, sf, "documents"), "doc_id", "text", "[A-Z]{3,}!", 50).select("doc_id", F.col("line_no").cast("long"), "line")


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no::BIGINT AS line_no, line FROM lines WHERE line_no BETWEEN 2 AND 4""")
def flt_line_range(spark, sf):
    """FLT-16: lines 2 to 4 of every text."""
    return context.line_range(table(spark, sf, "documents"), "doc_id", "text", 2, 3).select("doc_id", F.col("line_no").cast("long"), "line")


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, (n - 1)::BIGINT AS line_no, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(line) - 1)::BIGINT AS byte_start, strlen(line)::BIGINT AS n_bytes FROM lines""")
def ctx_line_offsets(spark, sf):
    """SRC-09, FLT-17: the byte range of every line."""
    rows = context.lines(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("line_no").cast("long"), "byte_start", (F.col("byte_end") - F.col("byte_start")).cast("long").alias("n_bytes"))


# --- Aggregates


@query("SELECT o_orderstatus AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP(o_orderstatus)")
def agg_summary_rollup(spark, sf):
    """AGG-03 with its total as a rollup (an extension)."""
    return table(spark, sf, "orders").rollup(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("kind", "n", "total")


@query("SELECT sum(strlen(text))::BIGINT AS bytes, count(*) AS files FROM documents")
def agg_bytes_total(spark, sf):
    """AGG-02."""
    e = _entries(spark, sf)
    return paths.bytes_total(e).crossJoin(paths.count(e).withColumnRenamed("n", "files"))


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n, sum(strlen(text)) AS total, min(strlen(text)) AS least FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS files, count(*) AS distinct_contents, coalesce(sum(CASE WHEN n > 1 THEN total - least END), 0)::BIGINT AS duplicate_bytes, round(sum(n) / count(*), 6) AS factor FROM g""")
def agg_dup_bytes(spark, sf):
    """AGG-06, AGG-07, AGG-08."""
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size"))
    return paths.copies(rows, "h", "size").withColumn("factor", F.round("factor", 6))


@query("""SELECT count(*) AS scanned, count(*) FILTER (t > 1704500000) AS newer, count(*) FILTER (t > 1704500000 AND t <= 1706000060) AS in_window, count(*) FILTER (t > 1706000060) AS future,
count(*) FILTER (t <= 1704500000) AS stale, min(t) AS least, max(t) AS greatest FROM (SELECT epoch_us(ts)::DOUBLE / 1e6 AS t FROM events)""")
def agg_newer_than(spark, sf):
    """AGG-18."""
    rows = table(spark, sf, "events").select((F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("mtime"))
    return paths.newer_than(rows, 1704500000.0, 1706000000.0)


@query("SELECT least(count(*), 200) AS n, count(*) > 200 AS at_least FROM (SELECT 1 FROM documents WHERE lang = 'en' LIMIT 201)")
def agg_capped_count(spark, sf):
    """AGG-15, FTS-07: the cap is the feature."""
    return paths.capped_count(table(spark, sf, "documents").where("lang = 'en'"), fixed.HIDDEN_CAP).select(F.col("n").cast("long"), "at_least")


@query("SELECT event_type AS task, CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'failed' END AS state, count(*) AS n FROM events GROUP BY 1, 2")
def agg_queue_status(spark, sf):
    """AGG-09."""
    state = F.when(F.col("user_id") % 3 == 0, "pending").when(F.col("user_id") % 3 == 1, "done").otherwise("failed")
    return mining.status(table(spark, sf, "events").select(F.col("event_type").alias("task"), state.alias("state")))


@query("""SELECT event_type AS model, count(*) AS attempted, count(*) FILTER (user_id % 10 <> 0) AS usable, count(*) FILTER (user_id % 10 = 0) AS failed,
round(median(value) FILTER (user_id % 10 <> 0), 1) AS seconds_median, round(min(value) FILTER (user_id % 10 <> 0), 1) AS seconds_min, round(max(value) FILTER (user_id % 10 <> 0), 1) AS seconds_max FROM events GROUP BY 1""")
def agg_metrics_by_model(spark, sf):
    """AGG-21: medians over usable calls."""
    e = table(spark, sf, "events")
    nothing = {c: F.lit(None).cast(t) for c, t in (("output_chars", "long"), ("compression", "double"), ("groundedness", "double"), ("client_residual_seconds", "double"), ("boilerplate", "boolean"), ("cap_hit", "boolean"), ("empty", "boolean"), ("torn", "boolean"), ("input_chars", "long"))}
    server = F.lit(None).cast("struct<prompt_tokens:long,predicted_tokens:long,cached_tokens:long,prompt_ms:double,predicted_ms:double>")
    rows = e.select(F.lit("end").alias("kind"), F.col("event_type").alias("model"), F.col("ts").cast("string").alias("started_at"), F.col("value").alias("seconds"), F.when(F.col("user_id") % 10 == 0, "refused").alias("error"), server.alias("server"), *[c.alias(k) for k, c in nothing.items()])
    return metrics.by_model(rows).select("model", "attempted", "usable", "failed", "seconds_median", "seconds_min", "seconds_max")


_WEIGHT_ROWS = (("click", 10), ("view", 15), ("purchase", 20), ("signup", 5), ("error", 10))


@query("""WITH r AS (SELECT user_id, event_type AS probe, sum(value) AS score, count(*) * 1000.0::DOUBLE AS most FROM events GROUP BY 1, 2), w(probe, weight) AS (VALUES """ + ", ".join(f"('{a}', {b})" for a, b in _WEIGHT_ROWS) + """),
s AS (SELECT user_id, round(100.0::DOUBLE * sum(score / most * weight) / sum(weight), 1) AS score FROM r JOIN w USING (probe) GROUP BY 1)
SELECT user_id, score, CASE WHEN score >= 75 THEN 'SUITABLE' WHEN score >= 50 THEN 'MARGINAL' ELSE 'NOT SUITABLE' END AS verdict FROM s""")
def agg_weighted_score(spark, sf):
    """AGG-23, AGG-25."""
    rows = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("probe")).agg(F.sum("value").alias("score"), (F.count(F.lit(1)) * F.lit(1000.0)).alias("max_score"))
    weights = spark.createDataFrame(list(_WEIGHT_ROWS), "probe string, weight int")
    return metrics.weighted_scores(rows, weights, "user_id")


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def agg_percentile(spark, sf):
    """AGG-27."""
    out = metrics.percentile(table(spark, sf, "events"), "value", [0.5, 0.95, 0.99])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT event_type AS model, round(1000 * median(value) / 3600, 2) AS hours FROM events GROUP BY 1")
def agg_projection(spark, sf):
    """AGG-22."""
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.percentile("value", 0.5).alias("seconds_median"))
    return metrics.projection(m, 1000)


# --- Joins


@query("""WITH a AS (SELECT o_orderkey AS path, md5(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN md5(o_orderpriority) ELSE md5(o_orderstatus || o_orderpriority) END AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def jn_delta_full_outer(spark, sf):
    """JN-09, VLT-07, SET-02: what changed between two versions of a table."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("h"), F.md5("o_orderpriority").alias("g"))
    was = o.where("path % 7 <> 0").select("path", F.col("h").alias("hash"), F.lit("x").alias("id"))
    now = o.where("path % 11 <> 0").select("path", F.when(F.col("path") % 5 == 0, F.col("g")).otherwise(F.col("h")).alias("hash"), F.lit("x").alias("id"))
    return vault.delta(was, now, state=False)


@query("""WITH s AS (SELECT DISTINCT s_nationkey AS run_id, s_name AS address FROM supplier), c AS (SELECT DISTINCT s_nationkey AS run_id, CASE s_suppkey % 4 WHEN 0 THEN s_name || 'x' WHEN 1 THEN left(s_name, length(s_name) - 1) WHEN 2 THEN 'T' || s_name ELSE s_name END AS a FROM supplier),
l AS (SELECT run_id, a AS cited FROM c ANTI JOIN s ON c.run_id = s.run_id AND c.a = s.address) SELECT l.run_id, cited, min(address) AS meant FROM l JOIN s USING (run_id) WHERE abs(length(cited) - length(address)) <= 1 AND damerau_levenshtein(cited, address) = 1 GROUP BY 1, 2 HAVING count(*) = 1""")
def jn_edit_distance(spark, sf):
    """JN-11: cited names one edit from exactly one served name of their run."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_name").alias("address"), "s_suppkey")
    name, n = F.col("address"), F.col("s_suppkey") % 4
    bent = F.when(n == 0, F.concat(name, F.lit("x"))).when(n == 1, F.expr("left(address, length(address) - 1)")).when(n == 2, F.concat(F.lit("T"), name)).otherwise(name)
    return traces.corruption(s.select("run_id", "address").distinct(), s.select("run_id", bent.alias("address")).distinct())


# --- Windows, top-k, sets


@query("""WITH m AS (SELECT conv_id, turn, length(text) > 150 AS long FROM conversations), i AS (SELECT *, sum(CASE WHEN long THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, count(*) AS length, min(turn) AS first FROM i WHERE long GROUP BY conv_id, island""")
def win_error_islands(spark, sf):
    """WIN-05: runs of consecutive flagged turns."""
    return traces.islands(table(spark, sf, "conversations").withColumn("long", F.length("text") > 150), "conv_id", "turn", "long").drop("island")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n > 50")
def win_retention_keep_n(spark, sf):
    """WIN-09, SNK-02: what retention drops."""
    return traces.retention(table(spark, sf, "events"), 50, "user_id", "ts", "event_id").select("event_id", "user_id")


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (length(text) > 600) AS first FROM conversations GROUP BY 1)
SELECT c.conv_id, f.first IS NOT NULL AS failed, coalesce(bool_or(NOT (length(text) > 600) AND turn > f.first), false) AS recovered FROM conversations c JOIN f USING (conv_id) GROUP BY c.conv_id, f.first""")
def win_recovered(spark, sf):
    """WIN-06: a clean turn after the first failed one."""
    return traces.recovered(table(spark, sf, "conversations").withColumn("failed", F.length("text") > 600), "conv_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 25")
def top_claim(spark, sf):
    """TOP-05: the next pending items; the limit is the feature."""
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("raw"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("state"), F.lit("t").alias("task"))
    return mining.claim(q, ["t"], 25).select(F.col("raw").alias("o_orderkey"), F.col("priority").alias("o_orderpriority"))


# --- Full text


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def fts_docfreq(spark, sf):
    """FTS-03: document and corpus frequency of every term."""
    postings, _ = search.index(table(spark, sf, "documents"), "doc_id", "text")
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(terms: list[str], every: bool, keep: str = "true", k: int = 10) -> str:
    d = "::DOUBLE"
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')){d} AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END){d} AS d{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"greatest(ln((n - d{i} + 0.5{d}) / (d{i} + 0.5{d})), {fixed.IDF_FLOOR}{d}) * f{i} * {fixed.BM25_K1 + 1}{d} / (f{i} + {fixed.BM25_K1}{d} * ({1 - fixed.BM25_B}{d} + {fixed.BM25_B}{d} * len / average))" for i in range(len(terms))
    )
    met = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH t AS (SELECT *, {_TOKENS} AS tokens FROM documents), f AS (SELECT *, len(tokens){d} AS len, {tf} FROM t), w AS (SELECT count(*){d} AS n, avg(len) AS average, {df} FROM f)
SELECT doc_id AS doc, round({parts}, 6) AS score FROM f, w WHERE ({met}) AND {keep} ORDER BY ({parts}) DESC, doc_id LIMIT {k}"""


folder = paths.folder


def _search(spark, sf, phrases, every, keep=None, k=10):
    found = search.top(search.scan(table(spark, sf, "documents"), "doc_id", "text", phrases, every, keep), k)
    return found.select("doc", F.round("score", 6).alias("score"))


@query(_bm25_sql(["ble", "ly"], True))
def fts_bm25_and_topk(spark, sf):
    """FTS-04, FTS-06, TOP-01, JN-04: the ten best documents with all words."""
    return _search(spark, sf, search.and_phrases("ble ly"), True)


@query(_bm25_sql(["the", "of"], True))
def fts_bm25_common_topk(spark, sf):
    """FTS-06 where the inverse frequencies are at their floor."""
    return _search(spark, sf, search.and_phrases("the of"), True)


@query(_bm25_sql(["ble", "ly", "ing"], False))
def fts_bm25_or_topk(spark, sf):
    """FTS-05, TOP-02: the ten best documents with any word."""
    return _search(spark, sf, search.or_phrases("ble ly ing"), False)


@query(_bm25_sql(["ble", "ly"], False, "lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def fts_bm25_or_filtered(spark, sf):
    """FTS-05, FTS-20, FLT-10: filters restrict hits, not statistics."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    keep = table(spark, sf, "documents").where("lang = 'en'").select("doc_id").join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"))
    return _search(spark, sf, search.or_phrases("ble ly"), False, keep)


@query(rf"""WITH t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents), p AS (SELECT doc_id, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the')) AS tf FROM t) SELECT doc_id AS doc, tf::BIGINT AS tf FROM p WHERE tf > 0""")
def fts_phrase_frequency(spark, sf):
    """FTS-04: a word with an underscore is a phrase; its frequency in every document."""
    return search.frequencies(search.index(table(spark, sf, "documents"), "doc_id", "text")[0], search.and_phrases("of_the")).select("doc", F.get("tf", F.lit(0)).alias("tf")).where("tf > 0")


@query("""WITH c AS (SELECT doc_id, """ + " + ".join(rf"CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){t}') THEN 1 ELSE 0 END" for t in ("one", "ther", "ionic", "bles", "are")) + """ AS covered FROM documents)
SELECT doc_id, covered, CASE WHEN covered <= 0 THEN 'none' WHEN covered >= 5 OR covered >= greatest(2.0, 0.6 * 5) THEN 'strong' WHEN covered >= 2 THEN 'partial' ELSE 'weak' END AS band FROM c""")
def fts_match_bands(spark, sf):
    """FTS-09 to FTS-11: how well every document covers a question's terms."""
    terms = F.array(*map(F.lit, ("one", "ther", "ionic", "bles", "are")))
    out = table(spark, sf, "documents").select("doc_id", text.term_coverage(F.col("text"), terms).alias("covered"))
    return out.select("doc_id", "covered", text.match_quality(F.col("covered"), F.lit(5)).alias("band"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '|seed-1') LIMIT 20")
def fts_sample(spark, sf):
    """FTS-15: a reproducible uniform draw of twenty; sampling is the feature."""
    return search.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", "seed-1", 20).select("doc_id")


@query(f"""WITH d AS (SELECT {_DOC_PATH} AS address, strlen(text) % 97 / 97.0::DOUBLE AS score FROM documents), f AS (SELECT * FROM d ORDER BY score DESC, address LIMIT 10),
x AS (SELECT * FROM d WHERE address NOT IN (SELECT address FROM f) ORDER BY score DESC, address LIMIT 3) SELECT address, round(score, 6) AS score, false AS derived FROM f UNION ALL SELECT address, round(score, 6), true FROM x""")
def fts_derived_pass(spark, sf):
    """FTS-08, SET-06, JN-15: file hits, then the best derived ones they lack."""
    d = _docs(spark, sf).select(F.col("path").alias("address"), (F.octet_length("text") % 97 / F.lit(97.0)).alias("score"))
    return search.with_derived(d.orderBy(F.desc("score"), "address").limit(10), d).withColumn("score", F.round("score", 6))


_T, _M = fixed.CHUNK_BYTES, fixed.CHUNK_MAX_BYTES
#: chunked (doc_id, byte_start, byte_end): lines in turn, each with the bytes left open before it (b0), whole cuts of the most bytes (k), and what is left open or closed then (b1)
_CHUNKED = f"""lines AS (SELECT doc_id, i, (strlen(lines[i]) + CASE WHEN i < len(lines) THEN 1 ELSE 0 END)::BIGINT AS bytes FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''), unnest(range(1, len(lines) + 1)) u(i)
), stops AS (SELECT doc_id, i, sum(bytes) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop, sum(bytes) OVER (PARTITION BY doc_id)::BIGINT AS size FROM lines WHERE bytes > 0
), walk AS (
  SELECT doc_id, i, 0::BIGINT AS b0, greatest(0, ceil((stop - {_M}) / {_M}.0))::BIGINT AS k, stop, size FROM stops WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, w.b, greatest(0, ceil((s.stop - {_M} - w.b) / {_M}.0))::BIGINT, s.stop, s.size
  FROM (SELECT doc_id, i, CASE WHEN stop - b0 - {_M} * k >= {_T} OR stop = size THEN stop ELSE b0 + {_M} * k END AS b FROM walk) w JOIN stops s ON s.doc_id = w.doc_id AND s.i = w.i + 1
), ranges AS (
  SELECT doc_id, b0 + {_M} * j AS byte_start, b0 + {_M} * (j + 1) AS byte_end FROM walk, unnest(range(k)) u(j)
  UNION ALL SELECT doc_id, b0 + {_M} * k, stop FROM walk WHERE stop - b0 - {_M} * k >= {_T} OR stop = size
), chunked AS (
  SELECT r.doc_id, byte_start, byte_end FROM ranges r JOIN documents d USING (doc_id) WHERE byte_start < byte_end AND NOT regexp_full_match(substr(hex(encode(text)), 2 * byte_start + 1, 2 * (byte_end - byte_start)), '((20|09|0A|0B|0C|0D))*')
)"""


@query(f"WITH RECURSIVE {_CHUNKED} SELECT * FROM chunked")
def fts_chunks(spark, sf):
    """FTS-01: byte ranges of all chunks."""
    return search.chunks(table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data")


def _hrefs(spark, sf):
    """Distinct link targets of every page."""
    return table(spark, sf, "pages").select(F.col("page_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("dst"))


@query("""WITH a AS (SELECT page_id AS src, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS dst FROM pages) SELECT src FROM a WHERE dst = '/The' ORDER BY src""")
def fts_backlinks(spark, sf):
    """JN-20."""
    return vault.backlinks(_hrefs(spark, sf), "/The")


# --- Scalars over whole tables


def _share(pattern: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))::DOUBLE / length(text)"


@query(rf"""SELECT doc_id, round(least(1.0, greatest(0.0, 0.35::DOUBLE * least(1.0, {_share("[" + chr(92) + "p{L}]")} / 0.75::DOUBLE) + 0.25::DOUBLE * least(1.0, {_share(" ")} / 0.14::DOUBLE)
+ 0.25::DOUBLE * (1.0 - least(1.0, {_share(chr(91) + "".join(chr(92) + c for c in fixed.CODE_PUNCTUATION) + chr(93))} / 0.02::DOUBLE)) + 0.05::DOUBLE * (1.0 - least(1.0, {_share("[0-9]")} / 0.05::DOUBLE))
+ 0.10::DOUBLE * least(1.0, (len(regexp_extract_all(text, '[.!?]["'')\]]?\s')) + CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN 1 ELSE 0 END)::DOUBLE / greatest(1, len(regexp_extract_all(text, '\S+'))) / 0.06::DOUBLE))), 4) AS score FROM documents""")
def str_prose_score(spark, sf):
    """STR-11."""
    return table(spark, sf, "documents").select("doc_id", text.prose_score(F.col("text")).alias("score"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own FROM documents), h AS (SELECT doc_id, own, trim(regexp_extract(own, '^#+\s+([^\n]+)', 1)) AS heading, trim(split_part(own, chr(10), 1)) AS first, regexp_replace(regexp_replace(own, '^#+[ \t]+[^\n]*\n', ''), '^\s+|\s+$', '', 'g') AS rest FROM t)
SELECT doc_id, substr(CASE WHEN heading <> '' THEN heading WHEN length(first) > 4 THEN first ELSE 'untitled' END, 1, 256) AS title,
substr(CASE WHEN trim(regexp_extract(rest, '[^.!?\n]+[.!?]?')) <> '' THEN trim(regexp_extract(rest, '[^.!?\n]+[.!?]?')) ELSE rest END, 1, 200) AS summary FROM h""")
def str_title_summary(spark, sf):
    """STR-03, STR-04."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.title(t).alias("title"), text.summary(t).alias("summary"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{2,}')), lambda x: lower(x)), ' ') AS words FROM documents""")
def str_capitalised(spark, sf):
    """STR-05's words before they are cut to five."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(text.capitalised(F.col("text")), lambda w: F.lower(w)), " ").alias("words"))


@query(r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{2,}')), lambda x: lower(x)) AS words FROM documents),
d AS (SELECT doc_id, list_filter(words, lambda x, i: list_position(words, x) = i) AS once FROM w) SELECT doc_id, array_to_string(list_slice(once, 1, 5), ' ') AS keywords FROM d""")
def str_keywords(spark, sf):
    """STR-05: no document here has a heading, so all keywords are those of the text."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


_XML = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
    _XML = f"replace({_XML}, '{_a}', '{_b}')"


@query(rf"SELECT page_id, trim(regexp_replace({_XML}, '\s+', ' ', 'g')) AS text FROM pages")
def str_html_to_text(spark, sf):
    """STR-10."""
    return table(spark, sf, "pages").select("page_id", text.markup_to_text(F.col("html")).alias("text"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, (generate_subscripts(parts, 1) - 1)::BIGINT AS place, unnest(parts) AS paragraph FROM p""")
def str_paragraphs(spark, sf):
    """STR-26."""
    return context.paragraphs(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("place").cast("long"), "paragraph")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 3000)) AS start FROM documents) SELECT doc_id, (start // 3000)::BIGINT AS place, substr(text, start + 1, 3000) AS piece FROM s""")
def str_fixed_chunks(spark, sf):
    """STR-26: pieces of 3000 characters."""
    return context.pieces(table(spark, sf, "documents"), "doc_id", "text", 3000).select("doc_id", F.col("place").cast("long"), "piece")


@query(r"""WITH t AS (SELECT doc_id, substr(regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), 1, 64) AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_replace(s, '^-+|-+$', '', 'g') = '' THEN 'untitled' ELSE regexp_replace(s, '^-+|-+$', '', 'g') END AS slug FROM t""")
def str_slug(spark, sf):
    """STR-06, of whole texts."""
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT conv_id, turn, " + _any("lower(text)", tuple(p.replace("'", "''") for p in fixed.BOILERPLATE)) + " AS boilerplate, (length(text) // 4)::BIGINT AS tokens FROM conversations")
def str_boilerplate(spark, sf):
    """STR-20."""
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.is_boilerplate(t).alias("boilerplate"), text.estimated_tokens(t).alias("tokens"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[.,;:!?()\[\]{}<>"''`*#]+|[.,;:!?()\[\]{}<>"''`*#]+$', '', 'g')),
lambda x: length(x) >= 4 AND regexp_matches(x, '[\p{L}\p{N}]') AND x NOT IN (""" + ", ".join(f"'{w}'" for w in fixed.SUMMARY_STOPWORDS) + r"""))) AS words FROM benchmark)
SELECT item_id, len(words)::BIGINT AS words FROM w""")
def str_content_words(spark, sf):
    """STR-18: how many subject words each passage has."""
    return table(spark, sf, "benchmark").select("item_id", F.size(text.content_words(F.col("text"))).cast("long").alias("words"))


@query("SELECT d.doc_id, 'sha256:' || sha256('note:' || d.doc_id || ':' || d.lang || ':' || d.source || ':' || array_to_string(list_sort(['b', 'a', d.lang]), ':') || chr(10) || d.text) AS hash FROM documents d")
def hsh_page_content_hash(spark, sf):
    """HSH-02."""
    tags = F.array(F.lit("b"), F.lit("a"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", binary.page_hash(F.lit("note"), F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), tags, F.col("text")).alias("hash"))


@query("SELECT doc_id, sha256(sha256(text) || chr(0) || '1' || chr(0) || lang) AS key FROM documents")
def hsh_derivation_key(spark, sf):
    """HSH-04."""
    return table(spark, sf, "documents").select("doc_id", binary.derivation_key(F.sha2("text", 256), F.lit("1"), F.col("lang")).alias("key"))


@query("""WITH h AS (SELECT doc_id, md5(doc_id::VARCHAR) AS m FROM documents) SELECT doc_id, CASE WHEN list_reduce(list_prepend(0, list_transform(string_split(m, ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, d: (a * 16 + d) % 100) < 70 THEN 'train' ELSE 'held_out' END AS split FROM h""")
def hsh_md5_split(spark, sf):
    """HSH-07, SRC-21."""
    return table(spark, sf, "documents").select("doc_id", text.md5_split(F.col("doc_id").cast("string")).alias("split"))


# --- Memory, runs


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') AND doc_id < 500 THEN 'deprecated' ELSE 'active' END AS status FROM documents")
def mem_forget(spark, sf):
    """MEM-03: notes that hold a word and are older than a cutoff."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("memory/notes/"), F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("title"), F.col("text").alias("body"), F.lit("active").alias("status"), F.timestamp_micros(F.col("doc_id") * 1_000_000).alias("updated")
    )
    return vault.forget(rows, "idiot", older_than=500.0, now=1000.0).select("doc_id", "status")


@query(None)
def mem_compact(spark, sf):
    """MEM-04, JN-10, WIN-08: clusters of alike titles of pages by language; likeness has no SQL form, a test folds the same rows in order."""
    p = table(spark, sf, "pages")
    rows = p.select(F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("scope"), F.col("page_id").cast("string").alias("path"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.timestamp_seconds(F.col("page_id")).alias("updated"))
    return vault.clusters(rows, 0.85, "scope")


@query("""WITH s AS (SELECT user_id AS run_id, 'd' || (event_id % 50) AS address, min(CASE WHEN value >= 50 THEN 0 WHEN value >= 20 THEN 1 ELSE 2 END) AS r FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT DISTINCT user_id AS run_id, 'd' || (event_id % 50) AS address FROM events WHERE event_type = 'click'),
a AS (SELECT c.run_id, c.address, s.r, c.run_id IN (SELECT run_id FROM s) AS known FROM c LEFT JOIN s USING (run_id, address))
SELECT run_id, count(*) FILTER (known AND r <= 1) AS answering, count(*) FILTER (known AND r = 2) AS non_answering, count(*) FILTER (known AND r IS NULL) AS unserved, count(*) FILTER (NOT known) AS unknown FROM a GROUP BY 1""")
def trj_citation_audit(spark, sf):
    """TRJ-02, JN-14, AGG-29: citations by what served them."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.concat(F.lit("d"), (F.col("event_id") % 50).cast("string")).alias("address"), "value", "event_type")
    band = F.when(F.col("value") >= 50, "strong").when(F.col("value") >= 20, "partial").otherwise("weak")
    s = e.where("event_type = 'view'").groupBy("run_id", "address").agg(F.min_by(band, text.band_rank(band)).alias("band"))
    c = e.where("event_type = 'click'").select("run_id", "address").distinct()
    told = traces.audit(s, c)
    names = ("answering", "non_answering", "unserved", "unknown")
    return told.where(F.col("answering").isNotNull()).select("run_id", *[F.size(n).cast("long").alias(n) for n in names])


# --- Streams' batch forms


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 5 MINUTE) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stm_session_window(spark, sf):
    """STM-05: sessions that five silent minutes end."""
    out = jobs.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_tumbling(spark, sf):
    """Hourly windows over events (an extension)."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.windows(e, ["event_type"], "1 hour", measures=[F.round(F.sum("value"), 4).alias("total")])
    return out.select("event_type", F.unix_micros("start").alias("start"), "n", "total")


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS event_id FROM events GROUP BY 1")
def stm_queue_state(spark, sf):
    """STM-03: the last state of every key."""
    return jobs.stateful_states(table(spark, sf, "events").withColumnRenamed("event_type", "state"), ["user_id"], "event_id")


# --- Relational operators at volume


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def rel_pricing_summary(spark, sf):
    """AGG family at volume."""
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def rel_nation_totals(spark, sf):
    """JN family at volume: the planner broadcasts the table of nations by its size."""
    c, o, n = (table(spark, sf, t) for t in ("customer", "orders", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- More operators on whole tables


@query(f"WITH h AS (SELECT 1 FROM pages WHERE {_any(_ROOTED, fixed.DOCUMENTATION_MARKERS)} LIMIT 201) SELECT least(count(*), 200) AS hidden, count(*) > 200 AS at_least FROM h")
def fts_hidden_vendored(spark, sf):
    """FTS-07, AGG-15: hits that a path filter hides, counted to the cap."""
    out = search.hidden_count(table(spark, sf, "pages"), text.provenance(F.col("url")).isin("documentation", "vendored"))
    return out.select(F.col("hidden").cast("long"), "at_least")


@query(f"WITH p AS ({SQL['str_prose_score']}) SELECT doc_id, md5(doc_id || '|seed-1') AS draw FROM p WHERE score >= {fixed.PROSE_FLOOR} ORDER BY draw LIMIT 20")
def fts_sample_prose(spark, sf):
    """FTS-16: twenty passages that read as prose; sampling is the feature."""
    return search.sample_prose(_docs(spark, sf), "doc_id", "text", "path", "seed-1", 20).select("doc_id", "draw")


@query("""WITH s AS (SELECT DISTINCT user_id AS run_id, 'doc' || (event_id % 400) AS a FROM events WHERE event_type = 'view'), c AS (SELECT DISTINCT user_id AS run_id, 'doc' || (event_id % 37) || 'x' AS a FROM events WHERE event_type = 'click'),
l AS (SELECT c.run_id, c.a AS cited FROM c ANTI JOIN s ON c.run_id = s.run_id AND c.a = s.a)
SELECT l.run_id, cited, min(s.a) AS meant FROM l JOIN s USING (run_id) WHERE abs(length(cited) - length(s.a)) <= 1 AND damerau_levenshtein(cited, s.a) = 1 GROUP BY 1, 2 HAVING count(*) = 1""")
def trj_address_corruption(spark, sf):
    """TRJ-03, JN-11: cited addresses one edit from one served address of their run."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "run_id")
    s = e.where("event_type = 'view'").select("run_id", F.concat(F.lit("doc"), (F.col("event_id") % 400).cast("string")).alias("address")).distinct()
    c = e.where("event_type = 'click'").select("run_id", F.concat(F.lit("doc"), (F.col("event_id") % 37).cast("string"), F.lit("x")).alias("address")).distinct()
    return traces.corruption(s, c)


@query("SELECT doc_id, sha256(unhex(substr(hex(encode(text)), 1, 131072)) || encode(chr(0) || octet_length(encode(text)))) AS head_hash FROM documents")
def hsh_head_hash(spark, sf):
    """HSH-01, of every text: its first 64 KiB and its size."""
    return table(spark, sf, "documents").select("doc_id", binary.head_hash(F.col("text").cast("binary")).alias("head_hash"))


_LETTER, _DIGIT = (f"string_split('{a}', '')" for a in (edit.LETTERS, edit.DIGITS))
_SYMBOL = f"substr('{edit.CHECK}', (({' + '.join(f"""(instr('{edit.CHECK_DIGEST}', substr(body, {i + 1}, 1)) - 1) * {4**i} % {len(edit.CHECK_DIGEST)}""" for i in range(4))}) % {len(edit.CHECK)} + 1)::INT, 1)"
_MINTED = f"""WITH n AS (SELECT address, row_number() OVER (ORDER BY md5(address || '|s')) - 1 AS n FROM (SELECT DISTINCT source || '#L0-' || lang AS address FROM documents)), w AS (SELECT address, (n * 48271 + 11) % {edit.CODES} AS w FROM n),
b AS (SELECT address, list_extract({_LETTER}, (w // 3750 % 25)::INT + 1) || list_extract({_LETTER}, (w // 150 % 25)::INT + 1) || list_extract({_LETTER}, (w // 6 % 25)::INT + 1) || list_extract({_DIGIT}, (w % 6)::INT + 1) AS body FROM w), a AS (SELECT address, body || '-' || {_SYMBOL} AS alias FROM b)"""


@query(_MINTED + " SELECT address, alias FROM a")
def ali_mint(spark, sf):
    """ALI-01: an alias for every source; a session's addresses."""
    return aliases.mint(table(spark, sf, "documents").select(F.concat("source", F.lit("#L0-"), "lang").alias("address")), seed="s")


@query(_MINTED + " SELECT lower(replace(alias, '-', '')) AS written, 'normalised' AS status, alias, address, NULL AS candidates FROM a")
def ali_resolve(spark, sf):
    """ALI-03, JN-12: lower-case spellings of every alias without its hyphen."""
    minted = ali_mint(spark, sf)
    return aliases.resolve(minted.select(F.lower(F.replace("alias", F.lit("-"), F.lit(""))).alias("written")), minted)


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), f AS (
SELECT *, chars <= 30000 AS accepted, CASE WHEN chars <= 30000 THEN 1 ELSE 0 END AS n, CASE WHEN chars <= 30000 THEN chars ELSE 0 END AS used FROM c WHERE i = 1 UNION ALL
SELECT c.*, f.n < 20 AND f.used + c.chars <= 30000, f.n + CASE WHEN f.n < 20 AND f.used + c.chars <= 30000 THEN 1 ELSE 0 END, f.used + CASE WHEN f.n < 20 AND f.used + c.chars <= 30000 THEN c.chars ELSE 0 END FROM f JOIN c ON c.source = f.source AND c.i = f.i + 1)
SELECT source, doc_id, chars, accepted FROM f""")
def win_ordered_fold_budget(spark, sf):
    """WIN-01, AGG-32: calls of each source in order, while the budget of those accepted lasts."""
    calls = table(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("chars"))
    return context.budgeted(calls, "source", "doc_id", "chars", 20, 30_000)


@query("SELECT doc_id, list_sort(list_filter(list_distinct(['a', lang, source, 'new']), lambda x: x <> 'en'))::VARCHAR AS tags FROM documents")
def vlt_retag(spark, sf):
    """SET-08, ARR-01."""
    tags = text.retag(F.array(F.lit("a"), F.col("lang"), F.col("source")), F.array(F.lit("new")), F.array(F.lit("en")))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("tags"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?s)```(python|repl|py)?[ \t]*\n.*?```') THEN 'blocks' WHEN regexp_matches(text, '```(python|repl|py)?[ \t]*\n') THEN 'rescued' WHEN regexp_matches(text, '(?m)^\s*FINAL:\s*.+$') THEN 'final' ELSE 'nudge' END AS stage FROM conversations")
def str_reply_stage(spark, sf):
    """STR-14, STR-15."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.reply_stage(F.col("text")).alias("stage"))


@query("SELECT doc_id, strlen(text) - strlen(regexp_replace(text, '[“”„‘’‚]', '', 'g')) > 0 AS smart, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 50) || chr(10) || '... [' || (length(text) - 100) || ' characters left out] ...' || chr(10) || substr(text, length(text) - 49, 50) END AS cut FROM documents")
def str_truncate(spark, sf):
    """STR-12, STR-13."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", (text.smart_quotes(t) > 0).alias("smart"), text.truncate_middle(t, 100).alias("cut"))
