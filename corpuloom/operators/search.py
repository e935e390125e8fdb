"""Chunking, inverted index and BM25 search.

An index is two tables: postings (term, doc, len, tf, positions) and stats
(doc, len). A query reads the postings of its terms only - the term filter
reaches the scan of a stored table - sums them by document in one shuffle and
ends in a top-k, so nothing but k rows a task reaches the driver. Postings carry
their document's length, so that a query need not join the table of all
documents. A stored index (:func:`store`) also has every term's document
frequency and a one-row summary: the rows of a query's own terms, as many as it
has words, and the summary are read first, and the scores are one plan without
a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


#: The term under which documents themselves are counted: no token is empty.
DOCS = ""


def chunk_ranges(data: bytes, target: int = fixed.CHUNK_BYTES, most: int = fixed.CHUNK_MAX_BYTES) -> list[tuple[int, int]]:
    """Byte ranges of a text: whole lines up to ``target`` bytes and more, no range over ``most``, blank ones dropped."""
    found, begin, at = [], 0, 0
    while at < len(data):
        stop = data.find(b"\n", at) + 1 or len(data)
        overlong = range(begin, stop - most, most)
        found.extend((a, a + most) for a in overlong)
        begin += most * len(overlong)
        if stop - begin >= target or stop == len(data):
            found.append((begin, stop))
            begin = stop
        at = stop
    return [(a, b) for a, b in found if a < b and data[a:b].strip()]


def chunks(docs: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id_col, byte_start, byte_end) of every chunk of every row's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ranges = chunk_ranges(batch.column(1)[i].as_py() or b"")
                ids = batch.column(0).take(pa.array([i] * len(ranges), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in ranges], pa.int64()) for k in (0, 1))], ["id", "byte_start", "byte_end"])

    kept = docs.select(docs[id_col].alias("id"), docs[bytes_col].cast("binary").alias("data"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, byte_start long, byte_end long").withColumnRenamed("id", id_col)


def read_chunks(found: DataFrame, docs: DataFrame, key: str, bytes_col: str, most: int = fixed.READ_BYTES) -> DataFrame:
    """Adds ``text``: the bytes of each range, ``most`` at most, as valid UTF-8."""
    data = F.substring(F.col(bytes_col).cast("binary"), (F.col("byte_start") + 1).cast("int"), F.least(F.col("byte_end") - F.col("byte_start"), F.lit(most)).cast("int"))
    joined = found.join(docs.select(key, bytes_col), key)
    return joined.withColumn("text", F.make_valid_utf8(data.cast("string"))).drop(bytes_col)


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, doc, len, tf, positions) of a table's texts, counted where each text is; one more row a document with the empty term. Null texts are empty."""
    few = docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    docs = docs.repartition("doc") if few else docs  # a small table may be a single file
    rows = docs.select("doc", text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            tokens = batch.column(1)
            lens = np.diff(tokens.offsets.to_numpy()).astype(np.int32)
            words = tokens.flatten().dictionary_encode()
            of = np.repeat(np.arange(batch.num_rows), lens)
            at = np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens)
            code = words.indices.to_numpy().astype(np.int64)
            order = np.lexsort((at, code, of))
            of, code, at = of[order], code[order], at[order]
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (code[1:] != code[:-1])]) if len(of) else np.empty(0, np.int64)
            ends = np.r_[first, len(of)].astype(np.int32)
            n = batch.num_rows
            which = np.r_[np.arange(n), of[first]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array([DOCS] * n, pa.string()), words.dictionary.take(pa.array(code[first])).cast(pa.string())]), batch.column(0).take(pa.array(which)), pa.array(lens[which]),
                    pa.array(np.r_[np.ones(n, np.int64), np.diff(ends)].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n, np.int32), ends].astype(np.int32)), pa.array(at.astype(np.int32))),
                ],
                ["term", "doc", "len", "tf", "positions"],
            )

    return rows.mapInArrow(run, f"term string, doc {kind}, len int, tf int, positions array<int>")


def index(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of a table's texts. Null texts are empty. A text's postings are counted where it is, so nothing is shuffled."""
    postings = counted(docs, id_col, text_col).where(F.col("term") != DOCS)
    postings = postings.select("term", "doc", F.col("len").cast("long").alias("len"), F.col("tf").cast("long").alias("tf"), "positions")
    own = docs.select(docs[id_col].alias("doc"), F.size(text.tokens(F.coalesce(docs[text_col], F.lit("")))).cast("long").alias("len"))
    return postings, own


def scan(docs: DataFrame, id_col: str, text_col: str, phrases: Sequence[Sequence[str]], every: bool, keep: DataFrame | None = None) -> DataFrame:
    """(doc, score) as :func:`bm25` has it, of texts that no index holds: they are split once, and a few counts of each document are all that is shuffled."""
    if not phrases or any(len(p) > 1 for p in phrases):
        return bm25(*index(docs, id_col, text_col), phrases, every, keep)
    tokens = docs.select(docs[id_col].alias("doc"), text.tokens(F.coalesce(docs[text_col], F.lit(""))).alias("tokens"))
    is_term = lambda t: lambda x: x == F.lit(t)
    tf = F.array(*[F.size(F.filter("tokens", is_term(p[0]))).cast("long") for p in phrases])
    rows = tokens.select("doc", F.size("tokens").cast("long").alias("len"), tf.alias("tf")).repartition("doc")  # both uses read this exchange
    return _scored(rows, summary(rows), len(phrases), every, keep)


def summary(stats: DataFrame) -> DataFrame:
    """(n, average): documents and their mean length, one row."""
    return stats.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("average"))


class Stored(NamedTuple):
    """An index in files: postings by term, documents, every term's document frequency, and the summary row."""

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame
    whole: DataFrame


def store(postings: DataFrame, stats: DataFrame, path: str) -> Stored:
    """Writes an index: by term and document, so that a common term is many tasks' work and a query's terms are found by the footers of few row groups."""
    spark = postings.sparkSession
    postings.sort("term", "doc").write.parquet(f"{path}/postings")
    stats.write.parquet(f"{path}/stats")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).sort("term").write.parquet(f"{path}/terms")
    summary(spark.read.parquet(f"{path}/stats")).coalesce(1).write.parquet(f"{path}/whole")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Stored:
    return Stored(*(spark.read.parquet(f"{path}/{t}") for t in Stored._fields))


def ask(index_: Stored, phrases: Sequence[Sequence[str]], every: bool, keep: DataFrame | None = None) -> DataFrame:
    """As :func:`bm25`, of a stored index. Phrases of several tokens are left to it: their document frequency is not stored."""
    if not phrases or any(len(p) > 1 for p in phrases):
        return bm25(index_.postings, index_.stats, phrases, every, keep, index_.whole)
    times = Counter(p[0] for p in phrases)
    df = {r["term"]: r["df"] for r in index_.terms.where(F.col("term").isin(sorted(times))).collect()}  # at most as many rows as the query has words
    n, average = index_.whole.first()
    own = index_.postings.where(F.col("term").isin(sorted(times)))
    b, tf = fixed.BM25_B, F.col("tf").cast("double")
    damp = F.lit(fixed.BM25_K1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len").cast("double") / F.lit(average))
    weight = {t: k * max(log((n - df[t] + 0.5) / (df[t] + 0.5)), fixed.IDF_FLOOR) * (fixed.BM25_K1 + 1) for t, k in times.items() if t in df}
    of = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in sorted(weight.items())], F.lit(0.0))
    hits = own.groupBy("doc").agg(F.sum(of * tf / (tf + damp)).alias("score"), F.count(F.lit(1)).alias("met"))
    if every:
        hits = hits.where(F.col("met") == len(times))
    if keep is not None:
        hits = hits.join(keep, "doc", "left_semi")
    return hits.select("doc", "score")


def and_phrases(query: str) -> list[list[str]]:
    """The first 16 words of a query, each split as the index splits: a word with an underscore is a phrase of its parts."""
    import re

    return [p for p in (_split(w) for w in re.findall(r"\w+", query)[: fixed.MATCH_TERMS]) if p]


def or_phrases(query: str) -> list[list[str]]:
    """The words of a query between white space, each a phrase of its parts; words without letters or digits are dropped."""
    return [p for p in map(_split, query.split()) if p]


def _split(word: str) -> list[str]:
    import unicodedata

    base = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
    parts = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in base)
    return parts.split()


def frequencies(postings: DataFrame, phrases: Sequence[Sequence[str]]) -> DataFrame:
    """(doc, len, tf array<long>): how often each phrase occurs in the documents that hold any of its tokens."""
    distinct = sorted({t for p in phrases for t in p})
    own = postings.where(F.col("term").isin(distinct))
    if all(len(p) == 1 for p in phrases):
        counts = [F.coalesce(F.sum(F.when(F.col("term") == p[0], F.col("tf"))), F.lit(0)) for p in phrases]
        return own.groupBy("doc").agg(F.max("len").alias("len"), F.array(*counts).alias("tf"))
    places = [F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"p{i}") for i, t in enumerate(distinct)]
    held = own.groupBy("doc").agg(F.max("len").alias("len"), *places)
    column = {t: F.col(f"p{i}") for i, t in enumerate(distinct)}

    def count(phrase: Sequence[str]) -> Column:
        def follows(at: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.array_contains(column[t], at + j) for j, t in enumerate(phrase[1:], 1)], F.lit(True))

        return F.size(F.filter(column[phrase[0]], follows)).cast("long")

    return held.select("doc", "len", F.array(*map(count, phrases)).alias("tf"))


def bm25(postings: DataFrame, stats: DataFrame, phrases: Sequence[Sequence[str]], every: bool, keep: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """(doc, score) of the documents with all phrases (``every``) or any of them; the better, the larger.

    ``whole`` is the stored summary of the index; without it, it is counted.

    ``keep`` (doc) restricts what is returned, not what is counted. No phrases
    give no rows. Inverse frequencies have a small positive floor.
    """
    if not phrases:
        return stats.select("doc", F.lit(0.0).alias("score")).limit(0)
    return _scored(frequencies(postings, phrases), summary(stats) if whole is None else whole, len(phrases), every, keep)


def _scored(tf: DataFrame, whole: DataFrame, phrases: int, every: bool, keep: DataFrame | None) -> DataFrame:
    """(doc, score) of rows (doc, len, tf of each phrase)."""
    n = F.col("n")
    df = tf.agg(F.array(*[F.sum(F.when(F.get("tf", F.lit(i)) > 0, 1).otherwise(0)).cast("double") for i in range(phrases)]).alias("df"))
    at = [F.get("tf", F.lit(i)).cast("double") for i in range(phrases)]
    met = [x > 0 for x in at]
    hits = tf.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), met))
    if keep is not None:
        hits = hits.join(keep, "doc", "left_semi")
    rows = hits.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(df))  # one row each
    k1, b = F.lit(fixed.BM25_K1), F.lit(fixed.BM25_B)
    damp = k1 * (F.lit(1.0) - b + b * F.col("len").cast("double") / F.col("average"))
    score = F.lit(0.0)
    for i, x in enumerate(at):
        d = F.get("df", F.lit(i))
        idf = F.greatest(F.log((n - d + F.lit(0.5)) / (d + F.lit(0.5))), F.lit(fixed.IDF_FLOOR))
        score = score + idf * x * (k1 + F.lit(1.0)) / (x + damp)
    return rows.select("doc", score.alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` (at least one), ties in the order of their ids."""
    return scored.orderBy(F.desc("score"), "doc").limit(max(1, k))


def hidden_count(hits: DataFrame, vendored: Column, cap: int = fixed.HIDDEN_CAP) -> DataFrame:
    """(hidden, at_least): how many hits a vendored filter hides, counted to ``cap``; scanning stops there."""
    seen = hits.where(vendored).limit(cap + 1).agg(F.count(F.lit(1)).alias("seen"))
    return seen.select(F.least("seen", F.lit(cap)).alias("hidden"), (F.col("seen") > cap).alias("at_least"))


def with_derived(files: DataFrame, derived: DataFrame, k: int = fixed.DERIVED_PASS_K) -> DataFrame:
    """File hits, then the top ``k`` derived ones whose address they lack."""
    extra = derived.join(files, "address", "left_anti").orderBy(F.desc("score"), "address").limit(k)
    return files.withColumn("derived", F.lit(False)).unionByName(extra.withColumn("derived", F.lit(True)))


def labelled(hits: DataFrame, question: str, text_col: str, path_col: str) -> DataFrame:
    """Adds covered, total, band and provenance for a question."""
    terms = text.content_terms(F.lit(question))
    covered, total = text.term_coverage(F.col(text_col), terms).alias("covered"), F.size(terms)
    out = hits.withColumn("covered", covered).withColumn("total", total)
    return out.withColumn("band", text.match_quality(F.col("covered"), F.col("total"))).withColumn("provenance", text.provenance(F.col(path_col)))


def coverage(indexed: DataFrame, known: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """One row: sources and bytes indexed, text files and documents known, documents extracted and in need of OCR, and indexed sources per text file (which may pass 1, as derived sources count too; 0 without text files)."""
    a = indexed.agg(F.count_distinct("source").alias("sources_indexed"), F.count(F.lit(1)).alias("chunks"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    b = known.agg(F.count_if(F.col("kind") == "text").alias("text_files_in_map"), F.count_if(F.col("kind").isin("document", "archive")).alias("documents_in_map"))
    out = a.crossJoin(b)  # one row each
    if queue is not None:
        extraction = F.col("task") == "extract_text"
        out = out.crossJoin(queue.agg(F.count_if(extraction & (F.col("state") == "done")).alias("documents_extracted"), F.count_if(extraction & F.coalesce(F.col("note") == "needs_ocr", F.lit(False))).alias("documents_needing_ocr")))
    return out.withColumn("text_coverage", F.coalesce(F.col("sources_indexed") / F.nullif(F.col("text_files_in_map"), F.lit(0)), F.lit(0.0)))


def coverage_note(c: DataFrame) -> DataFrame:
    share = F.lit(100.0) * F.col("text_coverage")
    said = F.format_string("[coverage: %d sources indexed (%.1f%% of the %d text files)]", "sources_indexed", share, "text_files_in_map")
    return c.withColumn("note", F.when(share >= 99.5, "").otherwise(said))


def sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows, uniform over ``key`` and reproducible by ``seed``: the least hashes."""
    return rows.withColumn("draw", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)).cast("binary"))).orderBy("draw").limit(n)


def sample_prose(rows: DataFrame, key: str, text_col: str, path_col: str, seed: str, n: int) -> DataFrame:
    """As :func:`sample`, of rows whose name and text read as prose."""
    named = rows.where(text.non_prose_ending(F.col(path_col)).isNull())
    return sample(named.where(text.looks_like_prose(F.col(text_col))), key, seed, n)


def drawable(rows: DataFrame, path_col: str, vendored: bool = False, derived: bool = True, prose: bool = False) -> DataFrame:
    """Rows that a draw may take: without vendored paths, derived text or endings of no prose, unless they are wanted."""
    if not vendored:
        rows = rows.where(~text.is_vendored(F.col(path_col)))
    if not derived:
        rows = rows.where(~F.col("derived"))
    return rows.where(text.non_prose_ending(F.col(path_col)).isNull()) if prose else rows


def sample_report(rows: DataFrame, key: str, text_col: str, path_col: str, seed: str, want: int, floor: float = fixed.PROSE_FLOOR) -> DataFrame:
    """One row: what a draw of ``want`` prose passages met: drawn, kept, rejected, unreadable, duplicates and the mean score of those kept.

    Candidates are taken in the order of the draw until enough are kept or
    ``max(60, 30 * want)`` are drawn, so the rows that are ranked are as many at
    most. A null text is unreadable; a text that was drawn before is a duplicate.
    """
    most = max(60, 30 * want)
    drawn = sample(drawable(rows, path_col, prose=True).select(key, text_col), key, seed, most)
    nth = F.row_number().over(Window.partitionBy(F.md5(F.col(text_col).cast("binary"))).orderBy("draw"))
    score = text.prose_score(F.col(text_col))
    told = F.when(F.col(text_col).isNull(), "unreadable").when(nth > 1, "duplicate").when(score < floor, "rejected").otherwise("kept")
    told = drawn.select("draw", told.alias("told"), score.alias("score"))
    before = F.coalesce(F.sum(F.when(F.col("told") == "kept", 1).otherwise(0)).over(Window.orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = told.withColumn("before", before).where(F.col("before") < want)
    counts = [F.count_if(F.col("told") == t).alias(n) for t, n in (("kept", "kept"), ("rejected", "rejected_content"), ("unreadable", "unreadable"), ("duplicate", "duplicates"))]
    return met.agg(F.count(F.lit(1)).alias("drawn"), *counts, F.round(F.coalesce(F.avg(F.when(F.col("told") == "kept", F.col("score"))), F.lit(0.0)), 4).alias("mean_score"))


def top_per(rows: DataFrame, by: str, k: int, score: str = "score", tie: str = "doc") -> DataFrame:
    """(…, place): the best ``k`` rows of every ``by``, ties in the order of ``tie``. Spark keeps ``k`` rows of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def run_search(index_: tuple[DataFrame, DataFrame], sources: DataFrame, query: str, k: int = 8, vendored: bool = False, derived_only: bool = False, count_only: bool = False) -> DataFrame:
    """What a command of a search prints: (doc, score) of the best ``k``, or (total) with ``count_only``. ``sources`` has doc, path and derived."""
    keep = sources if vendored else sources.where(~text.is_vendored(F.col("path")))
    keep = keep.where("derived") if derived_only else keep
    hits = bm25(*index_, and_phrases(query), every=True, keep=keep.select("doc"))
    return hits.agg(F.count(F.lit(1)).alias("total")) if count_only else top(hits, k)


def encoding_for(asked: Column, classified: Column) -> Column:
    """The encoding to read a source in: the caller's, else the classification's, else UTF-8."""
    return F.coalesce(asked, classified, F.lit("utf-8"))


def add_sources(postings: DataFrame, stats: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """An index with the rows of ``docs`` whose ids it lacks; what is there stays as it is."""
    fresh = docs.join(stats.select(F.col("doc").alias(id_col)), id_col, "left_anti")
    new_postings, new_stats = index(fresh, id_col, text_col)
    return postings.unionByName(new_postings), stats.unionByName(new_stats)


def drop_sources(postings: DataFrame, stats: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index without the documents of ``gone`` (doc)."""
    return postings.join(gone, "doc", "left_anti"), stats.join(gone, "doc", "left_anti")


def replace_sources(postings: DataFrame, stats: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """An index in which the rows of ``docs`` stand for their ids."""
    new_postings, new_stats = index(docs, id_col, text_col)
    old_postings, old_stats = drop_sources(postings, stats, new_stats.select("doc"))
    return old_postings.unionByName(new_postings), old_stats.unionByName(new_stats)


def hit_line(address: Column, body: Column, labels: Sequence[Column]) -> Column:
    """``address [label, ...]`` and a snippet of 300 characters."""
    return F.concat(address, F.lit(" ["), F.concat_ws(", ", *labels), F.lit("]\n"), text.squeeze(body, 300))


def addressed(chunks_: DataFrame, addresses: DataFrame) -> DataFrame:
    """Chunks that addresses (column address) name by source or display path and byte range."""
    parts = addresses.select("address", text.address_parts(F.col("address")).alias("p")).where("p.source IS NOT NULL")
    parts = parts.select("address", F.col("p.source").alias("named"), F.col("p.byte_start").alias("a"), F.col("p.byte_end").alias("b"))
    keyed = chunks_.withColumn("named", F.explode(F.array_distinct(F.array(text.display(F.col("source")), F.col("display")))))
    return keyed.join(parts, (keyed["named"] == parts["named"]) & (F.col("byte_start") == F.col("a")) & (F.col("byte_end") == F.col("b"))).drop("named", "a", "b").dropDuplicates(["address"])


def address_of_line(line: Column) -> Column:
    """The address at the head of a printed hit line, so that a whole line can be read back."""
    return F.nullif(F.regexp_extract(F.split_part(line, F.lit("\n"), F.lit(1)), f"({fixed.ADDRESS_TOKEN})", 1), F.lit(""))


def repairs(chunks_: DataFrame, classification: DataFrame) -> DataFrame:
    """(source, encoding): sources whose chunks were read in another encoding than they are now known to have; unknown encodings are none."""
    read = chunks_.groupBy("source").agg(F.max("encoding").alias("was"))
    known = classification.where(F.col("encoding").isNotNull() & (F.col("encoding") != "utf-8")).select(F.col("raw").alias("source"), "encoding")
    return known.join(read, "source").where(~F.col("encoding").eqNullSafe(F.col("was"))).select("source", "encoding")


def repair_report(chunks_: DataFrame, classification: DataFrame, sources: DataFrame, most: int = 32 << 20) -> DataFrame:
    """(cause, sources): what a pass over sources known in another encoding than UTF-8 does: current ones are skipped, missing and too large ones told, the others replaced. ``sources`` has source and size."""
    read = chunks_.groupBy("source").agg(F.max("encoding").alias("was"))
    known = classification.where(F.col("encoding").isNotNull() & (F.col("encoding") != "utf-8")).select(F.col("raw").alias("source"), "encoding")
    rows = known.join(read, "source").join(sources.select("source", "size", F.lit(True).alias("there")), "source", "left")
    cause = F.when(F.col("encoding").eqNullSafe(F.col("was")), "current").when(F.col("there").isNull(), "missing").when(F.col("size") > most, "too large").otherwise("replaced")
    return rows.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("sources"))
