"""Path index: one row per entry of a tree; find, list, count, digest, compare."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, fixed, text


def clamp(limit: object, most: int = fixed.FIND_LIMIT) -> int:
    """A limit within 1 and ``most``; what is no whole number counts as ``most``."""
    return max(1, min(limit, most)) if isinstance(limit, int) else most


def scope(entries: DataFrame, kind: str | None = None, under: str | None = None) -> DataFrame:
    if kind is not None:
        entries = entries.where(F.col("kind") == kind)
    return entries if not under else entries.where(text.under(F.col("path"), under.rstrip("/")))


def find(entries: DataFrame, query: str, limit: int = 20, kind: str | None = None, under: str | None = None, order: str = "name") -> DataFrame:
    """Entries whose name (whose path, if the query has a slash) holds the query, ASCII case ignored."""
    where = F.col("path" if "/" in query else "name")
    hits = scope(entries, kind, under).where(F.contains(text.ascii_lower(where), text.ascii_lower(F.lit(query))))
    by = [F.desc("size"), "path"] if order == "size" else [F.length("name"), "path"]
    return hits.orderBy(*by).limit(clamp(limit))


def children(entries: DataFrame, folder: str, limit: int = 50) -> DataFrame:
    return entries.where(F.col("parent") == folder).orderBy("kind", "name").limit(clamp(limit))


def stat(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path") == path)


def raw_for(entries: DataFrame, path: str) -> DataFrame:
    """(raw): the bytes of a display path; null where several entries share it."""
    return entries.where(F.col("path") == path).agg(F.when(F.count(F.lit(1)) == 1, F.min("raw")).alias("raw"))


def container_of(entries: DataFrame, references: DataFrame) -> DataFrame:
    """(ref, container, member) of container!member references; a real path that holds '!' wins and is left out."""
    real = references.join(entries.select(F.col("path").alias("ref")), "ref", "left_anti")
    parts = real.where(F.contains("ref", F.lit("!"))).select("ref", F.regexp_extract("ref", r"^(.*?)!(.*)$", 1).alias("container"), F.regexp_extract("ref", r"^(.*?)!(.*)$", 2).alias("member"))
    return parts.join(entries.select(F.col("path").alias("container")), "container", "left_semi").select("ref", "container", "member")


def count(entries: DataFrame, kind: str | None = None, under: str | None = None) -> DataFrame:
    return scope(entries, kind, under).agg(F.count(F.lit(1)).alias("n"))


def bytes_total(entries: DataFrame, kind: str | None = None, under: str | None = None) -> DataFrame:
    """Bytes of files, unless another kind is named."""
    return scope(entries, kind or "file", under).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("bytes"))


def newer_than(entries: DataFrame, since: float, now: float, slack: float = 60.0) -> DataFrame:
    """One row: how many entries are newer than ``since``, within the window, from the future, or stale; least and greatest time."""
    t = F.col("mtime")
    return entries.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(t > since).alias("newer"),
        F.count_if((t > since) & (t <= now + slack)).alias("in_window"),
        F.count_if(t > now + slack).alias("future"),
        F.count_if(t <= since).alias("stale"),
        F.min(t).alias("least"),
        F.max(t).alias("greatest"),
    )


def newer_kinds(entries: DataFrame, since: float, sample: int | None = None) -> DataFrame:
    """(kind, newer): entries newer than ``since`` by kind; with ``sample``, a scan stops at so many."""
    rows = entries.where(F.col("mtime") > since)
    rows = rows if sample is None else rows.limit(sample)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("newer"))


def digest(entries: DataFrame) -> DataFrame:
    """One row that is alike whatever the order and partitioning: XOR and sum modulo 2**256 of entry hashes, counts and bytes."""
    limbs = entries.select("kind", "size", binary.entry_limbs("raw", "kind", "size", "mtime").alias("d")).select("kind", "size", "d.*")
    return combine(limbs, [F.col(f"l{i}") for i in range(8)])


def combine(rows: DataFrame, limbs: list[Column]) -> DataFrame:
    """XOR and sum of 32-bit limbs. A sum of 2**31 rows a limb fits; carries are resolved once at the end."""
    xors = [F.bit_xor(c).alias(f"x{i}") for i, c in enumerate(limbs)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(limbs)]
    out = rows.agg(F.count(F.lit(1)).alias("n"), *xors, *sums)
    carry: Column = F.lit(0).cast("long")
    done = {}
    for i in reversed(range(8)):
        whole = F.coalesce(F.col(f"s{i}"), F.lit(0)) + carry
        done[i] = F.lower(F.lpad(F.hex(whole.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
        carry = F.shiftright(whole, 32)
    xor = F.concat(*[F.lower(F.lpad(F.hex(F.coalesce(F.col(f"x{i}"), F.lit(0))), 8, "0")) for i in range(8)])
    return out.select("n", xor.alias("xor"), F.concat(*[done[i] for i in range(8)]).alias("sum"))


def compare_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    """(verdict): equal, or what differs first."""
    left, right = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("n", "xor", "sum")]) for d, p in ((a, "a"), (b, "b")))
    told = F.when(F.col("a_n") != F.col("b_n"), "count").when((F.col("a_xor") != F.col("b_xor")) | (F.col("a_sum") != F.col("b_sum")), "content").otherwise("equal")
    return left.crossJoin(right).select(told.alias("verdict"))


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """(n, at_least): the number of rows, counted to ``cap``."""
    seen = rows.limit(cap + 1).agg(F.count(F.lit(1)).alias("seen"))
    return seen.select(F.least("seen", F.lit(cap)).alias("n"), (F.col("seen") > cap).alias("at_least"))


# --- Classification


def classify(files: DataFrame) -> DataFrame:
    """(raw, kind, encoding, head_hash, note) of rows (raw, content); content that could not be read is null, and noted."""
    rows = files.select("raw", binary.sniff(F.col("content")).alias("s"), binary.head_hash(F.col("content")).alias("head_hash"), F.when(F.col("content").isNull(), "unreadable").alias("note"))
    return rows.select("raw", "s.*", "head_hash", "note")


def pending(entries: DataFrame, done: DataFrame, key: str = "raw", limit: int | None = None) -> DataFrame:
    """Rows without a row in ``done``, in the order of their keys."""
    left = entries.join(done.select(key), key, "left_anti").orderBy(key)
    return left if limit is None else left.limit(limit)


def by_kind(classified: DataFrame, entries: DataFrame) -> DataFrame:
    joined = classified.join(entries.select("raw", "size"), "raw")
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def by_encoding(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("encoding", F.lit("(none)")).alias("encoding")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "encoding")


def copies(rows: DataFrame, hash_col: str, size_col: str) -> DataFrame:
    """One row: files, distinct contents, bytes of copies beyond the first, and files per content. Empty hashes don't count."""
    groups = rows.where(F.col(hash_col) != "").groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"), F.sum(size_col).alias("total"), F.min(size_col).alias("least"))
    extra = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("total") - F.col("least"))), F.lit(0))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count(F.lit(1)).alias("distinct_contents"), extra.alias("duplicate_bytes"))
    return out.withColumn("factor", F.col("files") / F.nullif(F.col("distinct_contents"), F.lit(0)))


def copy_report(rows: DataFrame, hash_col: str, size_col: str) -> DataFrame:
    """One row as :func:`copies`, with the shares of files and bytes that are copies, in per cent to one digit."""
    whole = rows.where(F.col(hash_col) != "").agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("bytes"))
    out = copies(rows, hash_col, size_col).crossJoin(whole)  # one row each
    share = lambda part, of: F.round(F.lit(100.0) * part / F.nullif(F.col(of), F.lit(0)), 1)
    return out.withColumn("percent_files", share(F.col("files") - F.col("distinct_contents"), "files")).withColumn("percent_bytes", share(F.col("duplicate_bytes"), "bytes"))


def needs_repair(chunks: DataFrame) -> DataFrame:
    """Sources whose text was read in another encoding than UTF-8; an unknown encoding is none."""
    return chunks.where(F.col("encoding").isNotNull() & (F.col("encoding") != "utf-8")).select("source").distinct()


def build(entries: DataFrame, path: str, now: float) -> None:
    """Writes a path index by kind and, last, its marker row: an index without one is not complete."""
    entries.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/entries")
    stored = entries.sparkSession.read.parquet(f"{path}/entries")
    marker = stored.agg(F.count(F.lit(1)).alias("entries"), F.count_if(lossy(F.col("path"))).alias("paths_not_utf8"))
    marker.withColumn("built_at", F.lit(now)).write.mode("overwrite").parquet(f"{path}/complete")


def lossy(path: Column) -> Column:
    """Whether a display path stands for bytes that are not UTF-8."""
    return F.contains(path, F.lit("\ufffd"))


def mangled(entries: DataFrame, limit: int = 200) -> DataFrame:
    """Entries whose display lost bytes, by kind, the largest first."""
    return entries.where(lossy(F.col("path"))).orderBy("kind", F.desc("size")).limit(clamp(limit))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of ``new`` in place of the same keys: the last writer wins."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those of ``new`` whose keys are not stored, once each."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def shown_of(shown: DataFrame, scope_rows: DataFrame) -> DataFrame:
    """(shown, total): lines shown against all entries in scope, not against matches."""
    return shown.agg(F.count(F.lit(1)).alias("shown")).crossJoin(scope_rows.agg(F.count(F.lit(1)).alias("total")))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, below ``spark.checkpoint.dir``; on one machine alone, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        where = tempfile.mkdtemp(prefix="corpuloom-")
    return f"{where.rstrip('/')}/corpuloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in files in place of a plan, so that a loop's plan does not grow and a lost executor costs its running tasks."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
