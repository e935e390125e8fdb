"""Work queue: planning from a classification, claiming, states, and derived text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary, text

# --- Fixed values. Tasks, their priorities, and file endings that hold text to extract.
TASKS = ("list_archive", "extract_text", "index_text", "ocr_page", "vlm_describe", "asr_transcribe", "summarise", "synthesise")
PRIORITY = {"extract_text": 10, "index_text": 20, "list_archive": 30, "ocr_page": 50, "vlm_describe": 60, "asr_transcribe": 70, "summarise": 90}
DOCUMENT_ENDINGS = (".pdf", ".docx", ".docm", ".dotx", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp", ".epub", ".fodt", ".odg", ".xps")
BOTH_ENDINGS = (".rar",)
VERSION = "1"


def _ends(name, endings):
    low = text.ascii_lower(name)
    return text.any_of([F.endswith(low, F.lit(e)) for e in endings])


def plan(entries: DataFrame, classification: DataFrame, queue: DataFrame) -> DataFrame:
    """New queue rows: extraction for documents by name, listing for other archives, indexing for text; rows already queued are left out, so planning twice plans nothing."""
    known = entries.join(classification.select("raw", F.col("kind").alias("content")), "raw")
    name, content = F.col("name"), F.col("content")
    tasks = F.array_compact(
        F.array(
            F.when(content.isin("document", "archive") & _ends(name, (*DOCUMENT_ENDINGS, *BOTH_ENDINGS)), "extract_text"),
            F.when((content == "archive") & ~_ends(name, DOCUMENT_ENDINGS), "list_archive"),
            F.when(content == "text", "index_text"),
        )
    )
    wanted = known.select("raw", F.explode(tasks).alias("task"))
    priority = F.coalesce(*[F.when(F.col("task") == t, F.lit(p)) for t, p in PRIORITY.items()])
    return wanted.withColumn("priority", priority).join(queue.select("raw", "task"), ["raw", "task"], "left_anti")


def claim(queue: DataFrame, tasks: list[str], n: int = 1) -> DataFrame:
    """The next ``n`` pending rows of some tasks, by priority and key."""
    return queue.where((F.col("state") == "pending") & F.col("task").isin(tasks)).orderBy("priority", "raw").limit(n)


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what a log of changes amounts to."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("task", "state").agg(F.count(F.lit(1)).alias("n"))


def run_stats(outcomes: DataFrame) -> DataFrame:
    state = F.col("state")
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(state == "done").alias("done"), F.count_if(state == "failed").alias("failed"),
        F.count_if(state == "skipped").alias("skipped"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cache_hits"),
    )


def reopen(queue: DataFrame, state: str, task: str | None = None, note: str | None = None) -> DataFrame:
    """The queue with rows of a state pending again, those of a task and note if named."""
    which = F.col("state") == state
    for column, value in (("task", task), ("note", note)):
        if value is not None:
            which &= F.col(column) == value
    return queue.withColumn("note", F.when(which, F.lit(None)).otherwise(F.col("note"))).withColumn("state", F.when(which, "pending").otherwise(F.col("state")))


def follow_on(outcomes: DataFrame) -> DataFrame:
    """OCR rows for extractions that ask for it."""
    return outcomes.where((F.col("task") == "extract_text") & (F.col("note") == "needs_ocr")).select("raw", F.lit("ocr_page").alias("task"), F.lit(PRIORITY["ocr_page"]).alias("priority"))


def derive(sources: DataFrame, cache: DataFrame, engine: Callable[[DataFrame], DataFrame], task: str, params: str = "") -> DataFrame:
    """(task, key, text) that the cache lacks, each distinct content once.

    ``engine`` takes (key, content) and gives (key, text). The key is of the
    content's hash, so copies share one derivation, and an engine is asked
    before any is repeated.
    """
    keyed = sources.withColumn("key", binary.derivation_key(F.col("source_hash"), F.lit(VERSION), F.lit(params)))
    new = keyed.join(cache.where(F.col("task") == task).select("key"), "key", "left_anti").dropDuplicates(["key"])
    return engine(new.select("key", "content")).select(F.lit(task).alias("task"), "key", "text")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("task").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text")).alias("bytes"))


def find_members(members: DataFrame, query: str, limit: int = 20) -> DataFrame:
    hits = members.where(F.contains(text.ascii_lower(F.col("member")), text.ascii_lower(F.lit(query))))
    return hits.orderBy(F.length("member"), "member").limit(max(1, limit))


def archive_totals(members: DataFrame) -> DataFrame:
    return members.groupBy("container").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("declared_bytes"))


def archive_kinds(members: DataFrame) -> DataFrame:
    """(container, kind, members) of listed archives."""
    return members.groupBy("container", "kind").agg(F.count(F.lit(1)).alias("members"))


def member_lines(members: DataFrame) -> DataFrame:
    """(container, text): the members of each archive as lines of name, size and kind between tabs, by name. A listing is bounded, and so is its text."""
    rows = members.groupBy("container").agg(F.array_sort(F.collect_list(F.struct("member", "size", "kind"))).alias("m"))
    return rows.select("container", F.array_join(F.transform("m", lambda m: F.concat_ws("\t", m["member"], m["size"].cast("string"), m["kind"])), "\n").alias("text"))


def members_of_lines(texts: DataFrame) -> DataFrame:
    """(container, member, size, kind) of such texts; a size that is no number counts as 0, a missing kind as file, and empty lines as nothing."""
    lines = texts.select("container", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    parts = F.split("line", "\t")
    digits = F.when(F.get(parts, F.lit(1)).rlike(r"^\d+$"), F.get(parts, F.lit(1)).try_cast("long"))
    return lines.select("container", F.get(parts, F.lit(0)).alias("member"), F.coalesce(digits, F.lit(0)).alias("size"), F.coalesce(F.get(parts, F.lit(2)), F.lit("file")).alias("kind"))


def window_of(queue: DataFrame, tasks: list[str], most: int, paused: bool = False, seconds_left: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(claimed, reason): the rows that one run takes, and why it stops: paused, deadline, max_items or drained."""
    open_ = queue.where((F.col("state") == "pending") & F.col("task").isin(tasks))
    if paused or (seconds_left is not None and seconds_left <= 0):
        return open_.limit(0), open_.limit(1).agg(F.lit("paused" if paused else "deadline").alias("reason"))
    waiting = open_.limit(most + 1).agg(F.count(F.lit(1)).alias("n"))
    return claim(queue, tasks, most), waiting.select(F.when(F.col("n") > most, "max_items").otherwise("drained").alias("reason"))


def publish(snapshot: DataFrame, key: str, now: float) -> DataFrame:
    """A meta row that holds a one-row table as JSON, with its time."""
    return snapshot.select(F.lit(key).alias("key"), F.to_json(F.struct("*")).alias("value"), F.lit(now).alias("written_at"))


def published(meta: DataFrame, key: str, now: float) -> DataFrame:
    """(value, age): the newest row of a key; null if there is none, meaning unknown."""
    return meta.where(F.col("key") == key).agg(F.max_by("value", "written_at").alias("value"), (F.lit(now) - F.max("written_at")).alias("age"))


def freshness(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """(name, verdict): current or stale by the markers' fingerprint; unknown where nothing was recorded."""
    rows = live.select("name", F.col("fingerprint").alias("now")).join(recorded.select("name", "fingerprint"), "name", "left")
    return rows.select("name", F.when(F.col("fingerprint").isNull(), "unknown").when(F.col("fingerprint") == F.col("now"), "current").otherwise("stale").alias("verdict"))


# --- Fixed values. Endings of archive members whose text is worth extracting, beyond code and markup.
MEMBER_ENDINGS = (".txt", ".text", ".md", ".markdown", ".rst", ".log", ".csv", ".tsv", ".json", ".xml", ".html", ".htm", ".xhtml", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".toml", ".sql")


def is_text_member(member):
    """Whether an archive member is read for its text, by its name."""
    return _ends(member, MEMBER_ENDINGS)


def member_text(references: DataFrame, entries: DataFrame, classification: DataFrame, cache: DataFrame) -> DataFrame:
    """(ref, text): extracted text of the containers that container!member references name, by the content's hash."""
    raws = references.join(entries.select(F.col("path").alias("container"), "raw"), "container")
    hashed = raws.join(classification.select("raw", "head_hash"), "raw")
    keyed = hashed.withColumn("key", binary.derivation_key(F.col("head_hash"), F.lit(VERSION), F.lit("")))
    return keyed.join(cache.where("task = 'extract_text'").select("key", "text"), "key").select("ref", "text")


def fault_class(stderr):
    """What an archive tool's complaint amounts to."""
    low = F.lower(F.coalesce(stderr, F.lit("")))
    told = (("encrypted", "passphrase|password|encrypt"), ("truncated", "truncat|unexpected end"), ("unsupported", "unrecognized|unsupported|unknown"), ("damaged", "damaged|corrupt|checksum|crc"))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in told], F.lit("failed"))
