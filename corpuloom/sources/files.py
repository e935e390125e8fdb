"""Readers and writers of logs, pages, archives, question sets and plans."""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import lzma
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed, text

# --- Fixed values. Members of office and book files that carry the words.
TEXT_MEMBERS = ("word/document.xml", "xl/sharedStrings.xml", "xl/worksheets/", "ppt/slides/", "ppt/notesSlides/", "content.xml", "OEBPS/", "EPUB/", "index.xml")
MOST_TEXT_MEMBERS = 500
#: Tasks for each core that read a folder of small files.
FILE_TASKS = 4
EVENT_KINDS = ("start", "root_message", "turn_start", "repl_result", "subcall", "guardrail", "corpus_served", "end")


def _json_lines(spark: SparkSession, path: str, schema: str, recursive: bool, pattern: str) -> DataFrame:
    """(file, value, e, torn) of every line that is not blank; what is no JSON object is torn."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    whole = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    torn = F.col("e._corrupt").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return lines.withColumn("e", whole).withColumn("torn", torn)


def trajectories(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(events, files): known events with their run (the file's stem), and per file its torn lines, unknown events and whether it ended."""
    lines = _json_lines(spark, path, schemas.EVENTS, recursive, pattern).withColumn("run_id", F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1))
    if recursive:
        lines = lines.where(~F.contains("file", F.lit("/traces/")))
    known = ~F.col("torn") & F.col("e.event").isin(*EVENT_KINDS)
    files = lines.groupBy("run_id", "file").agg(
        F.count_if("torn").alias("torn"), F.count_if(~F.col("torn") & ~F.coalesce(F.col("e.event").isin(*EVENT_KINDS), F.lit(False))).alias("unknown"), F.coalesce(F.max(F.col("e.event") == "end"), F.lit(False)).alias("ended")
    )
    return lines.where(known).select("run_id", "e.*").drop("_corrupt"), files


def metrics(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Metric records; a torn line is a record of an unknown model that is torn."""
    lines = _json_lines(spark, path, schemas.METRICS, False, pattern)
    names = [c.strip().split(" ")[0] for c in _top_level(schemas.METRICS)]
    columns = [F.when(~F.col("torn"), F.col(f"e.{n}")).alias(n) for n in names if n not in ("model", "torn")]
    model = F.when(F.col("torn"), "unknown").otherwise(F.col("e.model")).alias("model")
    return lines.select(model, F.when(F.col("torn"), F.lit(True)).otherwise(F.coalesce("e.torn", F.lit(False))).alias("torn"), *columns)


def _top_level(ddl: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[at:i])
            at = i + 1
    return [*parts, ddl[at:]]


def _walked(top: str, ending: str) -> Iterator[str]:
    """Files of an ending below a folder, without the hidden ones that Spark's readers leave out too."""
    folders = [top]
    while folders:
        with os.scandir(folders.pop()) as entries:
            for e in entries:
                if e.name.startswith(".") or (e.name.startswith("_") and "=" not in e.name):
                    continue
                if e.is_dir():
                    folders.append(e.path)
                elif e.name.endswith(ending):
                    yield e.path


def _whole_files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(file, value) of all files of an ending below a path.

    Spark's readers list all files on the driver and take 32 small ones a task at
    most. Below a folder on disk one task tells the names, and tasks whose number
    doesn't grow with them read the files; other places are left to the readers.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    top = uri.getPath()
    if uri.getScheme() != "file" or not os.path.isdir(top):
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}")
        return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (os.fsencode(f) for batch in batches for _ in range(batch.num_rows) for f in _walked(top, ending))
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["raw"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda *rows: pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in rows], ["file", "value"])
        held, data, size = [], [], 0
        for raw in (r for batch in batches for r in batch.column(0).to_pylist()):
            with open(raw, "rb") as f:
                data.append(f.read())
            held.append(os.fsdecode(raw).encode("utf-8", "replace"))
            size += len(data[-1])
            if size > 4 << 20 or len(held) == 1000:
                yield made(held, data)
                held, data, size = [], [], 0
        if held:
            yield made(held, data)

    dealt = spark.range(1, numPartitions=1).mapInArrow(names, "raw binary").repartition(FILE_TASKS * spark.sparkContext.defaultParallelism, "raw")
    return dealt.mapInArrow(read, "file binary, value binary").select(F.col("file").cast("string").alias("file"), F.col("value").cast("string").alias("value"))


def pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, faults): Markdown files with a head between --- lines, and files without a readable one."""
    files = _whole_files(spark, path, ".md").select("file", F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1)
    rows = files.withColumn("head", head).withColumn("body", F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2))
    top = spark_path(path)
    rows = rows.withColumn("path", F.ltrim(F.expr(f"substring(file, instr(file, '{top}') + {len(top)})"), F.lit("/")))
    found = rows.select("path", *head_fields("head"), "body")
    good = F.col("id").isNotNull() & F.col("kind").isNotNull()
    return found.where(good), found.where(~good).select("path")


def spark_path(path: str) -> str:
    return path.removeprefix("file://").rstrip("/").replace("'", "\\'")


def head_fields(head: str) -> list[Column]:
    """Fields of a page's head: ``key: value`` lines, tags in brackets or as a dashed list; ``schema`` is an old name of ``schema_version``."""

    def one(key: str) -> Column:
        raw = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)
        bare = F.regexp_replace(F.trim(raw), r"^[\"']|[\"']$", "")
        return F.when((bare != "") & (bare != "null") & (bare != "~"), bare)

    inline = F.split(F.regexp_extract(head, r"(?m)^tags:[ \t]*\[(.*)\]", 1), ",")
    dashed = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\n]+)"), F.lit(1))
    tags = F.filter(F.transform(F.concat(inline, dashed), lambda t: F.regexp_replace(F.trim(t), r"^[\"']|[\"']$", "")), lambda t: t != "")
    stamps = [F.try_to_timestamp(one(k)).alias(k) for k in ("created", "updated", "last_access")]
    words = [one(k).alias(k) for k in ("id", "kind", "name", "title", "summary", "hash", "status", "superseded_by")]
    numbers = [one("version").try_cast("int").alias("version"), one("access_count").try_cast("int").alias("access_count"), F.coalesce(one("schema_version"), one("schema")).try_cast("int").alias("schema_version")]
    return [*words, tags.alias("tags"), *numbers, *stamps]


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(place, id, question) of lines ``id<TAB>question`` or ``question``; # starts a comment. Ids are made q1, q2 where absent and numbered where repeated."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("at", "line"))
    kept = lines.where((F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#")))
    kept = kept.withColumn("place", F.row_number().over(Window.orderBy("at")))  # one small file
    tab = F.contains("line", F.lit("\t"))
    named = F.when(tab, text.question_slug(F.split_part("line", F.lit("\t"), F.lit(1)))).otherwise(F.concat(F.lit("q"), "place"))
    asked = kept.select("place", named.alias("base"), F.trim(F.when(tab, F.regexp_extract("line", r"^[^\t]*\t(.*)$", 1)).otherwise(F.col("line"))).alias("question"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("place"))
    return asked.withColumn("nth", nth).select("place", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "nth")).alias("id"), "question")


def write_plan(ranked: DataFrame, path: str) -> None:
    ranked.select("source", "served", "cited").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plan, dropped): rows of a plan with malformed counts as 0, and how many rows had no source."""
    raw = spark.read.option("sep", "\t").option("header", "true").schema("source string, served string, cited string").csv(path)
    count = lambda c: F.greatest(F.coalesce(F.col(c).try_cast("long"), F.lit(0)), F.lit(0)).alias(c)
    ok = F.coalesce(F.trim("source"), F.lit("")) != ""
    return raw.where(ok).select("source", count("served"), count("cited")), raw.where(~ok).agg(F.count(F.lit(1)).alias("dropped"))


# --- Archives and documents


def members_of(name: str, data: bytes, most: int = fixed.MEMBER_LIMIT) -> list[tuple[str, int, str]]:
    """(member, size, kind) of an archive by its content: zip, tar (also compressed) or one compressed file; at most ``most``, as listings are bounded."""
    stream = io.BytesIO(data)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as z:
            return [(i.filename, i.file_size, "dir" if i.is_dir() else "file") for i in z.infolist()[:most]]
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            found = []
            for m in t:
                found.append((m.name, m.size, "dir" if m.isdir() else "file"))
                if len(found) >= most:
                    break
            return found
    except (tarfile.TarError, EOFError, OSError, lzma.LZMAError):
        pass
    for start, opened in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if data.startswith(start):
            stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0] or name
            return [(stem, len(opened(data)), "file")]
    return []


def list_archives(files: DataFrame) -> DataFrame:
    """(container, member, size, kind, note) of rows (raw, name, content); a damaged container gives one row with a note."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for raw, name, content in zip(frame["raw"], frame["name"], frame["content"], strict=True):
                try:
                    rows += [(raw, *m, None) for m in members_of(name or "", bytes(content or b""))]
                except (zipfile.BadZipFile, OSError, EOFError, ValueError, lzma.LZMAError) as error:
                    rows.append((raw, None, None, None, f"damaged: {type(error).__name__}"))
            yield pd.DataFrame(rows, columns=["container", "member", "size", "kind", "note"])

    return files.select("raw", "name", "content").mapInPandas(run, "container binary, member string, size long, kind string, note string")


def document_parts(files: DataFrame) -> DataFrame:
    """(raw, parts): the XML of the text members of office and book files, in order; an empty array where there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for content in frame["content"]:
                found = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as z:
                        wanted = sorted(n for n in z.namelist() if n.startswith(TEXT_MEMBERS) and n.endswith((".xml", ".html", ".xhtml", ".htm")))
                        found = [z.read(n).decode("utf-8", "replace") for n in wanted[:MOST_TEXT_MEMBERS]]
                except (zipfile.BadZipFile, KeyError, OSError):
                    pass
                parts.append(found)
            yield pd.DataFrame({"raw": frame["raw"], "parts": parts})

    return files.select("raw", "content").mapInPandas(run, "raw binary, parts array<string>")


def document_text(files: DataFrame) -> DataFrame:
    """(raw, text, note): the words of office and book files; 'needs_ocr' where there are none."""
    words = document_parts(files).select("raw", F.array_join(F.filter(F.transform("parts", text.markup_to_text), lambda x: x != ""), "\n").alias("text"))
    return words.withColumn("note", F.when(F.col("text") == "", "needs_ocr"))


def model_ids(payload: DataFrame) -> DataFrame:
    """(id): the models that a /models reply (column ``value``) names as loaded or loading; none where it does not say, which means unknown."""
    parsed = payload.select(F.from_json("value", "data array<struct<id:string,status:string>>").alias("p"))
    rows = parsed.select(F.explode("p.data").alias("m")).select("m.id", F.lower(F.coalesce(F.get_json_object("m.status", "$.value"), F.col("m.status"))).alias("state"))
    return rows.where(F.col("state").isin("loaded", "loading") & (F.coalesce("id", F.lit("")) != "")).select("id")


def resident_conflict(loaded: DataFrame, wanted: str) -> DataFrame:
    """(n, others): the models beside ``wanted`` that a box holds, by name; no row where none is in the way."""
    others = loaded.where(F.col("id") != wanted).agg(F.array_sort(F.collect_set("id")).alias("others"))
    return others.where(F.size("others") > 0).select(F.size("others").alias("n"), "others")


def select_questions(asked: DataFrame, pick: str) -> DataFrame:
    """Questions at a 1-based place, if ``pick`` is a number, or whose id holds it."""
    return asked.where(F.col("place") == int(pick)) if pick.isdigit() else asked.where(F.contains("id", F.lit(pick)))


def append_lines(events: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, with nulls left out; a failed task leaves no half line."""
    events.write.mode("append").json(path)


def write_questions(asked: DataFrame, path: str) -> None:
    asked.orderBy("place").select("id", "question").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


# --- Fixed values. Media types by ending.
MEDIA_TYPES = {".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".json": "application/json", ".pdf": "application/pdf", ".zip": "application/zip", ".png": "image/png", ".jpg": "image/jpeg", ".gif": "image/gif", ".mp3": "audio/mpeg", ".mp4": "video/mp4"}


def media_type(path: Column) -> Column:
    """A guess by the name's ending; null where it says nothing."""
    return F.coalesce(*[F.when(text.ending(path) == e, F.lit(t)) for e, t in MEDIA_TYPES.items()])
