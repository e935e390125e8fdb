"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent on one machine alone (tests, a laptop) a
    temporary folder is chosen once per application; a cluster must name its
    own, as its executors' temporary folders are not shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark.sparkContext, "_corpuloom_shared", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
            where = tempfile.mkdtemp(prefix="corpuloom-")
            spark.sparkContext._corpuloom_shared = where
    return where.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpuloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage without keeping blocks on executors, so a lost executor
    costs only its running tasks.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corpuloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """128-bit content key of a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``: the remainder that deals rows into folds. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_fold(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def whole(values: list | None, scale: int, limit: int) -> np.ndarray | None:
    """The vector times ``scale``, rounded down, as 64-bit integers; none if it is null or empty, holds a null or non-finite component, or its squared norm passes ``limit``."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all():
        return None
    with np.errstate(over="ignore"):
        v = np.floor(v * scale)
        return v.astype(np.int64) if v @ v <= limit else None


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about ``max_bytes`` of ``column`` each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + n > max_bytes:
            yield at, i
            at, total = i, 0
        total += n
    if lengths:
        yield at, len(lengths)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` of a partition sorted by them, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, row
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
