"""Streams: event logs, the work queue, sessions and windows, calls in flight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def event_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of a folder of JSON lines as they are appended; torn lines are dropped here and counted by the batch reader."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    parsed = reader.load(path).select(F.from_json("value", schemas.EVENTS).alias("e")).where(F.col("e.event").isNotNull())
    return parsed.select("e.*").withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions that a silence longer than ``gap`` ends; works on streams and tables alike."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, keys: list[str], size: str, slide: str | None = None, ts: str = "ts", delay: str = "10 minutes", measures: list[Column] | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows with a count and further measures."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *(measures or []))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def in_flight(starts: DataFrame, ends: DataFrame, keys: list[str], ts: str = "ts", most: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Starts with their end, or with none after ``most``: a left outer join in event time."""
    a, b = starts.alias("a"), ends.alias("b")
    if starts.isStreaming:
        a, b = starts.withWatermark(ts, delay).alias("a"), ends.withWatermark(ts, delay).alias("b")
    on = F.col(f"b.{ts}").between(F.col(f"a.{ts}"), F.col(f"a.{ts}") + F.expr(f"INTERVAL {most}"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, on, "left").select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{ts}").alias("started"), F.col(f"b.{ts}").alias("ended"))


def once(prompts: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: a memo for calls of a stream."""
    return prompts.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if prompts.isStreaming else prompts.dropDuplicates([key])


def work(queue: DataFrame, handler: Callable[[DataFrame], DataFrame], outcomes: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Runs a stream of queue rows through ``handler`` and appends what it gives to ``outcomes``.

    Rows with an outcome are left out, so a batch that is repeated after a
    failure writes nothing twice: the checkpoint repeats a batch with the same
    number, and each batch overwrites its own folder. All that has arrived is
    taken, then the run ends; a budget or pause is a matter of when to start
    the next run.
    """

    def batch(rows: DataFrame, number: int) -> None:
        done = handler(rows)
        done.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{outcomes}/batch={number:08d}")
        if on_batch:
            on_batch(rows, number)

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(changes: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """The last state of each key: for a table; a stream keeps it by :func:`stateful_states`."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct("state", "attempts", "note"), order).alias("last"), F.max(order).alias(order)).select(*keys, "last.*", order)


def stateful_states(changes: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """(keys, state, order) after each batch in update mode: an aggregate whose state is one row a key."""
    return changes.groupBy(*keys).agg(F.max_by("state", order).alias("state"), F.max(order).alias(order))


def lock_holder(beats: DataFrame, now: float, stale: float = 300.0) -> DataFrame:
    """(worker, age, held): the last worker that gave a sign of life, and whether its lock still holds: after ``stale`` silent seconds another may take over."""
    last = beats.agg(F.max_by("worker", "beat").alias("worker"), F.max("beat").alias("beat"))
    return last.select("worker", (F.lit(now) - F.col("beat")).alias("age"), F.coalesce(F.lit(now) - F.col("beat") <= stale, F.lit(False)).alias("held"))
