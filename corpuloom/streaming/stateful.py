"""Streams with a state for each key and event-time timers: the work queue, locks, time limits of cells.

Each is a processor of Spark's ``transformWithState``. A key's rows of a batch
are taken in the order of their times, and whatever a timer would have told
before a row's time is told first, so that results do not depend on how rows fall
into batches; a timer tells it once no row comes any more. The session must keep
states in RocksDB (:func:`store_states`). Late rows, behind the watermark, are
dropped by Spark.

A table is one batch without timers: Spark sorts its rows by key and time, and
the same steps are taken row by row, so a task holds one key's state and no
key's rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PENDING, DONE, FAILED, SKIPPED = "pending", "done", "failed", "skipped"
FINISHED = (DONE, FAILED, SKIPPED)
#: Silent seconds after which another worker may take a lock over.
STALE_SECONDS = 300


def store_states(spark: SparkSession) -> None:
    """Makes a session keep states where timers and several columns of state can be, for streams and, as these need the streams' coordinator too, for tables."""
    spark.streams.active  # noqa: B018
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(at: datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


class _Processor(StatefulProcessor):
    """Rows carry ``millis``, their time, and ``n``, their order among equal times."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        old = self.due(held)
        for row in sorted(rows, key=lambda r: (r["millis"], r["n"])):
            held, told = self.late(key, held, row["millis"])
            yield from told
            held, told = self.step(key, held, row)
            yield from told
        self._keep(held, old)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        if held is not None and self.due(held) == expiredTimerInfo.getExpiryTimeInMs():
            held, told = self.late(key, held, self.due(held))
            yield from told
            self._keep(held, None)

    def _keep(self, held: tuple | None, old: int | None) -> None:
        due = self.due(held)
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if due is not None and due != old:
            self.handle.registerTimer(due)
        if held is None:
            self.state.clear()
        else:
            self.state.update(tuple(held))

    def due(self, held: tuple | None) -> int | None:
        """When the state changes by itself."""
        return None

    def late(self, key: tuple, held: tuple | None, now: int) -> tuple[tuple | None, list[Row]]:
        """The state and rows after what was due by ``now``."""
        return held, []

    def step(self, key: tuple, held: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _run(rows: DataFrame, keys: list[str], processor: _Processor, out: str, ts: str, delay: str, order: str | None) -> DataFrame:
    rows = rows.withColumn("millis", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("n", F.lit(0).cast("long") if order is None else F.col(order).cast("long"))
    rows = rows.where(F.col("millis").isNotNull())
    if rows.isStreaming:
        told = rows.withWatermark(ts, delay).groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")
    else:
        told = _ordered(rows.drop(ts), keys, processor, out)
    return told.withColumn("at", F.timestamp_millis("millis")).drop("millis")


def _ordered(rows: DataFrame, keys: list[str], processor: _Processor, out: str) -> DataFrame:
    """What a processor tells of a table's rows, by key and in the order of their times."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few bytes of much work would be put together
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys, "millis", "n")
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in out.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            told: list[Row] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, held = key, None
                held, rows_ = processor.late(key, held, row["millis"])
                told += rows_
                held, rows_ = processor.step(key, held, row)
                told += rows_
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(run, out)


# --- The work queue


class _Queue(_Processor):
    schema = "state string, attempts int, note string"

    def step(self, key: tuple, held: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        raw, task = key
        event, note, was = row["event"], row["note"], held and held[0]
        made = None
        if event == "add":
            made = (PENDING, 0, None) if held is None else held
        elif event in FINISHED and was == PENDING:
            made = (event, held[1] + 1, note)
        elif event == "retry" and was == FAILED:
            made = (PENDING, held[1], held[2])
        elif event == "reopen" and was == SKIPPED and held[2] == note:
            made = (PENDING, held[1], None)
        legal = made is not None
        now = made if legal else held
        told = [Row(raw=raw, task=task, event=event, was=was, now=now and now[0], attempts=now and now[1], note=now and now[2], legal=legal, millis=row["millis"])]
        if legal and event == DONE:
            told += [Row(raw=raw, task=t, event="add", was=None, now=None, attempts=None, note=None, legal=True, millis=row["millis"]) for t in row["follow"] or ()]
        return now, told


def queue(events: DataFrame, ts: str = "at", delay: str = "1 hour", order: str | None = None) -> DataFrame:
    """(raw, task, event, was, now, attempts, note, legal, at): every event on a queue row, with the state before and after.

    ``events`` has raw, task, event, note and follow (an array of task names).
    ``add`` puts a row in once and leaves one that is there; ``done``, ``failed``
    and ``skipped`` finish a pending row and count an attempt; ``retry`` puts a
    failed row back, ``reopen`` a skipped one whose note is the event's. Any
    other event on any other state changes nothing and is told with ``legal``
    false. A row that is done adds its follow-on tasks: rows of event ``add``
    and no state, to be put into the queue's own folder. Rows without a time are
    left out; a null key is a key.
    """
    out = "raw string, task string, event string, was string, now string, attempts int, note string, legal boolean, millis long"
    return _run(events, ["raw", "task"], _Queue(), out, ts, delay, order)


# --- Locks


class _Lock(_Processor):
    schema = "worker string, beat long, told boolean"

    def __init__(self, stale: int) -> None:
        self.stale = stale * 1000

    def due(self, held: tuple | None) -> int | None:
        return None if held is None or held[2] else held[1] + self.stale

    def late(self, key: tuple, held: tuple | None, now: int) -> tuple[tuple | None, list[Row]]:
        due = self.due(held)
        if due is None or due > now:
            return held, []
        return (held[0], held[1], True), [self._row(key, held[0], "stale", due)]

    def step(self, key: tuple, held: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        worker, event, at = row["worker"], row["event"], row["millis"]
        mine = held is not None and held[0] == worker
        if event == "acquire":
            if held is None or held[2]:
                return (worker, at, False), [self._row(key, worker, "taken" if held is None else "taken over", at)]
            return held, [self._row(key, worker, "refused", at)]
        if event == "beat" and mine:
            return (worker, at, False), []
        if event == "release" and mine:
            return None, [self._row(key, worker, "released", at)]
        return held, [self._row(key, worker, "not held", at)]

    @staticmethod
    def _row(key: tuple, worker: str, event: str, at: int) -> Row:
        return Row(lock=key[0], worker=worker, event=event, millis=at)


def locks(events: DataFrame, stale: int = STALE_SECONDS, ts: str = "at", delay: str = "1 minute", order: str | None = None) -> DataFrame:
    """(lock, worker, event, at): what becomes of each lock.

    ``events`` has lock, worker and event: ``acquire``, ``beat`` or ``release``.
    A lock is taken if it is free, refused while its holder is alive, and taken
    over once that has been silent for ``stale`` seconds, which is told as
    ``stale`` when it happens. A beat after that, before anyone took over,
    brings the holder back. Beats and releases of others are ``not held``.
    """
    return _run(events, ["lock"], _Lock(stale), "lock string, worker string, event string, millis long", ts, delay, order)


# --- Time limits


class _Cell(_Processor):
    schema = "started long, requests int, extended boolean, over boolean"

    def __init__(self, soft: int, hard: int) -> None:
        self.soft, self.hard = soft * 1000, hard * 1000

    def due(self, held: tuple | None) -> int | None:
        return None if held is None or held[3] else held[0] + (self.hard if held[2] else self.soft)

    def late(self, key: tuple, held: tuple | None, now: int) -> tuple[tuple | None, list[Row]]:
        told = []
        while (due := self.due(held)) is not None and due <= now:
            started, requests, extended, _ = held
            if not extended and requests and self.hard > self.soft:
                held = (started, requests, True, False)
                told.append(self._row(key, "extended", due, held))
            else:
                held = (started, requests, extended, True)
                told.append(self._row(key, "hard limit" if extended else "soft limit", due, held))
        return held, told

    def step(self, key: tuple, held: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        event, at = row["event"], row["millis"]
        if event == "start" and held is None:
            return (at, 0, False, False), []
        if held is None or event == "start":
            return held, [self._row(key, "unexpected", at, held)]
        if held[3]:
            return held, [self._row(key, "discarded", at, held)]
        if event == "request":
            return (held[0], held[1] + 1, held[2], False), []
        done = (held[0], held[1], held[2], True)
        return done, [self._row(key, "result", at, done)]

    @staticmethod
    def _row(key: tuple, event: str, at: int, held: tuple | None) -> Row:
        return Row(run=key[0], cell=key[1], event=event, requests=held[1] if held else 0, seconds=(at - held[0]) / 1000 if held else None, millis=at)


def cells(events: DataFrame, soft: int = 60, hard: int = 600, ts: str = "at", delay: str = "1 minute", order: str | None = None) -> DataFrame:
    """(run, cell, event, requests, seconds, at): how each cell ends.

    ``events`` has run, cell and event: ``start``, ``request`` or ``result``. At
    ``soft`` seconds a cell that has asked for nothing is stopped (``soft
    limit``); one that has is ``extended`` to ``hard`` seconds, and stopped then
    (``hard limit``). A single limit (hard <= soft) extends nothing. What comes
    after the end is ``discarded``; a second start, or anything before the
    first, is ``unexpected``.
    """
    out = "run string, cell long, event string, requests int, seconds double, millis long"
    return _run(events, ["run", "cell"], _Cell(soft, hard), out, ts, delay, order)
