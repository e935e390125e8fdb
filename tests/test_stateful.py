"""Stateful streams: results do not depend on batches, restarts or timers."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuloom.streaming import stateful

START = datetime(2026, 1, 1)


def streamed(spark, tmp_path, batches, schema, make):
    """The rows that a stream gives, restarted after each batch."""
    stateful.store_states(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps({**r, "at": (START + timedelta(seconds=r["at"])).isoformat()}) + "\n" for r in rows))
        events = spark.readStream.schema(schema).json(f"file://{source}")
        q = make(events).writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(f"file://{out}").withColumn("t", (F.unix_millis("at") / 1000 - F.lit(START.timestamp())).cast("double"))
    return rows.drop("at").collect()


def cut(rows, seed, n):
    """Rows by time, dealt into n batches without going back in time."""
    r = random.Random(seed)
    marks = sorted(r.randrange(len(rows) + 1) for _ in range(n - 1))
    return [rows[a:b] for a, b in zip([0, *marks], [*marks, len(rows)], strict=True)]


QUEUE = "raw string, task string, event string, note string, follow array<string>, at timestamp, n long"


def slow_queue(rows):
    held, out = {}, []
    for x in rows:
        k = (x["raw"], x["task"])
        was, event = held.get(k), x["event"]
        now = was
        legal = True
        if event == "add":
            now = was or ("pending", 0, None)
        elif event in ("done", "failed", "skipped") and was and was[0] == "pending":
            now = (event, was[1] + 1, x["note"])
        elif event == "retry" and was and was[0] == "failed":
            now = ("pending", was[1], was[2])
        elif event == "reopen" and was and was[0] == "skipped" and was[2] == x["note"]:
            now = ("pending", was[1], None)
        else:
            legal = False
        if now:
            held[k] = now
        out.append((*k, event, was and was[0], *(now or (None, None, None)), legal))
        if legal and event == "done":
            out += [(x["raw"], t, "add", None, None, None, None, True) for t in x["follow"] or ()]
    return out, held


@pytest.mark.parametrize("batches", [1, 3])
def test_the_queue_is_a_state_machine(spark, tmp_path, batches):
    r = random.Random(7)
    rows = []
    for i in range(160):
        event = r.choice(["add", "add", "done", "failed", "skipped", "retry", "reopen", "nonsense"])
        rows.append({"raw": r.choice("ab"), "task": r.choice(["list", "text"]), "event": event, "note": r.choice(["x", "y", None]), "follow": ["text", "index"] if r.random() < 0.8 else None, "at": i * 10, "n": i})
    got = streamed(spark, tmp_path, cut(rows, 1, batches), QUEUE, lambda e: stateful.queue(e, delay="0 seconds", order="n"))
    want, _ = slow_queue(rows)
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x[c] for c in ("raw", "task", "event", "was", "now", "attempts", "note", "legal")) for x in got), key=key) == sorted(want, key=key)
    assert {x["legal"] for x in got} == {True, False} and any(x["task"] == "index" for x in got)


LOCK = "lock string, worker string, event string, at timestamp, n long"


def test_locks_are_taken_over_when_they_are_stale(spark, tmp_path):
    events = [("l", "a", "acquire", 0), ("l", "b", "acquire", 10), ("l", "a", "beat", 250), ("l", "b", "acquire", 310), ("l", "b", "acquire", 550), ("l", "a", "beat", 560), ("l", "b", "release", 570), ("l", "c", "acquire", 571), ("l", "c", "release", 580),
              ("m", "x", "acquire", 590), ("m", "x", "beat", 900), ("m", "y", "acquire", 1000), ("z", "w", "acquire", 5000)]
    rows = [{"lock": a, "worker": b, "event": c, "at": t, "n": i} for i, (a, b, c, t) in enumerate(events)]
    want = sorted([
        ("l", "a", "taken", 0), ("l", "b", "refused", 10), ("l", "b", "refused", 310), ("l", "a", "stale", 550), ("l", "b", "taken over", 550), ("l", "a", "not held", 560), ("l", "b", "released", 570), ("l", "c", "taken", 571), ("l", "c", "released", 580),
        ("m", "x", "taken", 590), ("m", "x", "stale", 890), ("m", "y", "refused", 1000), ("m", "x", "stale", 1200), ("z", "w", "taken", 5000),
    ])
    for seed, n in ((1, 1), (2, 4)):
        where = tmp_path / str(n)
        where.mkdir()
        batches = [*cut(rows, seed, n), [{"lock": "last", "worker": "q", "event": "acquire", "at": 6000, "n": 99}]]
        got = streamed(spark, where, batches, LOCK, lambda e: stateful.locks(e, delay="0 seconds", order="n"))
        told = sorted((x["lock"], x["worker"], x["event"], x["t"]) for x in got if x["lock"] != "last" and not (x["lock"] == "z" and x["event"] == "stale"))
        assert told == want


CELL = "run string, cell long, event string, at timestamp, n long"


@pytest.mark.parametrize("batches", [1, 3])
def test_cells_are_stopped_or_extended(spark, tmp_path, batches):
    events = [("r", 1, "start", 0), ("r", 1, "result", 59), ("r", 2, "start", 100), ("r", 2, "result", 161), ("r", 3, "start", 200), ("r", 3, "request", 210), ("r", 3, "result", 500), ("r", 4, "start", 600), ("r", 4, "request", 659), ("r", 4, "request", 1100),
              ("r", 4, "result", 1201), ("r", 5, "request", 1300), ("r", 6, "start", 1400), ("r", 6, "start", 1401), ("r", 7, "start", 1500), ("r", 7, "request", 1501)]
    rows = [{"run": a, "cell": b, "event": c, "at": t, "n": i} for i, (a, b, c, t) in enumerate(events)]
    want = [
        (1, "result", 0, 59.0, 59), (2, "soft limit", 0, 60.0, 160), (2, "discarded", 0, 61.0, 161), (3, "extended", 1, 60.0, 260), (3, "result", 1, 300.0, 500), (4, "extended", 1, 60.0, 660), (4, "hard limit", 2, 600.0, 1200), (4, "discarded", 2, 601.0, 1201),
        (5, "unexpected", 0, None, 1300), (6, "unexpected", 0, 1.0, 1401), (6, "soft limit", 0, 60.0, 1460), (7, "extended", 1, 60.0, 1560), (7, "hard limit", 1, 600.0, 2100),
    ]
    late = [[{"run": "last", "cell": i, "event": "result", "at": 9000 + 9 * i, "n": 99}] for i in range(2)]
    got = streamed(spark, tmp_path, [*cut(rows, 3, batches), *late], CELL, lambda e: stateful.cells(e, delay="0 seconds", order="n"))
    assert sorted((x["cell"], x["event"], x["requests"], x["seconds"], x["t"]) for x in got if x["run"] == "r") == sorted(want, key=lambda x: (x[0], x[1]))


def test_a_table_is_taken_row_by_row(spark):
    """A key's rows are sorted by Spark, not held by a task, and nothing is kept in a state store."""
    rows = [(None if i % 7 == 0 else "ab"[i % 2], "vw"[i % 3 % 2], ("acquire", "beat", "release")[i * 5 % 3], START + timedelta(seconds=i * 97 % 4001), i) for i in range(400)]
    events = spark.createDataFrame(rows, "lock string, worker string, event string, at timestamp, n long")
    found = stateful.locks(events, order="n")
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "TransformWithState" not in plan
    want = []
    for lock in ("a", "b", None):
        held, step = None, stateful._Lock(stateful.STALE_SECONDS)
        for r in sorted((r for r in rows if r[0] == lock), key=lambda r: r[3:]):
            row = {"worker": r[1], "event": r[2], "millis": stateful._millis(r[3])}
            held, told = step.late((lock,), held, row["millis"])
            want += told
            held, told = step.step((lock,), held, row)
            want += told
    got = sorted((repr(r["lock"]), r["worker"], r["event"], stateful._millis(r["at"])) for r in found.collect())
    assert got == sorted((repr(r["lock"]), r["worker"], r["event"], r["millis"]) for r in want)
    assert stateful.locks(events.limit(0), order="n").count() == 0
