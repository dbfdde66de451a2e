"""The queue's stream against a fold with a clock."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorewright.operators.state import EVENTS, next_state
from lorewright.streaming import jobs, queue

KIND = "queue string, seq long, at timestamp, source_path string, event string"
START = datetime(2024, 1, 1)


def fold(rows: list[tuple], minutes: int) -> set[tuple]:
    """Plainly: one event after the other, each at its time."""
    tasks, until = {}, {}
    for q, _, at, path, event in sorted(rows, key=lambda r: (r[2], r[1])):
        if until.get(q) and at >= until[q]:
            until[q] = None
        if event == "resume":
            until[q] = None
        elif event == "pause" or event == "limit" and tasks.get((q, path), ("none", 0))[0] == "processing":
            for k, (s, r) in tasks.items():
                if k[0] == q and s == "processing":
                    tasks[k] = ("pending", r)
            until[q] = datetime.max if event == "pause" else at + timedelta(minutes=minutes)
        elif path is not None and not (event == "take" and until.get(q)):
            tasks[q, path] = next_state(*tasks.get((q, path), ("none", 0)), event)
    return {(*k, *v) for k, v in tasks.items()}


def made(seed: int, n: int) -> list[tuple]:
    pick, out, at = random.Random(seed), [], START
    for seq in range(n):
        at += timedelta(seconds=pick.choice([0, 5, 20, 60, 300]))
        event = pick.choice([*EVENTS, *["enqueue", "take", "take", "complete", "limit"] * 2, "pause", "resume", "resume", "odd"])
        out.append((f"q{pick.randrange(3)}", seq, at, None if event in ("pause", "resume") else f"p{pick.randrange(4)}", event))
    return out


def stream(spark, folder, files_each=1):
    rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", files_each).parquet(folder)
    return rows.withWatermark("at", "1 minute")


def test_queue_is_a_fold_with_a_clock(spark, tmp_path):
    """In several batches, each out of order within; pauses hold across batches."""
    rows = made(1, 900)
    for k in range(0, 900, 180):
        batch = rows[k : k + 180]
        random.Random(k).shuffle(batch)
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with queue.rocksdb_state(spark):
        changes = jobs.run_to_end(queue.run(stream(spark, str(tmp_path / "in")), 15), "update")
    assert {tuple(r) for r in queue.final_states(changes).collect()} == fold(rows, 15)
    assert any(fold(rows[:n], 15) != fold(rows[:n], 0) for n in range(900))


def test_a_timer_resumes_the_queue(spark, tmp_path):
    """No event of the queue comes after the limit; the watermark of another's does it."""
    at = lambda m: START + timedelta(minutes=m)
    rows = [[("a", 1, at(0), "x", "enqueue"), ("a", 2, at(1), "x", "take"), ("a", 3, at(1), "y", "enqueue"), ("a", 4, at(2), "y", "take"), ("a", 5, at(3), "x", "limit"), ("a", 6, at(4), "y", "take")], [("b", 7, at(60), "z", "enqueue")], [("b", 8, at(61), "z", "take")]]
    for batch in rows:
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with queue.rocksdb_state(spark):
        changes = jobs.run_to_end(queue.run(stream(spark, str(tmp_path / "in"))), "update")
    assert {tuple(r) for r in queue.final_states(changes).collect()} == {("a", "x", "pending", 0), ("a", "y", "pending", 0), ("b", "z", "processing", 0)}
    resumed = changes.where(F.col("source_path").isNull()).select("queue", "status", "pauses").collect()
    assert [tuple(r) for r in resumed] == [("a", "resumed", 1)]


def test_the_provider_is_put_back(spark):
    before = spark.conf.get(queue.PROVIDER, None)
    with queue.rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(queue.PROVIDER)
    assert spark.conf.get(queue.PROVIDER, None) == before


def test_engine_works_its_queue(spark, tmp_path):
    """Takes the oldest, tells what became of each, waits after a usage limit, takes back what was left."""
    from lorewright.engine import Engine

    limited = [True]

    def model(text: str) -> str:
        if "limited" in text and limited[0]:
            raise RuntimeError("429 too many requests")
        if "empty" in text:
            return "nothing"
        name = text.split()[0]
        return f"---FILE: knowledge/concepts/{name}.md---\n---\ntype: concept\n---\n{text}\n---END FILE---"

    engine = Engine(spark, str(tmp_path), model)
    texts = ["one text", "two empty", "three limited", "four text"]
    engine.ingest(spark.createDataFrame([("web", n, t) for n, t in enumerate(texts)], "source string, seq long, content string"))
    ids = {r["content"].split()[0]: r["id"] for r in engine.materials().collect()}
    engine.enqueue(spark.createDataFrame([(ids[t.split()[0]], n, "enqueue") for n, t in enumerate(texts)], "source_path string, seq long, event string"))
    states = lambda: {name: next(r["status"] for r in engine.tasks().collect() if r["source_path"] == i) for name, i in ids.items()}
    assert engine.work("2030-01-01", START, limit=2) == {"complete": 1, "fail": 1}
    assert states() == {"one": "done", "two": "pending", "three": "pending", "four": "pending"}
    # A run that took a task and did not end.
    engine.enqueue(spark.createDataFrame([(ids["four"], 50, "take")], "source_path string, seq long, event string"))
    assert engine.work("2030-01-01", START, limit=3) == {"complete": 1, "fail": 1, "limit": 1}
    assert states() == {"one": "done", "two": "pending", "three": "pending", "four": "done"}
    assert engine.work("2030-01-01", START + timedelta(minutes=14)) == {"paused": 1}
    limited[0] = False
    again = Engine(spark, str(tmp_path), lambda text: model(text.replace("limited", "fine")))
    assert again.work("2030-01-01", START + timedelta(minutes=15)) == {"complete": 1, "fail": 1}
    assert states() == {"one": "done", "two": "failed", "three": "done", "four": "done"}
    assert again.work("2030-01-01", START + timedelta(minutes=16)) == {}
