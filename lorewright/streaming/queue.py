"""The task queue as a stream: a usage limit pauses it, a timer resumes it.

The key is the queue; its state is a status per task and how long nothing is taken.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import state
from ..operators.state import PAUSE_MINUTES, next_state

CHANGES = "queue string, source_path string, status string, retry_count long, seq long, pauses long"
#: What ``paused_until`` is while a queue waits for somebody to resume it.
FOREVER = 1 << 62


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """A session whose streams start with the state store that state processors need; as it was, afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Queue(StatefulProcessor):
    """Folds a queue's events in the order of time and ``seq``; see ``run``."""

    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "source_path string", "status string, retry long")
        self.pause = handle.getValueState("pause", "until long, pauses long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, pauses = self.pause.get() if self.pause.exists() else (None, 0)
        events = pd.concat(list(rows)).sort_values(["ms", "seq"])
        held = {k[0]: tuple(v) for k, v in self.tasks.iterator()}
        before, last = dict(held), {}

        def moved(path: str, status: str, retry: int, seq: int) -> None:
            held[path] = (status, retry)
            last[path] = seq

        def put_back(seq: int) -> None:
            for path, (status, retry) in list(held.items()):
                if status == "processing":
                    moved(path, "pending", retry, seq)

        resumed = []
        for ms, seq, path, event in zip(events["ms"].tolist(), events["seq"].tolist(), events["source_path"].tolist(), events["event"].tolist(), strict=True):
            if until is not None and ms >= until:
                until = None
                resumed.append(seq)
            if event == "pause":
                put_back(seq)
                until, pauses = FOREVER, pauses + 1
            elif event == "resume":
                until = None
            elif path is not None and not (event == "take" and until is not None):
                status, retry = held.get(path, ("none", 0))
                if event == "limit" and status == "processing":
                    put_back(seq)
                    until, pauses = ms + self.pause_ms, pauses + 1
                else:
                    new = next_state(status, retry, event)
                    if new != (status, retry) or path not in held:
                        moved(path, *new, seq)
        for path in last:
            if held[path] != before.get(path):
                self.tasks.updateValue((path,), held[path])
        self.pause.update((until, pauses))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None and until < FOREVER:
            self.handle.registerTimer(until)
        yield pd.DataFrame([(key[0], p, *held[p], seq, pauses) for p, seq in last.items()], columns=["queue", "source_path", "status", "retry_count", "seq", "pauses"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, pauses = self.pause.get() if self.pause.exists() else (None, 0)
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.pause.update((None, pauses))
            yield pd.DataFrame([(key[0], None, "resumed", 0, None, pauses)], columns=["queue", "source_path", "status", "retry_count", "seq", "pauses"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def run(events: DataFrame, minutes: int = PAUSE_MINUTES, clock: str = "EventTime") -> DataFrame:
    """Changes of tasks (``queue``, ``source_path``, ``status``, ``retry_count``, ``seq``, ``pauses``) as events come.

    ``events`` is a stream with ``queue``, ``seq``, ``at``, ``source_path`` and
    ``event``, with a watermark on ``at`` if ``clock`` is EventTime; with
    ProcessingTime pauses end by the wall clock.  Beside the events of
    ``next_state`` there are ``pause`` and ``resume``, of the queue as a whole.  A
    usage limit of a task in work puts all work of its queue back, without
    counting as a failure, and nothing is taken for so many minutes; then a timer
    resumes the queue and tells so by a row without a task and ``seq``.

    A task's row says what it is after the batch, and ``seq`` which event made it
    so; the newest row of each task is its state.  A batch's events of one queue are
    put in order in one task, so files of a batch bound them.
    """
    # The process that starts a state processor may not find this package, so its code goes along.
    for module in (sys.modules[__name__], state):
        cloudpickle.register_pickle_by_value(module)
    keyed = events.select("queue", "seq", (F.unix_micros(F.col("at")) / 1000).cast("long").alias("ms"), "source_path", "event", *(["at"] if clock == "EventTime" else []))
    return keyed.groupBy("queue").transformWithStateInPandas(Queue(minutes * 60_000), CHANGES, "Update", clock)


def final_states(changes: DataFrame) -> DataFrame:
    """(``queue``, ``source_path``, ``status``, ``retry_count``): the newest of each task."""
    return changes.where("source_path is not null").groupBy("queue", "source_path").agg(F.max_by("status", "seq").alias("status"), F.max_by("retry_count", "seq").alias("retry_count"))
