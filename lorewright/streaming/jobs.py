"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators.state import next_state

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, delay: str = "31 days", files_each: int | None = None) -> DataFrame:
    """Events with ``at``, a timestamp that the watermark is on.

    By default the delay covers the whole span of a replay, so no row comes late;
    with a shorter one rows that come later than it are dropped by stateful
    operators.  ``files_each`` is how many files a batch takes.
    """
    reader = spark.readStream.schema(EVENTS)
    rows = (reader if files_each is None else reader.option("maxFilesPerTrigger", files_each)).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return _windowed(events, F.window("at", width))


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return _windowed(events, F.window("at", width, step))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return _windowed(events, F.session_window("at", gap), "user_id")


def _windowed(events: DataFrame, window, *keys: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("event_id")
    last = state.get[0] if state.exists else None
    out = []
    for event, value in zip(rows["event_id"], rows["event_type"], strict=True):
        if last is not None and value != last:
            out.append((key[0], event, value))
        last = value
    state.update((last,))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])


def value_changes(events: DataFrame) -> DataFrame:
    """Events whose type differs from the user's one before; the first is a baseline.

    State is one value per user.
    """
    return events.groupBy("user_id").applyInPandasWithState(_changed, "user_id long, event_id long, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)


def _task(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, retry, n = state.get if state.exists else ("none", 0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    for event in rows["event"]:
        status, retry = next_state(status, retry, event)
    n += len(rows)
    state.update((status, retry, n))
    yield pd.DataFrame([(key[0], status, retry, n)], columns=["source_path", "status", "retry_count", "n_events"])


def task_states(events: DataFrame) -> DataFrame:
    """(source_path, status, retry_count, n_events) after each micro-batch."""
    return events.groupBy("source_path").applyInPandasWithState(_task, "source_path string, status string, retry_count long, n_events long", "status string, retry long, n long", "update", GroupStateTimeout.NoTimeout)


def new_contents(stream: DataFrame, text: str = "value") -> DataFrame:
    """The first row of each content; state holds the hashes."""
    return stream.withColumn("hash", X.content_hash(X.strip(F.col(text)))).dropDuplicates(["hash"])


class Progress(StreamingQueryListener):
    """Tells ``report(name, batch, rows)`` of each batch, and ``failed(name, error)`` of a stream that ends by one."""

    def __init__(self, report: Callable[[str, int, int], None], failed: Callable[[str, str], None] = lambda name, error: None):
        self.report, self.failed, self.names = report, failed, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        self.report(event.progress.name or str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed(self.names.get(str(event.id), str(event.id)), event.exception)


def once(sink: Callable[[DataFrame, int], None], done: str) -> Callable[[DataFrame, int], None]:
    """A sink that takes each batch once, also if it comes again after a failure.

    The numbers of batches that were taken are files in the folder ``done``.
    """

    def take(batch: DataFrame, number: int) -> None:
        mark = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{done}/{number}")
        system = mark.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration())
        if not system.exists(mark):
            sink(batch, number)
            system.create(mark, True).close()

    return take


def table_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder of its number, which a batch that comes again replaces."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there now, and give the sink's rows.

    Rows and checkpoint are in the shared folder.  In mode ``complete`` the last
    batch is the result, else all batches are; with ``update`` a row may have come
    in several versions.
    """
    from ..plans.lineage import shared_dir

    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(table_sink(f"{folder}/rows")).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        last = query.lastProgress
    finally:
        query.stop()
    if last is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").option("recursiveFileLookup", True)
    if mode != "complete":
        return rows.parquet(f"{folder}/rows")
    batches = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select(F.max("batch").alias("b")).first()["b"]
    return rows.parquet(f"{folder}/rows/batch={batches or 0}")
