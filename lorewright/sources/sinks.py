"""Sinks: materials, the index page, the log, snapshots of state tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge
from ..plans.lineage import cut
from ..schema import CATEGORIES


def append_materials(incoming: DataFrame, folder: str) -> DataFrame:
    """Append the contents that the table at ``folder`` has not.

    Returns them as they were found, checkpointed before the table grows.
    """
    spark = incoming.sparkSession
    known = read_state(spark, folder, "hash string, id string, source string, seq long, content string")
    fresh = merge.new_materials(incoming, known, check_source=True).withColumn("id", X.content_id(F.col("content"))).select("hash", "id", "source", "seq", "content")
    fresh = cut(fresh)
    fresh.write.mode("append").parquet(folder)
    return fresh


def index_text(entries: DataFrame) -> DataFrame:
    """(category, n, text): a line per entry, by slug and title, of each category."""
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), F.col("title"))
    lines = entries.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", "title", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return lines.where(F.col("category").isin(*CATEGORIES))


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of ``new`` that the log has not, each once."""
    return new.select("line").distinct().join(log.select("line"), "line", "left_anti")


def read_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A state table, its newest version if it has versions; an empty one where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_newest(spark, folder) or folder)


def append_lines(new: DataFrame, folder: str) -> None:
    """Append to the log at ``folder`` the lines that it has not."""
    log = read_state(new.sparkSession, folder, "line string")
    cut(append_log(log, new)).write.mode("append").parquet(folder)


def write_index(index: DataFrame, folder: str) -> bool:
    """Replace the index at ``folder`` if any category's text changed; whether it did."""
    old = read_state(index.sparkSession, folder, "category string, n long, text string")
    new = cut(index.select("category", F.col("n").cast("long").alias("n"), "text"))
    same = lambda a, b: a.join(b, [a["category"] == b["category"], a["text"] == b["text"]], "left_anti").isEmpty()
    if same(new, old) and same(old, new):
        return False
    replace_state(new, folder)
    return True


class Conflict(RuntimeError):
    """Another writer has made the next version of a table."""


def replace_state(rows: DataFrame, folder: str, base: int | None = None) -> None:
    """Write a new version of a table; readers see the old one or the new one whole.

    Versions are folders below ``folder``, and a version counts once its mark is
    there, which is made after its rows are written and names them.  No mark is
    made twice, so of two writers that both follow version ``base`` (as it is now,
    if not given) one fails with ``Conflict``.  The version before stays as backup;
    older ones go.
    """
    spark = rows.sparkSession
    old = _versions(spark, folder)
    n = (max(old, default=0) if base is None else base) + 1
    name = f"v{n:08d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    system, mark = _opened(spark, f"{folder}/_current-{n:08d}")
    try:
        out = system.create(mark, False)
    except Exception as wrong:
        if system.exists(mark):
            raise Conflict(f"version {n} of {folder} is there already") from wrong
        raise
    out.writeBytes(name)
    out.close()
    for k, rows_of in old.items():
        if k < n - 1:
            for gone in (f"{folder}/_current-{k:08d}", f"{folder}/{rows_of}"):
                system.delete(_opened(spark, gone)[1], True)


def update_state(spark: SparkSession, folder: str, schema: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> None:
    """Write the version that ``change`` makes of the newest one; again from the newest if another writer was faster."""
    for k in range(tries):
        versions = _versions(spark, folder)
        try:
            return replace_state(change(read_state(spark, folder, schema)), folder, max(versions, default=0))
        except Conflict:
            if k == tries - 1:
                raise


def _opened(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The folder of each version; a mark without a name is of a writer that did not end."""
    system, marks = _opened(spark, f"{folder}/_current-*")
    out = {}
    for found in system.globStatus(marks) or ():
        stream = system.open(found.getPath())
        out[int(found.getPath().getName().split("-")[1])] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
    return out


def _newest(spark: SparkSession, folder: str) -> str | None:
    """Where the newest version's rows are; None if the table has no versions."""
    named = {n: name for n, name in _versions(spark, folder).items() if name}
    return f"{folder}/{named[max(named)]}" if named else None


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def replace_rows(rows: DataFrame, changed: DataFrame, folder: str, key: str, schema: str, buckets: int) -> list[int]:
    """Put ``rows`` in the place of those of the keys in ``changed``; gives the buckets that were written.

    The table is partitioned by ``bucket`` of its key, and only buckets of changed
    keys are read and replaced, by dynamic partition overwrite.  A bucket without
    rows keeps one without a key, which ``read_rows`` leaves out.
    """
    spark = rows.sparkSession
    # As many numbers as there are buckets, at most.
    touched = sorted(r["b"] for r in changed.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect())
    if touched:
        kept = read_rows(spark, folder, key, schema).where(F.col("bucket").isin(touched)).join(changed.select(key), key, "left_anti")
        marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
        out = kept.unionByName(rows.withColumn("bucket", bucket_of(F.col(key), buckets))).unionByName(marks, allowMissingColumns=True)
        out.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return touched


def read_rows(spark: SparkSession, folder: str, key: str, schema: str) -> DataFrame:
    """The rows of a table that ``replace_rows`` keeps, with ``bucket``."""
    return read_state(spark, folder, f"{schema}, bucket int").where(F.col(key).isNotNull())
