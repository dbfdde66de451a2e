"""Keep a chunk index of the documents up to date, bucket by bucket.

The index itself is the high-water mark: each of its rows has the digest of the text it
was made from.  A run compares the documents' digests with those, cuts only new and
changed texts into windows of tokens, forgets what is gone, and rewrites only the
buckets that this touches.  A second run over the same documents writes nothing.

    python -m jobs.index_documents --documents IN --index OUT --config jobs/index_documents.json

Output is Parquet, partitioned by ``bucket``, a digest of the id.  A bucket is replaced
as a whole by dynamic partition overwrite; if a run ends in the middle, the next one
finds what is missing and makes it.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import settings
from lorewright.functions import text as X
from lorewright.functions.windows import token_windows
from lorewright.operators import state
from lorewright.plans.lineage import cut_loop
from lorewright.sources import sinks

log = logging.getLogger("index_documents")

OPTIONS = {"buckets": 64, "size": 200, "overlap": 20}
#: A text without tokens has one row without a chunk, and a bucket without documents one without a document.
SCHEMA = "doc_id long, sha256 string, n_chunks int, chunk int, tokens int, content string, bucket int"


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.left(F.md5(doc_id.cast("string")), F.lit(8)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def run(spark: SparkSession, documents: str, index: str, options: dict | None = None) -> dict[str, int]:
    """Bring the index at ``index`` up to the documents; gives counts of documents by change, and of chunks and buckets written.

    Documents without an id are left out.  If an id stands there several times,
    the text with the least digest counts.
    """
    said = OPTIONS | (options or {})
    docs = spark.read.parquet(documents).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", X.content_hash(F.coalesce("text", F.lit(""))).alias("sha256"))
    known = sinks.read_state(spark, index, SCHEMA).where("doc_id is not null")
    ledger = known.where("coalesce(chunk, 1) = 1").select(F.col("doc_id").alias("rel_path"), "sha256")
    current = docs.groupBy(F.col("doc_id").alias("rel_path")).agg(F.min("sha256").alias("sha256"))
    delta = state.ledger_delta(current, ledger)
    gone = ledger.join(current, "rel_path", "left_anti").select("rel_path", F.lit(None).cast("string").alias("sha256"), F.lit("gone").alias("change"))
    todo = cut_loop(delta.unionByName(gone).where("change <> 'same'").select(F.col("rel_path").alias("doc_id"), "sha256", "change", bucket_of(F.col("rel_path"), said["buckets"]).alias("bucket")))
    changes = {r["change"]: r["count"] for r in todo.groupBy("change").count().collect()}
    counts = {c: changes.get(c, 0) for c in ("new", "changed", "gone")} | {"chunks": 0, "buckets": 0}
    # As many numbers as there are buckets, at most.
    touched = sorted(r["bucket"] for r in todo.select("bucket").distinct().collect())
    if touched:
        fresh = docs.join(todo.where("change <> 'gone'").select("doc_id", "sha256", "bucket"), ["doc_id", "sha256"]).dropDuplicates(["doc_id"])
        windows = fresh.select("doc_id", "sha256", "bucket", token_windows(F.col("text"), said["size"], said["overlap"]).alias("ws"))
        made = windows.select("doc_id", "sha256", F.size("ws").alias("n_chunks"), F.explode_outer("ws").alias("w"), "bucket")
        rows = made.select("doc_id", "sha256", "n_chunks", F.col("w.index").alias("chunk"), F.col("w.tokens").alias("tokens"), F.col("w.main").alias("content"), "bucket")
        kept = state.without(known.where(F.col("bucket").isin(touched)), todo, "doc_id")
        marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")[:-1])), "bucket")
        # Of like sizes: a large bucket becomes several files, small ones share a task.
        out = kept.unionByName(rows).unionByName(marks).hint("rebalance", F.col("bucket"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(index)
        wrote = output(spark, index).where(F.col("bucket").isin(touched)).agg(F.count("chunk")).first()[0]
        counts |= {"chunks": wrote, "buckets": len(touched)}
    log.info("read %s: %d new, %d changed, %d gone; wrote %d chunks in %d buckets of %s", documents, *(counts[c] for c in ("new", "changed", "gone", "chunks", "buckets")), index)
    return counts


def output(spark: SparkSession, index: str) -> DataFrame:
    """The index's rows; none where no run has been."""
    return sinks.read_state(spark, index, SCHEMA).where("doc_id is not null")


def main(given: list[str] | None = None) -> None:
    from lorewright.session import build_session

    said, options = settings(given, __doc__.splitlines()[0], ["documents", "index"])
    spark = build_session("index_documents", said.master)
    try:
        run(spark, said.documents, said.index, options)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
