"""Take new documents into the materials, each content once.

A file stream over the folder of documents: its checkpoint says which files were
taken, so a run takes the new ones and ends.  Every document has a fate: it is
``accepted``, ``empty``, of an ``unknown source``, with ``no id``, or a ``duplicate`` of a material
that is there already or that has a lesser id in the same batch.

    python -m jobs.ingest_materials --documents IN --materials OUT --checkpoint DIR --config jobs/ingest_materials.json

Output is Parquet, partitioned by ``batch`` and ``fate``.  A batch that comes again
after a failure replaces its own partition and looks at earlier ones alone, so it
gives the same rows.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import settings
from lorewright.functions import text as X
from lorewright.operators import merge
from lorewright.plans.lineage import cut_loop
from lorewright.sources import sinks

log = logging.getLogger("ingest_materials")

OPTIONS = {"sources": "src[0-9]+", "title_chars": 80, "files_each": 0}
SCHEMA = "doc_id long, source string, hash string, id string, title string, content string, of long, batch int, fate string"


def fates(rows: DataFrame, known: DataFrame, sources: str, title_chars: int) -> DataFrame:
    """Every row of ``rows`` (``doc_id``, ``source``, ``text``) with its fate.

    ``known`` has ``hash`` and ``doc_id`` of the materials.  Rows that are alike
    in id, source and content count once.  Only accepted ones keep their content; of a
    duplicate ``of`` names the material that has it.  Contents are compared
    without white space at their ends; a null text is empty.
    """
    body = rows.select(F.col("doc_id").cast("long").alias("seq"), "source", F.coalesce(X.strip(F.col("text")), F.lit("")).alias("content")).withColumn("hash", X.content_hash(F.col("content")))
    right = F.coalesce(F.col("source").rlike(f"^(?:{sources})$"), F.lit(False))
    why = F.when(F.col("seq").isNull(), F.lit("no id")).when(~right, F.lit("unknown source")).when(F.col("content") == "", F.lit("empty"))
    said = body.withColumn("why", why)
    # Without contents, so that texts are read twice and no more.
    light = cut_loop(said.select("seq", "source", "hash", "why").distinct())
    fit = light.where("why is null").drop("why")
    # A batch's hashes are fewer than the materials', so those come to them and not the other way.
    met = cut_loop(known.select("hash", F.col("doc_id").alias("of")).join(fit.select("hash").distinct(), "hash", "left_semi"))
    fresh = cut_loop(merge.new_materials(said.where("why is null").drop("why"), met))
    title = X.truncated(X.first_body_line(F.col("content")), title_chars)
    accepted = fresh.select(F.col("seq").alias("doc_id"), "source", "hash", X.content_id(F.col("content")).alias("id"), title.alias("title"), "content", F.lit(None).cast("long").alias("of"), F.lit("accepted").alias("fate"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("id", "title", "content")]
    own = fresh.select("hash", F.col("seq").alias("of"), "source")
    again = fit.join(met, "hash").select("seq", "source", "hash", "of")
    again = again.unionByName(fit.join(own.drop("source"), "hash").join(own.withColumnRenamed("of", "seq"), ["hash", "seq", "source"], "left_anti").select("seq", "source", "hash", "of"))
    copies = again.select(F.col("seq").alias("doc_id"), "source", "hash", *nothing, "of", F.lit("duplicate").alias("fate"))
    unfit = light.where("why is not null").select(F.col("seq").alias("doc_id"), "source", "hash", *nothing, F.lit(None).cast("long").alias("of"), F.col("why").alias("fate"))
    return accepted.unionByName(copies).unionByName(unfit)


def run(spark: SparkSession, documents: str, materials: str, checkpoint: str, options: dict | None = None) -> None:
    """Take what is new below ``documents`` into the table at ``materials``."""
    said = OPTIONS | (options or {})
    reader = spark.readStream.schema(spark.read.parquet(documents).schema)
    if said["files_each"]:
        reader = reader.option("maxFilesPerTrigger", said["files_each"])

    def take(batch: DataFrame, number: int) -> None:
        known = sinks.read_state(batch.sparkSession, materials, SCHEMA).where((F.col("batch") < number) & (F.col("fate") == "accepted"))
        found = fates(batch.select("doc_id", "source", "text"), known, said["sources"], said["title_chars"])
        place = f"{materials}/batch={number}"
        found.write.mode("overwrite").partitionBy("fate").parquet(place)
        wrote = {r["fate"]: r["count"] for r in batch.sparkSession.read.schema(SCHEMA).parquet(place).groupBy("fate").count().collect()}
        log.info("batch %d: read %d documents from %s, wrote %s to %s", number, sum(wrote.values()), documents, wrote, place)

    query = reader.parquet(documents).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if query.lastProgress is None or not query.lastProgress.numInputRows:
        log.info("nothing new in %s", documents)


def output(spark: SparkSession, materials: str) -> DataFrame:
    """All materials and fates so far; none where no run has been."""
    return sinks.read_state(spark, materials, SCHEMA)


def main(given: list[str] | None = None) -> None:
    from lorewright.session import build_session

    said, options = settings(given, __doc__.splitlines()[0], ["documents", "materials", "checkpoint"])
    spark = build_session("ingest_materials", said.master)
    try:
        run(spark, said.documents, said.materials, said.checkpoint, options)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
