"""A training corpus from raw documents, in five stages.

Each stage takes all that the one before kept and calls one operator of
``lorewright.llm``; all but the last return the columns of ``documents``.

Rows stand for themselves: rows alike in all columns are judged alike, and come out
as often as they stay.  Null texts are as empty ones.  Rows with a null ``doc_id`` are
documents of their own, which no stage but the first and the fourth can reject, as they
are neither earlier nor later than others.  Empty tables give empty tables, and other
columns are not looked at.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import bpe, decontaminate, quality, registry, runtime, substring, wide_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the site-aware classifier finds bad or toxic."""
    return quality.reject_bad(docs, runtime.documents(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document, that of the least doc_id, of each near-duplicate group.

    Near duplicates have five-word shingles of a similarity of 0.8 or more.  Rows of
    one doc_id stay or go together; those without one stay.
    """
    return wide_simhash.drop_similar(docs, words_each=5, similarity=0.8).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With passages gone that an earlier document has; layout stays.

    A document of which nothing is left stays as an empty one; a text that loses
    nothing, null or not, stays as it is.  Of rows of one doc_id none is earlier.
    """
    cut = substring.remove_repeats(docs, registry.WINDOW, keep_layout=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more is benchmark text."""
    found = decontaminate.find_contamination(docs, runtime.documents(spark, sf_dir, "benchmark"), registry.WINDOW)
    return found.where("not contaminated").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded text."""
    out = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", tokenize),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; ``tests/llm/test_pipeline_stages.py`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as a table before the next."""
    docs = runtime.documents(spark, sf_dir).select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.cut(docs)
    return docs
