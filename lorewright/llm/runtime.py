"""Session helpers: shared folder, lineage cuts, range grouping of rows."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset and all runs
    on this machine (``local`` masters, as in tests) a temporary folder is made
    and removed at exit; on a cluster that would be a folder of the driver's
    alone, so there an unset one is an error.
    """
    context = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if context._jsc.sc().getCheckpointDir().isDefined():
            return context._jsc.sc().getCheckpointDir().get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="lorewright-")
        atexit.register(shutil.rmtree, set_dir, ignore_errors=True)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(set_dir)
    return set_dir


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder, a URI with a scheme.

    Folders are removed when the driver ends, unless ``release`` does so before.
    """
    base = shared_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    made = f"{base}/{label}-{uuid.uuid4().hex}"
    atexit.register(files.remove_dir, made)
    return made


def cut(df: DataFrame, fn=None, schema: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder, read it.

    With ``fn`` and ``schema`` what is written is ``df.mapInArrow(fn, schema)``.
    Spark's committer takes one attempt of each task.  The files' sizes are all
    that later plans estimate from, so loops may join the result again and again.
    """
    made = df if fn is None else df.mapInArrow(fn, schema)
    folder = fresh_dir(df.sparkSession, "cut")
    made.write.parquet(folder)
    out = df.sparkSession.read.schema(made.schema).parquet(folder)
    out._cut_folder = folder
    return out


class Rounds:
    """Tables of a loop's rounds in one folder: each is written once, all are read at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.schema = spark, fresh_dir(spark, "rounds"), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round's rows and give them back."""
        at, self.schema, self.n = f"{self.folder}/round={self.n}", df.schema, self.n + 1
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.folder).option("recursiveFileLookup", True).parquet(self.folder)


def release(*tables: DataFrame) -> None:
    """Remove the folders of tables from ``cut`` that no plan will read again."""
    for df in tables:
        files.remove_dir(df._cut_folder)


def integer_key(df: DataFrame, key: str) -> None:
    """Raise a TypeError if the column is no integer."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer column, not {kind}")


def estimated_bytes(df: DataFrame, text: str) -> int:
    """What the rows take: the sizes of files as Spark knows them, else the texts' bytes."""
    known = int(str(df.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 58 else df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


#: Below so many bytes for each core a table is dealt anew before costly maps.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if they are few and so perhaps in one split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if known < SPREAD_BYTES * cores else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: What null keys count as where keys are put in order.
LEAST = -(1 << 63)


def range_cuts(df: DataFrame, key, groups: int) -> list[int]:
    """At most ``groups - 1`` ascending keys that deal rows into like ranges.

    Keys that hold the rows of several ranges come several times.  A single
    aggregate; what reaches the driver is bounded by ``groups``.
    """
    if groups < 2:
        return []
    at = [i / groups for i in range(1, groups)]
    return sorted(df.agg(F.percentile_approx(key, at, 20 * groups).alias("cuts")).first()["cuts"] or [])


def literal_array(values: list[int]):
    """An array of longs as one constant, however many they are."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def range_part(key, mixed, cuts: list[int]):
    """As ``range_parts`` in the JVM: the range of a key, by binary search of the cuts.

    ``mixed`` is a hash by which rows of a key that several cuts fall on are dealt.
    """
    if not cuts:
        return F.lit(0)
    known = literal_array(cuts)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    count = lambda below: F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(below(F.get(known, n + s - 1)), F.lit(False)), n + s).otherwise(n))
    right = count(lambda c: c <= key)
    if len(set(cuts)) == len(cuts):
        return right
    left = count(lambda c: c < key)
    # The hash's top bits, so that shares are in the order of the hash.
    share = F.shiftright((F.shiftright(mixed, 33) + (1 << 30)) * (right - left), 31).cast("int")
    return F.when(right - left > 1, left + 1 + share).otherwise(right)


def range_parts(keys: pa.Array, cuts: list[int], values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Range of each key, and its share: 0, or for a key that is several cuts which of their ranges.

    A key at a cut begins a range.  Shares of such a key go by the hash of the
    row's value, and null keys before others that are the least.
    """
    at = np.array(cuts, np.int64)
    key = keys.fill_null(LEAST).to_numpy(zero_copy_only=False).astype(np.int64)
    left, part = np.searchsorted(at, key), np.searchsorted(at, key, side="right")
    share = np.zeros(len(key), np.int64)
    for i in np.flatnonzero(part - left > 1).tolist():
        mixed = xxhash.xxh64_intdigest(values[i], seed=11) >> 2
        mixed |= int(bool(key[i] == LEAST and keys[i].is_valid)) << 62
        share[i] = mixed * int(part[i] - left[i]) >> (63 if key[i] == LEAST else 62)
    return np.where(part - left > 1, left + 1 + share, part), share


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
