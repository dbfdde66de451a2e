"""Cutting of lineage for iterative plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset and all runs on this machine, as in tests, a temporary one
    is made and removed at exit; on a cluster an unset one is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="lorewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def cut_loop(df: DataFrame) -> DataFrame:
    """As ``cut``, for tables that loops join again and again: written to the shared folder and read.

    A checkpoint keeps its plan's size estimate, and joins multiply estimates, so
    after some rounds the numbers would overflow.  Of a written table its files'
    sizes are known.  Tables go when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    atexit.register(_removed, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone, and with it who could remove it
        pass
