"""Session settings that the engine's operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lorewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and RocksDB stream state."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    said = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for k, v in said.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
