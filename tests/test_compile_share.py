"""Compiling sends no table through the driver that grows with the materials."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorewright.operators import procedures


@pytest.fixture
def no_broadcast(spark):
    """Joins that broadcast a side fail."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("rows", [7, 16_384])
def test_names_are_dealt_without_a_broadcast(spark, no_broadcast, monkeypatch, rows):
    """Names go on in the order of the sources, in one task or in many; what is cached is left out."""

    def write(text: str) -> str:
        name = "page" if int(text) % 2 else "other"
        end = "" if int(text) % 10 == 5 else "---END FILE---\n"
        return f"---FILE: knowledge/concepts/{name}.md---\n---\ntype: concept\ntitle: {text}\n---\n{text}\n{end}"

    def again(path: str) -> str:
        return f"---FILE: {path}---\n---\ntype: concept\n---\nagain\n---END FILE---\n"

    monkeypatch.setattr(procedures, "ROWS", rows)
    texts = spark.range(60).select(F.format_string("%03d", "id").alias("source_path"), F.col("id").cast("string").alias("content"))
    existing = spark.createDataFrame([("knowledge/concepts/page.md", "page", "Page", "concepts")], "path string, slug string, title string, category string")
    cache = texts.where("content >= '50'").select("source_path", F.sha2("content", 256).alias("hash"), F.array(F.lit("knowledge/concepts/page.md")).alias("files_written"))
    out = procedures.compile_materials(texts, existing, cache, "2030-01-02", write, again)
    done = [n for n in range(60) if str(n) < "50"]
    want = {}
    for name, odd, first in (("page", 1, 2), ("other", 0, 1)):
        for k, n in enumerate((n for n in done if n % 2 == odd), first):
            want[f"{n:03d}"] = f"knowledge/concepts/{name}{'' if k == 1 else f'-{k}'}.md"
    assert {r["source_path"]: r["path"] for r in out.entries.collect()} == want
    assert out.truncated.count() == 0 and out.cache.count() == len(done) and out.rejected.count() == 0
