"""Tasks follow the rows, so what one of them holds does not grow with the input."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lorewright.operators import links, procedures
from lorewright.plans import graph_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_proposals_of_one_key_are_dealt_to_pieces(spark, monkeypatch):
    monkeypatch.setattr(links, "PIECE", 4)
    said = spark.range(40).select(F.col("id").alias("path"), F.when(F.col("id") < 37, "Hot").when(F.col("id") == 37, "cold").when(F.col("id") == 38, "gone").alias("target"))
    slugs = spark.createDataFrame([("hot",), ("cold",), ("other",)], "slug string")
    got = links.valid_proposals(said, slugs, 8).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["path"], r["canonical"]) for r in got) == [(n, "hot") for n in range(37)] + [(37, "cold")]
    assert len({r["task"] for r in got}) > 2


def test_enrich_has_tasks_by_pages(spark, monkeypatch):
    monkeypatch.setattr(procedures, "ROWS", 1)
    propose = lambda text: json.dumps({"links": [{"term": text.split()[0], "target": "P0"}, {"term": text.split()[1], "target": "p1"}]})
    entries = spark.range(9).select(F.concat(F.lit("p"), "id").alias("slug"), F.concat(F.lit("a"), "id", F.lit(" b"), F.when(F.col("id") == 5, " [[p1]]").otherwise("")).alias("content"))
    out = procedures.enrich(entries.withColumn("path", F.concat("slug", F.lit(".md"))), propose)
    assert {r["path"]: r["added"] for r in out.collect()} == {f"p{n}.md": [x for x in ("p0", "p1") if x != f"p{n}" and (n, x) != (5, "p1")] for n in range(9)}
    assert "hashpartitioning(path" in plan(out) and ", 18), REPARTITION_BY_NUM" in plan(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_revenue_has_tasks_by_lines(spark, monkeypatch):
    monkeypatch.setattr(graph_queries, "LINES", 1000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_shipdate >= timestamp_ntz '1994-01-01'").count()
    out = plan(graph_queries.revenue_by_nation(spark, SF))
    assert f", {-(-lines // 1000)}), REPARTITION_BY_NUM" in out and lines > 4000
