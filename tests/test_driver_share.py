"""Loops over a graph send no tables through the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorewright.operators import communities, graph


@pytest.fixture
def no_broadcast(spark):
    """Joins that broadcast a side fail."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def cliques(spark):
    rows = spark.range(10).select("id", F.floor(F.col("id") / 5).alias("g"))
    edges = rows.alias("a").join(rows.alias("b").hint("merge"), "g").where("a.id < b.id").select(F.col("a.id").alias("source"), F.col("b.id").alias("target"))
    return rows.select("id"), edges.unionAll(spark.sql("select 0L, 5L"))


def groups(labels):
    by = {}
    for r in labels.collect():
        by.setdefault(r["community"], []).append(r["id"])
    return sorted(map(sorted, by.values()))


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graph.cut_loop
    monkeypatch.setattr(graph, "cut_loop", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.range(40).where("id % 10 <> 9").select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = {r["id"]: r["component"] for r in graph.components(edges, spark.range(40)).collect()}
    assert got == {n: n // 10 * 10 for n in range(40)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_louvain_broadcasts_nothing(spark, no_broadcast):
    nodes, edges = cliques(spark)
    assert groups(communities.louvain(edges, nodes)) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_label_propagation_broadcasts_nothing(spark, no_broadcast):
    nodes, edges = cliques(spark)
    typed = edges.select("source", "target", F.lit("to").alias("relation"), F.col("source").alias("seq"))
    simple = graph.simple_edges(typed, nodes)
    assert simple.count() == 21
    assert groups(graph.communities(simple, nodes)) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
