"""Communities: planted ones are found, and modularity is no less than label propagation's."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lorewright.operators import communities, graph


def planted(seed: int, groups: int, size: int, inside: float, outside: float) -> tuple[list, list]:
    pick = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(groups * size)]
    pick.shuffle(nodes)
    edges = [(a, b) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if pick.random() < (inside if i // size == j // size else outside)]
    return nodes, edges


def parts(rows) -> set:
    by = defaultdict(set)
    for r in rows:
        by[r["community"]].add(r["id"])
    return {frozenset(v) for v in by.values()}


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string")


def test_planted_communities_are_found(spark):
    nodes, edges = planted(1, 4, 20, 0.5, 0.03)
    n, e = frames(spark, nodes, edges)
    found = communities.louvain(e, n).collect()
    assert parts(found) == {frozenset(nodes[i : i + 20]) for i in range(0, 80, 20)}
    assert {r["community"] for r in found} <= set(nodes)


@pytest.mark.parametrize("graph_of", ["ring", "star", "noise"])
def test_no_less_than_label_propagation(spark, graph_of):
    pick = random.Random(3)
    if graph_of == "ring":
        edges = [(f"{k}.{i}", f"{k}.{j}") for k in range(8) for i in range(5) for j in range(i)] + [(f"{k}.0", f"{(k + 1) % 8}.1") for k in range(8)]
    elif graph_of == "star":
        edges = [("hub", f"a{i}") for i in range(30)] + [(f"a{i}", f"a{i + 1}") for i in range(0, 30, 2)]
    else:
        edges = [(f"n{pick.randrange(60)}", f"n{pick.randrange(60)}") for _ in range(150)]
        edges = list({(min(x), max(x)) for x in edges if x[0] != x[1]})
    n, e = frames(spark, sorted({x for p in edges for x in p}), edges)
    score = lambda labels: graph.modularity(e, labels).first()["modularity"]
    assert score(communities.louvain(e, n)) >= score(graph.communities(e, n)) - 1e-9


def test_weights_loops_and_lone_nodes(spark):
    n = spark.createDataFrame([(x,) for x in "abcdz"], "id string")
    e = spark.createDataFrame([("a", "b", 5.0), ("c", "d", 5.0), ("b", "c", 0.5), ("a", "a", 1.0), ("a", "b", 1.0)], "source string, target string, weight double")
    assert parts(communities.louvain(e, n).collect()) == {frozenset("ab"), frozenset("cd"), frozenset("z")}
    assert parts(communities.louvain(e.limit(0), n).collect()) == {frozenset(x) for x in "abcdz"}
    assert communities.louvain(e.limit(0), n.limit(0)).collect() == []
