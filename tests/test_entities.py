"""The graph of entities by brute force, and ranks by a power iteration."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lorewright.operators import entities

KIND = "chunk_id string, rel_path string, content string"


def key(name: str) -> str:
    name = re.sub(r"\.md$", "", name.replace("\\", "/").removeprefix("knowledge/"), flags=re.I).strip().lower()
    return re.sub(r"[\W_]+", "-", name.rsplit("/", 1)[-1]).strip("-")


def made():
    pick = random.Random(1)
    names = ["Boats", "boats", "knowledge/concepts/Lake.md", "lake", "river-side", "River side", "port", "sea|the sea", "", "!!"]
    return [(f"c{n}", f"knowledge/concepts/page {n % 7}.md", " ".join(f"[[{pick.choice(names)}]]" for _ in range(pick.randint(0, 4)))) for n in range(80)] + [(None, "knowledge/x.md", "[[gone]]"), ("c900", "knowledge/y.md", None)]


def test_entity_graph_is_brute_force(spark):
    rows = made()
    held, labels = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for chunk, path, text in rows:
        if chunk is None:
            continue
        names = [m.split("|")[0].strip() for m in re.findall(r"\[\[([^\]]+?)\]\]", text or "")] + [path.rsplit("/", 1)[-1].removesuffix(".md")]
        for name in names:
            if key(name):
                held[chunk].add(key(name))
                labels[chunk][key(name)].add(name)
    sources, pairs = defaultdict(list), defaultdict(list)
    for chunk in sorted(held):
        for k in held[chunk]:
            sources[k].append(chunk)
        for a, b in combinations(sorted(held[chunk]), 2):
            pairs[a, b].append(chunk)
    named = {}
    for k in sources:
        counts = Counter(min(labels[c][k]) for c in sources[k])
        named[k] = min(counts, key=lambda x: (-counts[x], x))
    nodes, edges = entities.entity_graph(spark.createDataFrame(rows, KIND), most_sources=3)
    assert {(r["id"], r["label"], r["n"], tuple(r["sources"])) for r in nodes.collect()} == {(k, named[k], len(v), tuple(v[:3])) for k, v in sources.items()}
    assert {(r["source"], r["target"], r["weight"], tuple(r["sources"])) for r in edges.collect()} == {(*k, len(v), tuple(v[:3])) for k, v in pairs.items()}


def test_ranks_are_a_power_iteration(spark):
    pick = random.Random(2)
    edges = [(f"n{pick.randrange(12)}", f"n{pick.randrange(12)}", float(pick.randint(1, 5))) for _ in range(30)]
    ids = sorted({x for e in edges for x in e[:2]} | {"lone"})
    at = {k: i for i, k in enumerate(ids)}
    w = np.zeros((len(ids),) * 2)
    for a, b, x in edges:
        if a != b:
            w[at[a], at[b]] += x
            w[at[b], at[a]] += x
    start = np.zeros(len(ids))
    start[[at["n1"], at["lone"]]] = 0.5
    rank, degree = start.copy(), w.sum(1)
    for _ in range(8):
        went = 0.85 * (rank / np.where(degree > 0, degree, 1)) @ w
        rank = went + (1 - went.sum()) * start
    seeds = spark.createDataFrame([("n1",), ("lone",), ("n1",)], "id string")
    got = {r["id"]: r["rank"] for r in entities.personal_rank(spark.createDataFrame(edges, "source string, target string, weight double"), seeds, 8).collect()}
    assert sum(got.values()) == pytest.approx(1) and {k: pytest.approx(v) for k, v in got.items() if v > 1e-12} == {k: rank[i] for k, i in at.items() if rank[i] > 1e-12}


def test_chunks_of_the_best_communities(spark):
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.3)], "id string, rank double")
    of = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, community string")
    nodes = spark.createDataFrame([("a", ["1", "2"]), ("b", ["2"]), ("c", ["3"])], "id string, sources array<string>")
    got = {r["chunk"]: r["score"] for r in entities.community_hits(ranks, of, nodes, 1).collect()}
    assert got == {"1": pytest.approx(0.35), "2": pytest.approx(0.49)}
    assert len(entities.community_hits(ranks, of, nodes, 2).collect()) == 3


def test_engine_searches_its_own_graph(spark, tmp_path):
    """Local and global search need no tables from outside."""
    from lorewright.engine import Engine

    engine = Engine(spark, str(tmp_path))
    texts = {"boats": "Things that float on [[lake]] water.", "lake": "Water with [[boats]] in it.", "harbour": "Where [[boats]] rest.", "bread": "Made of [[flour]].", "flour": "Ground for [[bread]]."}
    engine.index(spark.createDataFrame([(f"knowledge/concepts/{k}.md", v) for k, v in texts.items()], "rel_path string, raw string"))
    engine.build_graph()
    nodes, edges, groups = engine.entity_graph()
    assert {r["id"] for r in nodes.collect()} == set(texts) and edges.count() == 3
    community = {r["id"]: r["community"] for r in groups.collect()}
    assert community["bread"] == community["flour"] != community["lake"] == community["boats"]
    for mode in ("local", "global", "hybrid", "mix"):
        paths = [r["file_path"].rsplit("/", 1)[-1] for r in engine.search("boats", 3, mode).collect()]
        assert paths and (mode == "mix" or not {"bread.md", "flour.md"} & set(paths)), (mode, paths)
