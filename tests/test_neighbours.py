"""Neighbours by hyperplanes against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.operators import neighbours

KIND = "vec_id long, embedding array<float>, label int"


def exact(data: dict, k: int, least: float) -> set:
    ids = [i for i, v in data.items() if v is not None and any(v)]
    unit = np.array([data[i] for i in ids], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = unit @ unit.T
    out = set()
    for x, i in enumerate(ids):
        near = sorted((-round(score[x, y], 12), j) for y, j in enumerate(ids) if j != i and score[x, y] >= least)[:k]
        out |= {(i, j) for _, j in near}
    return out


@pytest.mark.parametrize("least,noise,bits", [(0.35, 1.5, None), (0.8, 0.35, 5)])
def test_recall(spark, least, noise, bits):
    """At least 0.9 of the neighbours at any cosine that is asked for."""
    pick = np.random.default_rng(1)
    centres = pick.standard_normal((60, 32))
    data = {i: (centres[i % 60] + noise * pick.standard_normal(32)).tolist() for i in range(900)}
    want = exact(data, 8, least)
    got = neighbours.nearest_by_hyperplanes(spark.createDataFrame([(i, v, 0) for i, v in data.items()], KIND), 8, least, bits=bits).collect()
    assert len(want) > 900 and len({(r["query"], r["neighbour"]) for r in got} & want) >= 0.9 * len(want)
    assert all(r["score"] >= least and 1 <= r["rank"] <= 8 and r["query"] != r["neighbour"] for r in got)


def test_copies_nulls_and_large_buckets(spark):
    """More copies than a block holds: each has the least of the others."""
    copies = [(i, [1.0, 2.0, 3.0], 0) for i in range(2500)]
    rows = copies + [(9000, None, 0), (9001, [0.0, 0.0, 0.0], 0), (9002, [-1.0, -2.0, -3.0], 0), (5, [1.0, 2.0, 3.0], 1)]
    got = neighbours.nearest_by_hyperplanes(spark.createDataFrame(rows, KIND), 3, 0.9)
    by = {}
    for r in got.orderBy("rank").collect():
        by.setdefault(r["query"], []).append(r["neighbour"])
    assert len(by) == 2500 and by[0] == [1, 2, 3] and by[2] == [0, 1, 3] and by[2499] == [0, 1, 2]
    assert neighbours.nearest_by_hyperplanes(spark.createDataFrame([], KIND)).collect() == []


def test_plan():
    """Chances of 0.95 to share a bucket, at buckets of about 256 rows."""
    bits, tables = neighbours.plan(1_000_000, 0.8, 0.95)
    same = (1 - np.arccos(0.8) / np.pi) ** bits
    assert bits == 12 and 1 - (1 - same) ** tables >= 0.95 > 1 - (1 - same) ** (tables - 1)
    assert neighbours.plan(10, 0.35, 0.95)[0] == 1


def test_some_rows_ask(spark):
    """Queries meet all rows, in few tables; recall as of all rows."""
    pick = np.random.default_rng(2)
    centres = pick.standard_normal((40, 32))
    data = {i: (centres[i % 37 + i % 4] + 1.5 * pick.standard_normal(32)).tolist() for i in range(3000)}
    want = {(a, b) for a, b in exact(data, 8, 0.35) if a % 10 == 0}
    got = neighbours.nearest_by_hyperplanes(spark.createDataFrame([(i, v, 0) for i, v in data.items()], KIND), 8, 0.35, asks=F.col("vec_id") % 10 == 0).collect()
    pairs = {(r["query"], r["neighbour"]) for r in got}
    assert {a for a, _ in pairs} <= set(range(0, 3000, 10)) and any(b % 10 for _, b in pairs)
    assert len(want) > 300 and len(pairs & want) >= 0.9 * len(want)


def test_all_pairs_in_strips(spark):
    """Groups of any size and strips of them give each pair once."""
    from lorewright.operators import retrieval

    data = np.random.default_rng(3).standard_normal((300, 6)).astype(np.float32)
    unit = data / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(unit @ unit.T >= 0.5) if a < b}
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)] + [(900, None, 0)], KIND)
    for block, strip in ((300, 32), (100, 300), (64, 16)):
        got = [(r["a"], r["b"]) for r in retrieval.similar_pairs(rows, 0.5, block_rows=block, strip=strip).collect()]
        assert len(got) == len(want) and set(got) == want
