"""Overlaps by an inverted index against brute force."""

from __future__ import annotations

import random

import pytest

from lorewright.operators import overlaps

KEYS = "keys array<struct<key:long,w:int>>"


def brute(left: dict, right: dict, k: int) -> list[tuple]:
    out = []
    for a, xs in left.items():
        total = {b: sum(w * sum(x == key for x, _ in xs) for key, w in ys) for b, ys in right.items()}
        best = sorted((-n, b) for b, n in total.items() if n)[:k]
        out += [(a, b, -n, r + 1) for r, (n, b) in enumerate(best)]
    return sorted(out)


def skewed(pick: random.Random, n: int) -> list[tuple]:
    """Keys of which few are frequent and many rare, some of them twice."""
    return [(int(60 * pick.random() ** 3), 1 + pick.randrange(3)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 30, 10_000])
def test_overlaps_are_brute_force(spark, seed):
    """With and without pruning, over several ranges of rows, keys before and after zero, ties."""
    pick = random.Random(seed)
    left = {f"t{i}": skewed(pick, pick.randint(0, 12)) for i in range(60)} | {"": [(1, 1)], "none": [(999, 1)]}
    right = {i * 4001 - 300_000: skewed(pick, pick.randint(0, 15)) for i in range(300)}
    a, b = spark.createDataFrame(list(left.items()), f"id string, {KEYS}"), spark.createDataFrame(list(right.items()), f"idx long, {KEYS}")
    for prune in (True, False):
        for k in (1, 7):
            assert sorted(map(tuple, overlaps.top_overlaps(a, b, k, prune, seed).collect())) == brute(left, right, k)


def test_overlaps_of_nothing(spark):
    some, none = spark.createDataFrame([(1, [(1, 1)]), (2, [])], f"id long, {KEYS}"), spark.createDataFrame([], f"idx long, {KEYS}")
    for prune in (True, False):
        assert overlaps.top_overlaps(some, none, 5, prune).collect() == []
        assert overlaps.top_overlaps(none.withColumnRenamed("idx", "id"), some.withColumnRenamed("id", "idx"), 5, prune).collect() == []


def test_frequent_keys_bring_no_candidates(spark):
    """Every row has the frequent keys, and the rare one decides: only its postings are summed."""
    right = [(i, [(1, 1), (2, 1)] + ([(7, 5)] if i % 500 == 3 else [])) for i in range(5000)]
    left = [(0, [(1, 1), (2, 1), (7, 1)])]
    a, b = spark.createDataFrame(left, f"id long, {KEYS}"), spark.createDataFrame(right, f"idx long, {KEYS}")
    got = overlaps.top_overlaps(a, b, 5, prune=True)
    assert sorted(map(tuple, got.collect())) == [(0, 3 + 500 * n, 7, n + 1) for n in range(5)]
