"""Series and ranks over ordered ranges, against plain loops."""

from __future__ import annotations

import random

import pytest

from lorewright.operators import retrieval, state


@pytest.mark.parametrize("parts", [1, 5])
def test_changes_of_one_series(spark, parts):
    pick = random.Random(parts)
    rows = [(n * 3, pick.choice(["a", "b", None, "b"])) for n in range(300)]
    shuffled = random.Random(1).sample(rows, len(rows))
    got = state.changes(spark.createDataFrame(shuffled, "n long, v string").repartition(parts), None, "n", "v")
    want = [(n, v) for (_, before), (n, v) in zip(rows, rows[1:], strict=False) if None not in (before, v) and before != v]
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["n", "v"]
    assert state.changes(spark.createDataFrame([], "n long, v string"), None, "n", "v").count() == 0


def test_ranks_of_many_hits(spark):
    pick = random.Random(3)
    hits = [(f"c{n:04d}", pick.choice([0.5, 1.0, 2.0, pick.random()])) for n in range(900)]
    want = {c: n for n, (c, _) in enumerate(sorted(hits, key=lambda h: (-h[1], h[0])), 1)}
    got = retrieval.ranked(spark.createDataFrame(hits, "chunk string, score double").repartition(6))
    assert {r["chunk"]: r["rank"] for r in got.collect()} == want
