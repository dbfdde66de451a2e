"""Overlaps of rows with the same frequent keys: their own row left out, and what is moved."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_overlaps import KEYS, brute, skewed

from lorewright.operators import overlaps


def test_own_row_is_no_candidate(spark):
    pick = random.Random(5)
    rows = {i * 997 - 70_000: skewed(pick, pick.randint(0, 8)) + [(1000 + i, 2)] * (i % 2) for i in range(250)}
    table = spark.createDataFrame(list(rows.items()), f"idx long, {KEYS}")
    got = sorted(map(tuple, overlaps.top_overlaps(table.withColumnRenamed("idx", "id"), table, 4, others=True).collect()))
    want = []
    for a, b, n, _ in brute(rows, rows, 5):
        want += [(a, b, n)] if a != b else []
    by = {}
    for a, b, n in sorted(want, key=lambda x: (x[0], -x[2], x[1])):
        by.setdefault(a, []).append((a, b, n))
    assert got == sorted((*x, r + 1) for xs in by.values() for r, x in enumerate(xs[:4]))


def test_postings_are_not_moved_for_every_row(spark):
    """Six hundred rows with the same keys, which twenty thousand have."""
    own = lambda n: F.array(*(F.struct(F.lit(k).cast("long").alias("key"), (F.xxhash64(n, F.lit(k)) % 3 + 4).cast("int").alias("w")) for k in range(6)))
    right = spark.range(20_000).select(F.col("id").alias("idx"), own(F.col("id")).alias("keys"))
    left = spark.range(600).select("id", own(F.lit(1)).alias("keys"))
    written = lambda: sum(x.totalShuffleWrite() for x in map(list_.apply, range(list_.size()))) if (list_ := spark.sparkContext._jsc.sc().statusStore().executorList(False)) else 0
    before = written()
    assert overlaps.top_overlaps(left, right, 3).count() == 1800
    assert written() - before < 10_000_000


def test_layout():
    """The index moves once a block of sets, however many partitions a shuffle has; few ranges still give many cells."""
    assert overlaps.layout(100_000, 19)[0] == 7 and overlaps.layout(600_000, 110) == (37, 8)
    for sets, ranges in ((1, 1), (10_000, 2), (100_000, 19)):
        blocks, size = overlaps.layout(sets, ranges)
        assert blocks >= -(-sets // overlaps.BLOCK) and 1 <= size <= overlaps.PART
    assert overlaps.layout(10_000, 2)[0] == 20


def test_names_are_dealt_out_before_they_become_pairs(spark):
    """However few files the pages are in, their keys are made and counted in as many tasks as a shuffle has."""
    from lorewright.operators import links

    pages = spark.range(0, 300, 1, 1).selectExpr("id as idx", "'p' || id as slug", "'c/p' || id as name", "'page ' || id as title")
    seen = {}
    held, links.top_overlaps = links.top_overlaps, lambda left, right, *a, **b: seen.update(left=left, right=right) or held(left, right, *a, **b)
    try:
        links.suggest_for_broken(pages.selectExpr("slug || 'x' as target"), pages)
    finally:
        links.top_overlaps = held
    assert seen["right"].rdd.getNumPartitions() == seen["left"].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
