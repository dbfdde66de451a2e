"""Joins as of a time, on ranges and on intervals, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import joins


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("parts", [2, 64])
def test_as_of_is_brute_force(spark, by, parts):
    """A hot key, null keys and times, ties, times before all others."""
    pick = random.Random(parts)
    key = lambda: pick.choice(["hot"] * 6 + ["a", "b", None])
    left = [(n, key(), pick.choice([None, *range(60)])) for n in range(150)] + [(900, "only left", 5)]
    right = [(key(), pick.choice([None, *range(10, 60, 3)]), pick.randrange(100), f"v{n}") for n in range(120)]
    want = []
    for n, k, at in left:
        known = [(t, v, w) for g, t, v, w in right if (not by or g == k) and t is not None and at is not None and t <= at]
        want.append((n, k, at, *(max(known)[1:] if known else (None, None))))
    a = spark.createDataFrame(left, "n int, k string, at int").repartition(3)
    b = spark.createDataFrame(right, "k string, at int, v int, w string")
    got = joins.as_of(a, b if by else b.drop("k"), by, "at", ["v", "w"], parts)
    assert got.columns == ["n", "k", "at", "v", "w"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert joins.as_of(a, b.limit(0), by, "at", ["v", "w"]).where("v is not null").count() == 0
    assert joins.as_of(a.limit(0), b, by, "at", ["v", "w"]).count() == 0


def lengths(pick):
    return pick.choice([0.0, 0.5, 1.0, 3.0, 8.0, 64.0, 500.0])


def test_in_range_is_brute_force(spark):
    """Ranges from points to the whole line, turned round and null ones."""
    pick = random.Random(5)
    points = [(n, pick.choice([None, pick.uniform(-50, 50), float(pick.randint(-50, 50))])) for n in range(200)]
    ranges = [(n, low, low + lengths(pick)) for n, low in enumerate(float(pick.randint(-60, 60)) for _ in range(80))] + [(100, 5.0, 4.0), (101, None, 3.0), (102, 3.0, None)]
    want = {(p, r) for p, x in points for r, low, high in ranges if None not in (x, low, high) and low <= x <= high}
    a, b = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, low double, high double")
    for width in (0.5, 2.0, 1000.0):
        got = [(r["p"], r["r"]) for r in joins.in_range(a, b, "x", "low", "high", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert joins.in_range(a, b.limit(0), "x", "low", "high", 1.0).count() == 0


def test_overlapping_is_brute_force(spark):
    pick = random.Random(6)
    made = lambda n: [(i, pick.choice("xyz"), s, s + lengths(pick)) for i, s in enumerate(pick.choice([float(pick.randint(-40, 40)), pick.uniform(-40, 40)]) for _ in range(n))] + [(999, "x", None, 4.0)]
    left, right = made(90), made(110)
    want = {(i, j) for i, k, s, e in left for j, g, t, f in right if k == g and None not in (s, t) and s < f and t < e}
    a, b = (spark.createDataFrame(x, "i int, k string, s double, e double") for x in (left, right))
    for width in (0.5, 2.0, 1000.0):
        got = [(r["i"], r["b_i"]) for r in joins.overlapping(a, b, ["k"], "s", "e", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_points_of_one_bin_are_shared_out(spark):
    """Twenty thousand points at one place: no task has half of their pairs."""
    points = spark.range(0, 20_000, 1, 1).select("id", F.lit(3.5).alias("x"))
    ranges = spark.range(0, 5, 1, 1).select(F.col("id").alias("r"), F.lit(3.0).alias("low"), F.lit(4.0).alias("high"))
    got = joins.in_range(points, ranges, "x", "low", "high", 1.0)
    by = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.distinct().count() == 100_000 == sum(by) and max(by) < 60_000
