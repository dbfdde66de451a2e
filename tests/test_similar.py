"""Similar titles against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorewright.functions import text as X
from lorewright.operators import similar


def strings(pick: random.Random, n: int) -> list[str | None]:
    """Short and long ones over few letters, edits of one another, parts of one another, with folders and suffixes."""
    out: list[str | None] = [None, "", " ", "a", "b.md", "ab", "abcde", "漢字かな交じり", "漢字かな交じりの"]
    while len(out) < n:
        base = "".join(pick.choice("abcdr -") for _ in range(pick.randint(1, 24)))
        if pick.random() < 0.6 and len(out) > 12:
            base = list(pick.choice(out) or "xyzzy")
            for _ in range(pick.randint(0, 5)):
                at = pick.randint(0, len(base))
                base[at : at + pick.randint(0, 1)] = pick.choice(["", "q", "a", "bc"])
            base = "".join(base)
        out.append(pick.choice(["", "", "x/", "Knowledge/y/"]) + base + pick.choice(["", "", ".md", " more words"]))
    return out


@pytest.mark.parametrize("least", [0.3, 0.74, 0.9, 1.0])
def test_similar_titles_are_brute_force(spark, least):
    pick = random.Random(int(least * 100))
    queries = spark.createDataFrame([(x,) for x in strings(pick, 70)], "query string")
    titles = spark.createDataFrame([(x,) for x in strings(pick, 110)], "title string").unionByName(queries.sample(0.3, seed=1).withColumnRenamed("query", "title"))
    pairs = queries.distinct().crossJoin(titles.distinct()).withColumn("score", X.similarity(F.col("query"), F.col("title"))).where(F.col("score") >= least)
    want = {(r["query"], r["title"], r["score"]) for r in pairs.collect()}
    got = similar.similar_titles(queries, titles, least, 10_000).collect()
    assert {(r["query"], r["title"], r["score"]) for r in got} == want and len(got) == len(want) > 20


def test_similar_titles_rank_and_limit(spark):
    queries = spark.createDataFrame([("abcdef",)], "query string")
    titles = spark.createDataFrame([(x,) for x in ("abcdeg", "abcdex", "abcdef", "z/abcdef", "abcdef more", "zzzzzz")], "title string")
    got = [(r["title"], r["rank"]) for r in similar.similar_titles(queries, titles, 0.74, 4).orderBy("rank").collect()]
    assert got == [("abcdef", 1), ("z/abcdef", 2), ("abcdeg", 3), ("abcdex", 4)]
    assert similar.similar_titles(queries.limit(0), titles, 0.74, 4).count() == 0 == similar.similar_titles(queries, titles.limit(0), 0.74, 4).count()
    with pytest.raises(ValueError):
        similar.similar_titles(queries, titles, 0.0, 4)
