"""Titles like others: equal names, containment and edit distance, each found by keys of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Characters of the parts by which one string is found in another.
GRAM = 3
#: Shorter names than this are not compared by edits.
LEAST_NAME = 5


def _edits(length: Column, least: float) -> Column:
    """Edits that a pair may differ in, whose longer string has this length."""
    return F.floor((1 - least) * length + 1e-9).cast("int")


def _segment(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start, from 0, and length of the i-th of ``edits + 1`` even segments, the longer ones last."""
    base, longer = F.floor(length / (edits + 1)), length % (edits + 1)
    first_longer = edits + 1 - longer
    return (i * base + F.greatest(F.lit(0), i - first_longer)).cast("int"), (base + F.when(i >= first_longer, 1).otherwise(0)).cast("int")


def near_names(queries: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """Pairs (``query``, ``title``) whose names (``p`` and ``q``) may be within the edits that ``least`` allows.

    A title's name in ``edits + 1`` segments has one that no edit touches, and that
    stands in the query's name, shifted by no more than the edits beside it can
    shift it.  So a title gives a key per segment and a query one per place where
    a segment may be, both with the length of the title and the edits.
    """
    t = titles.select("title", "q", F.length("q").alias("m")).where(F.col("m") >= LEAST_NAME)
    # Longer strings of a pair are from m to m / least long; few numbers of edits follow.
    t = t.withColumn("e", F.explode(F.sequence(_edits(F.col("m"), least), _edits(F.floor(F.col("m") / least), least))))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    start, size = _segment(F.col("m"), F.col("e"), F.col("i"))
    t = t.select("title", "m", "e", "i", F.substring("q", start + 1, size).alias("part"))
    s = queries.select("query", "p", F.length("p").alias("n")).where(F.col("n") >= LEAST_NAME)
    low, high = F.greatest(F.lit(LEAST_NAME), F.ceil(F.col("n") * least - 1e-9)).cast("int"), F.floor(F.col("n") / least + 1e-9).cast("int")
    s = s.where(low <= high).withColumn("m", F.explode(F.sequence(low, high))).withColumn("e", _edits(F.greatest("n", "m"), least)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    start, size = _segment(F.col("m"), F.col("e"), F.col("i"))
    shift, after = F.col("n") - F.col("m"), F.col("e") - F.col("i")
    first = F.greatest(F.lit(0), start - F.col("i"), start + shift - after)
    last = F.least(F.col("n") - size, start + F.col("i"), start + shift + after)
    s = s.select("query", "p", "m", "e", "i", size.alias("size"), first.alias("first"), last.alias("last")).where("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    s = s.select("query", "m", "e", "i", F.substring("p", F.col("at") + 1, F.col("size")).alias("part")).distinct()
    return s.join(t, ["m", "e", "i", "part"]).select("query", "title")


def _grams(c: Column, size: int) -> Column:
    return F.transform(F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(size)))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of which ``x`` of ``inner`` stands in ``y`` of ``outer``.

    ``inner`` has ``a`` and ``x``, ``outer`` has ``b`` and ``y``.  What stands in a
    string has all its parts there, so it is looked up by one alone, the rarest.
    """
    parts = outer.select("b", "y", F.explode(F.array_distinct(F.concat(*(_grams(F.col("y"), n) for n in range(1, GRAM + 1))))).alias("part"))
    own = F.when(F.length("x") <= GRAM, F.array("x")).otherwise(_grams(F.col("x"), GRAM))
    wanted = inner.where("x <> ''").select("a", "x", F.explode(F.array_distinct(own)).alias("part"))
    held = parts.groupBy("part").agg(F.count(F.lit(1)).alias("df"))
    # A part that no string has means that none has the whole.
    best = wanted.join(held, "part", "left").groupBy("a", "x").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "part")).alias("m")).where("m.df > 0")
    return best.select("a", "x", F.col("m.part").alias("part")).join(parts, "part").where(F.contains("y", F.col("x"))).select("a", "b")


def similar_titles(queries: DataFrame, titles: DataFrame, least: float, limit: int) -> DataFrame:
    """(``query``, ``title``, ``score``, ``rank``): the titles most like a query, of a score of ``least`` or more.

    Names that are equal, targets of which one holds the other, and names a few
    edits apart are found each by keys of its own; nothing is missed, and pairs that
    merely share common characters do not meet.  Nulls and empty targets are like
    nothing; repeated rows count once; equal scores rank by title.  ``least`` is above 0.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    left = queries.select("query").distinct().withColumn("x", X.normal_target(F.col("query"))).where("x <> ''").withColumn("p", X.base_name(F.col("x")))
    right = titles.select("title").distinct().withColumn("y", X.normal_target(F.col("title"))).where("y <> ''").withColumn("q", X.base_name(F.col("y")))
    found = left.join(right, F.col("p") == F.col("q")).select("query", "title").unionByName(near_names(left, right, least))
    if least <= X.CONTAINED:
        found = found.unionByName(contained(left.select(F.col("query").alias("a"), "x"), right.select(F.col("title").alias("b"), "y")).toDF("query", "title"))
        found = found.unionByName(contained(right.select(F.col("title").alias("a"), F.col("y").alias("x")), left.select(F.col("query").alias("b"), F.col("x").alias("y"))).toDF("title", "query"))
    scored = found.distinct().withColumn("score", X.similarity(F.col("query"), F.col("title"))).where(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "title")))
    return ranked.where(F.col("rank") <= limit)
