"""Communities by modularity: local moves, then a graph of communities, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_loop

#: A level ends after so many rounds that did not raise the modularity.
STILL = 4
_LEAST = 1e-9


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by merging: a side of as many rows as there are nodes, broadcast in each round, would pass the driver."""
    return left.join(right.hint("merge"), on, how)


def _quality(links: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of labels (``x``, ``c``) over weighted links (``x``, ``y``, ``w``), each there both ways."""
    ends = _met(links, labels, "x").groupBy("c", "y").agg(F.sum("w").alias("w"))
    met = _met(ends, labels.select(F.col("x").alias("y"), F.col("c").alias("d")), "y")
    each = met.groupBy("c").agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("all"))
    return each.agg(F.sum(F.col("inner") / total - (F.col("all") / total) * (F.col("all") / total))).first()[0] or 0.0


def _moved(links: DataFrame, labels: DataFrame, degree: DataFrame, total: float, turn: int) -> DataFrame:
    """Labels after nodes of one half have gone where their modularity gain is greatest."""
    held = _met(labels, degree, "x").groupBy("c").agg(F.sum("k").alias("held"), F.count(F.lit(1)).alias("n"))
    seen = _met(links.where("x <> y"), labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("w").alias("w"))
    own = _met(_met(labels, degree, "x"), held, "c").select("x", F.col("c").alias("own"), "k", (F.col("n") == 1).alias("alone"))
    # A node that has no link into its own community can still stay there.
    options = seen.unionByName(labels.select("x", "c", F.lit(0.0).alias("w"))).groupBy("x", "c").agg(F.sum("w").alias("w"))
    gain = F.col("w") - F.col("k") * (F.col("held") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
    scored = _met(_met(options, own, "x"), held, "c").withColumn("gain", F.round(gain, 9))
    # Of two nodes that are alone the greater goes to the lesser, so they do not change places.
    scored = scored.where(~(F.col("alone") & (F.col("n") == 1) & (F.col("c") > F.col("own"))))
    best = scored.groupBy("x", "own").agg(F.max("gain").alias("top"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("c"))
    goes = (F.col("top") > F.col("stay") + _LEAST) & (F.pmod(F.xxhash64("x", F.lit(turn // 2)), F.lit(2)) == turn % 2)
    return best.select("x", F.when(goes, F.col("c")).otherwise(F.col("own")).alias("c"))


def louvain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``id``, ``community``) of every node; communities are named by one of their nodes.

    Edges have ``source`` and ``target``, and ``weight`` if they have one; loops and
    edges that come again add up.  In a round the nodes of one half, by hash, move to
    the neighbouring community, or stay, wherever the gain is greatest, ties to the
    least; the other half holds still, which keeps two nodes from changing places.
    The best labels that a level has seen are kept; so it never falls, and ends after
    a few rounds without a rise.  Communities are then the nodes of a smaller graph,
    until nothing joins.  Tables of each round are written and joined by merging, and
    the driver gets one number of each.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("source").alias("x"), F.col("target").alias("y"), weight.alias("w"))
    links = cut_loop(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")).groupBy("x", "y").agg(F.sum("w").alias("w")))
    members = cut_loop(nodes.select("id", F.col("id").alias("c")).distinct())
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return members.withColumnRenamed("c", "community")
    while True:
        degree = cut_loop(links.groupBy("x").agg(F.sum("w").alias("k")))
        labels = best = degree.select("x", F.col("x").alias("c"))
        first = top = _quality(links, labels, total)
        turn = still = 0
        while still < STILL:
            labels = cut_loop(_moved(links, labels, degree, total, turn))
            now = _quality(links, labels, total)
            still = 0 if now > top + _LEAST else still + 1
            if now > top + _LEAST:
                top, best = now, labels
            turn += 1
        if top <= first + _LEAST:
            return members.withColumnRenamed("c", "community")
        up = best.select(F.col("x").alias("c"), F.col("c").alias("up"))
        members = cut_loop(_met(members, up, "c", "left").select("id", F.coalesce("up", "c").alias("c")))
        ends = _met(links, best, "x").groupBy("c", "y").agg(F.sum("w").alias("w"))
        links = cut_loop(_met(ends, best.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").groupBy("c", "d").agg(F.sum("w").alias("w")).select(F.col("c").alias("x"), F.col("d").alias("y"), "w"))
