"""Connected components of a link table, by contraction.

Each round every node hooks to its least neighbour, pointer jumps lead all to
the ends of their chains, and the links are rewritten to the ends; links that
fall together go.  At least half of the nodes go in a round, and a round has
as many jumps as the logarithm of its longest chain.  Every table of a round is
written, so a lost executor costs one round, and hubs meet only in joins that
can be split and in pre-aggregated minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node."""
    pairs = links.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    edges = runtime.cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    roots = None
    while not edges.isEmpty():
        hooked = runtime.cut(edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p")))
        while True:
            up = hooked.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = runtime.cut(hooked.join(up, "p").select("x", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            runtime.release(hooked)
            hooked = jumped
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            later = hooked.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            step = hooked.select(F.col("x").alias("root"), F.col("p").alias("up"))
            later = runtime.cut(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        near = hooked.select("x", F.col("p").alias("px"))
        far = hooked.select(F.col("x").alias("y"), F.col("p").alias("py"))
        half = runtime.cut(edges.join(near, "x").select("px", "y"))
        fewer = runtime.cut(half.join(far, "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
        runtime.release(edges, half, *([] if roots is None else [roots, hooked]))
        if roots is None:
            later = runtime.cut(later)
            runtime.release(hooked)
        roots, edges = later, fewer
    if roots is None:
        roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots
