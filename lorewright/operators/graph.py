"""Typed graphs: normalisation, degrees, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import budget
from ..plans.lineage import cut_loop


def export(nodes: DataFrame, edges: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Nodes, the last of an id; edges, the first of (source, target, relation)."""
    rest = [c for c in nodes.columns if c != "id"]
    kept = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("v")).select("id", *[F.col(f"v.{c}").alias(c) for c in rest])
    first = edges.groupBy("source", "target", "relation").agg(F.min(order).alias(order))
    return kept, first


def simple_edges(edges: DataFrame, nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One undirected edge per pair of known nodes: ``source``, ``target`` as first
    seen, ``relation`` the distinct relations in order of appearance, joined.  Ids
    are met by merging, as a broadcast side would pass the driver."""
    ids = nodes.select("id").distinct()
    ok = edges.where("source <> target").join(ids.withColumnRenamed("id", "source").hint("merge"), "source", "left_semi").join(ids.withColumnRenamed("id", "target").hint("merge"), "target", "left_semi")
    pair = ok.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    each = pair.groupBy("a", "b", "relation").agg(F.min(F.struct(order, "source", "target")).alias("m"))
    out = each.groupBy("a", "b").agg(F.min("m").alias("first"), F.array_sort(F.collect_list(F.struct(F.col(f"m.{order}").alias("o"), "relation"))).alias("r"))
    return out.select(F.col("first.source").alias("source"), F.col("first.target").alias("target"), F.array_join(F.transform("r", lambda x: x["relation"]), " / ").alias("relation"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``id``, ``degree``) of every node, over undirected simple edges."""
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def sized(degree: DataFrame) -> DataFrame:
    """Degrees with ``size``, for drawing."""
    top = degree.agg(F.greatest(F.lit(1), F.max("degree")).alias("top"), F.count(F.lit(1)).alias("nodes"))
    return degree.crossJoin(F.broadcast(top)).select("id", "degree", budget.node_size(F.col("degree"), F.col("top"), F.col("nodes")).alias("size"))


def legend(nodes: DataFrame, order: str = "seq", limit: int = 12) -> DataFrame:
    """The most frequent types; of equal ones that seen first comes first."""
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(limit).select("type", "n")


def search_nodes(nodes: DataFrame, text: str, limit: int = 8) -> DataFrame:
    wanted = text.strip().lower()
    if not wanted:
        return nodes.limit(0)
    return nodes.where(F.contains(F.lower("label"), F.lit(wanted))).orderBy("seq", "id").limit(limit)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node).select(F.col("target").alias("id"), "relation").unionByName(edges.where(F.col("target") == node).select(F.col("source").alias("id"), "relation"))


def topology_key(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A key that does not depend on the order of nodes or edges."""
    part = lambda c: F.conv(F.left(F.md5(c), F.lit(15)), 16, 10).cast("long")
    n = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("n_nodes"), F.bit_xor(part(F.col("id").cast("string"))).alias("node_key"))
    ends = F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.bit_xor(part(ends)).alias("edge_key"))
    return n.crossJoin(e)


def view(nodes: DataFrame, edges: DataFrame, labels: int = 20, most: int = 500, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The part of a graph that is shown: nodes of the first types, so many of each, and edges among them."""
    types = nodes.groupBy("type").agg(F.min(order).alias("first")).orderBy("first").limit(labels).select("type")
    kept = nodes.join(F.broadcast(types), "type", "left_semi").withColumn("__r", F.row_number().over(W.partitionBy("type").orderBy(order, "id"))).where(F.col("__r") <= most).drop("__r")
    ids = kept.select("id")
    both = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, both


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``id``, ``component``): the least id that edges reach.

    Nodes hook to their least neighbour, pointer jumps lead all to the ends of
    their chains, and edges are rewritten to the ends.  At least half of the nodes
    go in a round, and jumps are as many as the logarithm of the longest chain.
    Joins are by merging, as a broadcast side of each would pass the driver.
    """
    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).where("x <> y")
    left = cut_loop(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    roots = nodes.select("id", F.col("id").alias("component")).distinct()
    while not left.isEmpty():
        hook = cut_loop(left.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p")))
        moved = True
        while moved:
            jump = cut_loop(hook.join(hook.select(F.col("x").alias("p"), F.col("p").alias("q")).hint("merge"), "p").select("x", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = not jump.where("moved").isEmpty()
            hook = jump.drop("moved")
        up = hook.select(F.col("x").alias("component"), F.col("p").alias("up"))
        roots = cut_loop(roots.join(up.hint("merge"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        near, far = hook.select("x", F.col("p").alias("px")), hook.select(F.col("x").alias("y"), F.col("p").alias("py"))
        left = cut_loop(left.join(near.hint("merge"), "x").join(far.hint("merge"), "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
    return roots


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``id``, ``community``): label propagation until nothing moves; see ``modularity``.

    A node takes the label that most of its neighbours have, and keeps its own
    among the best; other ties go to the least label.  Rounds move the nodes of
    one hash parity at a time, which keeps two sides from swapping labels, so
    a node's move never loses edges inside communities and the loop ends.
    Community numbers are those of a member.  Joins are by merging, as in ``components``.
    """
    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).unionAll(edges.select(F.col("target"), F.col("source")))
    both = cut_loop(both.where("x <> y").distinct())
    labels = cut_loop(nodes.select("id", F.col("id").alias("community")).distinct())
    k = still = 0
    while still < 2:
        seen = both.join(labels.select(F.col("id").alias("y"), "community").hint("merge"), "y").groupBy("x", "community").agg(F.count(F.lit(1)).alias("n"))
        met = seen.join(labels.select(F.col("id").alias("x"), F.col("community").alias("own")).hint("merge"), "x")
        best = met.groupBy("x").agg(F.max(F.struct("n", (F.col("community") == F.col("own")).alias("stays"))).alias("m"), F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("least"))
        turn = best.where("not m.stays").where(F.pmod(F.xxhash64("x", F.lit(k // 2 % 7)), F.lit(2)) == k % 2)
        moved = cut_loop(turn.select(F.col("x").alias("id"), F.col("least").alias("new")))
        still = still + 1 if moved.isEmpty() else 0
        if not still:
            labels = cut_loop(labels.join(moved.hint("merge"), "id", "left").select("id", F.coalesce("new", "community").alias("community")))
        k += 1
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``modularity`` of communities over simple edges, and their number."""
    at = lambda name, to: labels.select(F.col("id").alias(name), F.col("community").alias(to))
    met = edges.where("source <> target").join(at("source", "a"), "source").join(at("target", "b"), "target")
    inside = met.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("a") == F.col("b")).alias("inner"))
    ends = met.select(F.col("a").alias("c")).unionAll(met.select("b")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    squares = ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"))
    n = labels.agg(F.count_distinct("community").alias("communities"))
    return inside.crossJoin(squares).crossJoin(n).select((F.col("inner") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"), "communities")


def community_sizes(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """(``community``, ``n``), the largest first; so many if a limit is given."""
    counts = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community")
    return counts if limit is None else counts.limit(limit)


def node_sources(raw, separator: str = "<SEP>", most: int = 8):
    """Distinct sources of a node's joined chunk ids, chunk numbers cut off."""
    parts = F.transform(F.split(raw, separator), lambda x: F.regexp_replace(F.trim(x), r"-chunk-\d+$", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)
