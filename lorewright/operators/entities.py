"""A graph of what chunks speak of, and ranks in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import cut_loop

#: Part of a rank that goes back to where the walk began, and the rounds of it.
RESTART, ROUNDS = 0.15, 20


def entity_key(name: Column) -> Column:
    """What names of one entity have alike: the last part of a target, in lower case, marks and spaces as one dash."""
    bare = F.lower(X.base_name(X.normal_target(name)))
    return F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def mentions(chunks: DataFrame, page: str = "rel_path") -> DataFrame:
    """(``chunk``, ``id``, ``label``): an entity for each link of a chunk, and one for its own page; each once a chunk."""
    linked = chunks.select(F.col("chunk_id").alias("chunk"), F.explode(X.wikilinks(F.coalesce("content", F.lit("")))).alias("label"))
    own = chunks.select(F.col("chunk_id").alias("chunk"), X.strip_suffix(X.base_name(F.col(page))).alias("label"))
    keyed = linked.unionByName(own).where("chunk is not null").select("chunk", entity_key(F.col("label")).alias("id"), X.strip(F.col("label")).alias("label"))
    return keyed.where("id <> ''").groupBy("chunk", "id").agg(F.min("label").alias("label"))


def entity_graph(chunks: DataFrame, page: str = "rel_path", most_sources: int = 64) -> tuple[DataFrame, DataFrame]:
    """Entities (``id``, ``label``, ``n``, ``sources``) and edges (``source``, ``target``, ``relation``, ``weight``, ``sources``).

    Names are one entity if they have one key; the label is the name that most
    chunks have, the least of such.  Two entities of a chunk have an edge, source
    before target, which weighs as many chunks as have both.  ``sources`` are the
    chunks, the least ``most_sources`` of them; ``n`` and ``weight`` count all.
    Pairs are of one chunk, so a chunk's size bounds them.
    """
    found = cut_loop(mentions(chunks, page))
    # Labels and chunks are counted apart, in parts of like size, before they meet.
    named = found.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.sum("n").alias("n"))
    entities = named.join(_least(found, ["id"], most_sources), "id")
    other = found.select("chunk", F.col("id").alias("target"))
    pairs = found.select("chunk", F.col("id").alias("source")).join(other, "chunk").where("source < target")
    weights = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    edges = weights.join(_least(pairs, ["source", "target"], most_sources), ["source", "target"])
    return entities, edges.select("source", "target", F.lit("mentioned with").alias("relation"), "weight", "sources")


def _least(rows: DataFrame, by: list[str], k: int, parts: int = 32) -> DataFrame:
    """The least k chunks of each ``by``: of each part first, so that no task holds all of a frequent one."""
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts))
    least = lambda c: F.slice(F.array_sort(c), 1, k)
    some = rows.groupBy(*by, part.alias("part")).agg(least(F.collect_set("chunk")).alias("some"))
    return some.groupBy(*by).agg(least(F.flatten(F.collect_list("some"))).alias("sources"))


def personal_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """(``id``, ``rank``) of a walk over undirected weighted edges that begins, and begins again, at the seeds (``id``).

    In each round a node's rank goes to its neighbours by weight, but for the share
    ``restart``, which goes back to the seeds, as does all of a node without edges.
    Ranks add up to 1.  A round is one join and one sum; nodes no walk has come to
    have no row.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.where("source <> target").select(F.col("source").alias("x"), F.col("target").alias("y"), weight.alias("w"))
    links = one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")).groupBy("x", "y").agg(F.sum("w").alias("w"))
    degree = links.groupBy("x").agg(F.sum("w").alias("d"))
    shares = cut_loop(links.join(degree, "x").select("x", "y", (F.col("w") / F.col("d")).alias("p")))
    start = cut_loop(seeds.select("id").distinct().crossJoin(F.broadcast(seeds.select(F.count_distinct("id").alias("n")))).select("id", (1.0 / F.col("n")).alias("s")))
    rank = start.select("id", F.col("s").alias("rank"))
    for _ in range(rounds):
        went = rank.join(shares, F.col("id") == F.col("x")).groupBy(F.col("y").alias("id")).agg((F.sum(F.col("rank") * F.col("p")) * (1 - restart)).alias("rank"))
        back = went.agg((1 - F.coalesce(F.sum("rank"), F.lit(0.0))).alias("back"))
        home = start.crossJoin(F.broadcast(back)).select("id", (F.col("s") * F.col("back")).alias("rank"))
        rank = cut_loop(went.unionByName(home).groupBy("id").agg(F.sum("rank").alias("rank")))
    return rank


def community_hits(ranks: DataFrame, communities: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(``chunk``, ``score``): chunks of the ``most`` communities with the greatest sum of ranks; a chunk's score is its entities' ranks, weighed by their community's."""
    met = ranks.join(communities, "id")
    sums = met.groupBy("community").agg(F.sum("rank").alias("share")).orderBy(F.desc("share"), "community").limit(most)
    kept = met.join(F.broadcast(sums), "community").join(entities.select("id", "sources"), "id")
    return kept.select(F.explode("sources").alias("chunk"), (F.col("rank") * F.col("share")).alias("s")).groupBy("chunk").agg(F.sum("s").alias("score"))
