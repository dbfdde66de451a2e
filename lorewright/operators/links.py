"""Links between pages: resolution, checks and suggestions.

A page row has ``idx`` (its order), ``slug``, ``name`` (path below the root) and
``title``; a link row has ``src`` (a page's idx), ``pos`` and ``target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import similar
from .overlaps import top_overlaps

CANDIDATES = 64
#: Proposals of one key that one task takes.
PIECE = 16_384
BROKEN_SCORE, RELATED_SCORE, FOLDER_BONUS, SHORT_TOKEN = 0.74, 0.08, 0.08, 0.35


def links_of(pages: DataFrame, body: str = "body") -> DataFrame:
    return pages.select(F.col("idx").alias("src"), F.posexplode(X.wikilinks(F.col(body))).alias("pos", "target"))


def page_keys(pages: DataFrame) -> DataFrame:
    """(``key``, ``dst``): by slug and by bare name, the last page of a key wins."""
    by_slug = pages.select(X.normal_target(F.col("slug")).alias("key"), "idx")
    by_name = pages.select(X.normal_target(X.base_name(F.col("name"))).alias("key"), "idx")
    return by_slug.unionByName(by_name).groupBy("key").agg(F.max("idx").alias("dst"))


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with ``dst``: the page of the whole target, else of its last part, else null."""
    keys = page_keys(pages)
    whole = links.withColumn("key", X.normal_target(F.col("target"))).join(keys.withColumnRenamed("dst", "whole").hint("merge"), "key", "left").drop("key")
    part = whole.withColumn("key", X.normal_target(X.base_name(F.col("target")))).join(keys.withColumnRenamed("dst", "part").hint("merge"), "key", "left").drop("key")
    return part.select(*links.columns, F.coalesce("whole", "part").alias("dst"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return resolve_links(links, pages).where("dst is null").drop("dst")


def inbound_degree(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(``idx``, ``inbound``) of every page; links count as often as they stand."""
    counts = resolve_links(links, pages).where("dst is not null").groupBy("dst").agg(F.count(F.lit(1)).alias("inbound"))
    return pages.join(counts, pages["idx"] == counts["dst"], "left").select("idx", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"))


def orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    linked = resolve_links(links, pages).where("dst is not null").select(F.col("dst").alias("idx"))
    return pages.join(linked.hint("merge"), "idx", "left_anti")


def without_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.join(links.select(F.col("src").alias("idx")).hint("merge"), "idx", "left_anti")


def _weighed(keys: Column, weight=None) -> Column:
    return F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("key"), (F.lit(1) if weight is None else weight(x)).cast("int").alias("w")))


def suggest_for_broken(broken: DataFrame, pages: DataFrame, least: float = BROKEN_SCORE) -> DataFrame:
    """(``target``, ``suggestion``, ``score``) of each distinct broken target.

    Targets meet pages over shared character pairs, counted once for each of
    slug, name and title; the 64 best by count are scored, so edit distances
    are taken for few pairs only.  See ``top_overlaps`` for how they meet.  Names
    are dealt out before they become pairs, which are many times as much.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = broken.select("target").distinct().repartition(n, "target").select(F.col("target").alias("id"), _weighed(X.bigrams(F.col("target"))).alias("keys"))
    # Pages of a like slug are near each other.
    dealt = pages.select("idx", "slug", "name", "title").repartitionByRange(n, "slug", "idx").sortWithinPartitions("slug", "idx")
    right = dealt.select("idx", _weighed(F.concat(*(X.bigrams(F.coalesce(c, F.lit(""))) for c in (F.col("slug"), F.col("name"), F.col("title"))))).alias("keys"))
    # Both sides are made normal before they meet, once for each target and page.
    both = lambda c, to: (X.normal_target(F.col(c)).alias(to), X.base_name(X.normal_target(F.col(c))).alias(f"{to}_base"))
    fields = ("slug", "name", "title")
    top = top_overlaps(left, right, CANDIDATES, alike=True).select(F.col("id").alias("target"), "idx", "rank", *both("id", "said"))
    met = top.join(pages.select("idx", F.col("name").alias("suggestion"), *(x for c in fields for x in both(c, c))).hint("merge"), "idx")
    score = F.greatest(*(X.alike(F.col("said"), F.col(c), F.col("said_base"), F.col(f"{c}_base"), least) for c in fields))
    # Not filtered before it is grouped, as a filter would take the score a second time.
    scored = met.select("target", "suggestion", "rank", score.alias("score"))
    best = scored.groupBy("target").agg(F.max_by(F.struct("suggestion", "score"), F.struct("score", -F.col("rank"))).alias("x"))
    return best.where(F.col("x.score") >= least).select("target", "x.suggestion", "x.score")


def suggest_related(pages: DataFrame, tokens: DataFrame, linked: DataFrame | None = None, least: float = RELATED_SCORE, asks: DataFrame | None = None) -> DataFrame:
    """(``idx``, ``suggestion``, ``score``): the page with the most like tokens, for all pages or those of ``asks`` (``idx``).

    ``tokens`` has distinct (``idx``, ``token``).  Tokens of more than a quarter
    of the pages, and more than 20, say nothing and are left out.  A token of one
    character weighs 0.35, others 1; the 64 pages with the most are scored.  See
    ``top_overlaps`` for how pages meet.  ``linked`` (``idx``, ``dst``) are pages
    that need no suggestion.
    """
    total = pages.agg(F.greatest(F.lit(20), F.ceil(F.count(F.lit(1)) * 0.25)).alias("most"))
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total), F.col("df") <= F.col("most")).select("token")
    sizes = tokens.groupBy("idx").agg(F.count(F.lit(1)).alias("size"))
    # In twentieths, so that sums are exact.
    unit = lambda t: F.when(F.length(t) > 1, F.lit(20)).otherwise(F.lit(round(20 * SHORT_TOKEN)))
    held = tokens.join(rare, "token").groupBy("idx").agg(F.collect_list("token").alias("t")).select("idx", _weighed(F.col("t"), unit).alias("keys"))
    asking = held if asks is None else held.join(asks.select("idx").hint("merge"), "idx", "left_semi")
    pairs = top_overlaps(asking.withColumnRenamed("idx", "id"), held, CANDIDATES, others=True)
    top = pairs.select(F.col("id").alias("idx"), F.col("idx").alias("other"), (F.col("weight") / 20).alias("overlap"), "rank")
    if linked is not None:
        top = top.join(linked.select("idx", F.col("dst").alias("other")), ["idx", "other"], "left_anti")
    folder = lambda c: F.substring_index(c, "/", 1)
    about = pages.select("idx", folder("name").alias("folder"), F.col("name").alias("suggestion")).join(sizes.hint("merge"), "idx")
    theirs = about.select(F.col("idx").alias("other"), F.col("folder").alias("other_folder"), "suggestion", F.col("size").alias("other_size"))
    met = top.join(about.drop("suggestion").hint("merge"), "idx").join(theirs.hint("merge"), "other")
    bonus = F.when(F.col("folder") == F.col("other_folder"), F.lit(FOLDER_BONUS)).otherwise(F.lit(0.0))
    scored = met.select("idx", "suggestion", "rank", (F.col("overlap") / F.sqrt(F.col("size") * F.col("other_size").cast("double")) + bonus).alias("score"))
    best = scored.groupBy("idx").agg(F.max_by(F.struct("suggestion", "score"), F.struct("score", -F.col("rank"))).alias("x"))
    return best.where(F.col("x.score") >= least).select("idx", "x.suggestion", "x.score")


def similar_titles(queries: DataFrame, titles: DataFrame, least: float = BROKEN_SCORE, limit: int = CANDIDATES) -> DataFrame:
    """The titles most like a query; see ``similar``."""
    return similar.similar_titles(queries, titles, least, limit)


def canonical_keys(slugs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(``key``, ``slug``) of the keys that one slug alone has."""
    keyed = slugs.select(F.lower(X.strip(F.col("slug"))).alias("key"), "slug")
    return (keyed if tasks is None else keyed.repartition(tasks, "key")).groupBy("key").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("slug")).where("n = 1").drop("n")


def valid_proposals(proposals: DataFrame, slugs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Proposed links whose target is known, with the target's own slug.

    With ``tasks``, the join is by merging in so many tasks, and proposals of a key
    that many have are dealt to pieces, each of which meets the slug.  Proposals are
    then read twice, so they should be a table.
    """
    keyed = proposals.withColumn("key", X.link_key(F.col("target"))).where("key is not null")
    known = canonical_keys(slugs, tasks).withColumnRenamed("slug", "canonical")
    if tasks is None:
        return keyed.join(known, "key").drop("key")
    # At most one key of so many proposals, so these rows can be broadcast.
    hot = F.broadcast(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PIECE).select("key", F.ceil(F.col("__n") / PIECE).cast("int").alias("__pieces")))
    pieces = F.coalesce("__pieces", F.lit(1))
    a = keyed.join(hot, "key", "left").withColumn("__piece", F.pmod(F.xxhash64(*proposals.columns), pieces).cast("int")).drop("__pieces")
    b = known.join(hot, "key", "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    on = ["key", "__piece"]
    return a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on).drop(*on)


def duplicate_names(pages: DataFrame) -> DataFrame:
    """(``kind``, ``idx``, ``first_idx``): later pages of a name or title."""
    out = None
    for kind, key in (("slug", X.normal_target(X.base_name(F.col("name")))), ("title", F.lower(X.strip(F.regexp_replace("title", r"\s+", " "))))):
        keyed = pages.select(F.lit(kind).alias("kind"), "idx", key.alias("key")).where("key <> ''")
        first = F.min("idx").over(W.partitionBy("key"))
        found = keyed.select("kind", "idx", first.alias("first_idx")).where("idx > first_idx")
        out = found if out is None else out.unionByName(found)
    return out


def wiki_paths(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets with ``path``: with a slash by whole path, else by slug, first page wins."""
    by_path = pages.groupBy(F.lower(X.strip_suffix(F.col("name"))).alias("key")).agg(F.min_by("name", "idx").alias("by_path"))
    by_slug = pages.groupBy(F.lower("slug").alias("key")).agg(F.min_by("name", "idx").alias("by_slug"))
    keyed = targets.withColumn("key", X.normal_target(F.col("target")))
    met = keyed.join(by_path, "key", "left").join(by_slug, "key", "left")
    return met.select(*targets.columns, F.when(F.contains("key", F.lit("/")), F.col("by_path")).otherwise(F.col("by_slug")).alias("path"))
