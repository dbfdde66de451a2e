"""Duplicates and their merging: exact copies, groups, arrays, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import cut
from ..schema import SOURCES

BATCH, STRIDE = 80, 72


def new_materials(incoming: DataFrame, known: DataFrame | None = None, seq: str = "seq", check_source: bool = False) -> DataFrame:
    """The first row of each content that is not known yet, with ``hash``.

    Empty contents give none; the order is that of ``seq``, and of rows equal in
    both one stays.  With ``check_source`` a source that is none of the known ones
    is an error.  Only the hashes of contents and ``seq`` are grouped, so a content
    that many rows share is reduced before it moves.
    """
    if check_source:
        known_source = F.col("source").isin(*SOURCES)
        incoming = incoming.withColumn("source", F.when(known_source, F.col("source")).otherwise(F.raise_error(F.concat(F.lit("no source: "), F.coalesce("source", F.lit("null"))))))
    body = incoming.withColumn("content", X.strip(F.col("content"))).where("content <> ''").withColumn("hash", X.content_hash(F.col("content")))
    if known is not None:
        body = body.join(known.select("hash"), "hash", "left_anti")
    first = body.groupBy("hash").agg(F.min(seq).alias("__first"))
    met = body.join(first, (body["hash"] == first["hash"]) & (body[seq] == first["__first"])).drop(first["hash"]).drop("__first")
    return met.dropDuplicates(["hash"])


def exact_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(``hash``, ``first``, ``copies``) of each distinct non-empty content."""
    body = rows.select(key, X.strip(F.col(content)).alias("c")).where("c <> ''")
    return body.groupBy(X.content_hash(F.col("c")).alias("hash")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``p``, their place in the order, from ordered ranges and their counts, not from one sorted task."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    # The ranges are drawn from a sample; positions and counts must see the same ones.
    spread = cut(spread)
    counts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__low"))
    before = counts.select("__p", "__low", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return spread.join(F.broadcast(before), "__p").withColumn("p", F.col("__before") + F.col("__m") - F.col("__low")).select(*rows.columns, "p")


def overlapping_batches(rows: DataFrame, order: list[str], size: int = BATCH, stride: int = STRIDE) -> DataFrame:
    """Rows with ``batch``: batches of ``size`` that overlap, none of one row."""
    ordered = positions(rows, order)
    placed = ordered.crossJoin(F.broadcast(ordered.agg(F.count(F.lit(1)).alias("__total"))))
    first = F.greatest(F.lit(0), F.floor((F.col("p") - size) / stride) + 1)
    dealt = placed.withColumn("batch", F.explode(F.when(F.col("__total") <= size, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first.cast("long"), F.floor(F.col("p") / stride).cast("long")))))
    # A batch starts at stride * batch; the last is left out if but one row is in it.
    alone = (F.col("__total") > size) & (F.col("__total") - F.col("batch") * stride < 2)
    return dealt.where(~alone).select(*rows.columns, "p", "batch")


def first_per_key(groups: DataFrame, slugs: str = "slugs", seq: str = "seq") -> DataFrame:
    """The first group of each key (slugs lower-cased, sorted), with ``group_key``."""
    keyed = groups.withColumn("group_key", X.group_key(F.col(slugs)))
    return keyed.withColumn("__r", F.row_number().over(W.partitionBy("group_key").orderBy(seq))).where("__r = 1").drop("__r")


def not_whitelisted(groups: DataFrame, whitelist: DataFrame, slugs: str = "slugs") -> DataFrame:
    known = whitelist.select(X.group_key(F.col(slugs)).alias("group_key")).distinct()
    return groups.withColumn("group_key", X.group_key(F.col(slugs))).join(known, "group_key", "left_anti")


def ci_union(first: Column, second: Column) -> Column:
    """Both arrays' values, case apart once, with the case seen first."""
    return F.aggregate(F.concat(first, second), F.array().cast("array<string>"), lambda done, x: F.when(F.exists(done, lambda y: F.lower(y) == F.lower(x)), done).otherwise(F.concat(done, F.array(x))))


def merged_values(rows: DataFrame, key: str, values: str, order: str) -> DataFrame:
    """(``key``, ``values``): union over a group's rows, case apart, later rows' values last."""
    flat = rows.select(key, order, F.posexplode(values).alias("pos", "v"))
    first = flat.groupBy(key, F.lower("v").alias("low")).agg(F.min(F.struct(order, "pos", "v")).alias("m"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["v"]).alias(values))


def redirected(related: Column, redirects: dict[str, str]) -> Column:
    """Slugs with merged ones replaced, case apart once."""
    if not redirects:
        return related
    known = F.create_map(*[F.lit(x) for kv in redirects.items() for x in kv])
    return ci_union(F.array().cast("array<string>"), F.transform(related, lambda s: F.coalesce(F.try_element_at(known, s), s)))


def redirect_links(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """Links whose target was merged away point to what it became."""
    met = links.join(redirects.select(F.col("slug").alias("target"), "canonical"), "target", "left")
    return met.withColumn("target", F.coalesce("canonical", "target")).select(*links.columns)


def conflict_names(names: DataFrame, existing: DataFrame, key: str = "seq") -> DataFrame:
    """(``key``, ``stem``, ``name``): stem, stem-2, ... the first free ones in order.

    ``existing`` has the stems and numbers taken (``stem``, ``n``; 1 for the bare
    stem).  Free numbers are dealt in order to the names of a stem.
    """
    rank = names.withColumn("r", F.row_number().over(W.partitionBy("stem").orderBy(key)))
    taken = existing.groupBy("stem").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    met = rank.join(taken.hint("merge"), "stem", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<long>")))
    # The r-th free number is r plus the taken ones at or below it.
    free = F.aggregate("taken", F.col("r").cast("long"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return met.select(key, "stem", F.when(free == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), free.cast("string"))).alias("name"))
