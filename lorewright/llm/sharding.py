"""Jump consistent hashing as a column expression.

A key and a number of buckets give a bucket; with one more bucket a key stays
or moves to the new one.  The 64-bit generator is kept in limbs of 22, 22 and
20 bits, so that its products never overflow a signed long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the generator.
_MULTIPLIER = 2862933555777941757
_LOW, _TOP = (1 << 22) - 1, (1 << 20) - 1
_M0, _M1, _M2 = _MULTIPLIER & _LOW, (_MULTIPLIER >> 22) & _LOW, _MULTIPLIER >> 44


def jump_hash(key: Column, buckets: int) -> Column:
    """The bucket of a 64-bit key, 0 to ``buckets`` - 1; null for a null key."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    at = lambda x, n, mask: F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(at(key, 0, _LOW).alias("a"), at(key, 22, _LOW).alias("b"), at(key, 44, _TOP).alias("c"), zero.alias("at"), zero.alias("next"))

    def step(s, _):
        a = s["a"] * _M0 + 1
        b = s["a"] * _M1 + s["b"] * _M0 + F.shiftright(a, 22)
        c = s["a"] * _M2 + s["b"] * _M1 + s["c"] * _M0 + F.shiftright(b, 22)
        a, b, c = (x.bitwiseAND(F.lit(m).cast("long")) for x, m in ((a, _LOW), (b, _LOW), (c, _TOP)))
        top = F.shiftleft(c, 11) + F.shiftright(b, 11)
        ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long")
        moved = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), s["next"].alias("at"), ahead.alias("next"))
        return F.when(s["next"] < buckets, moved).otherwise(s)

    # Jumps are about as many as the logarithm of the buckets; the rare key that needs more takes them all.
    usual = min(buckets, 16 + 4 * buckets.bit_length())
    out = lambda steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    if usual == buckets:
        return out(buckets)["at"].cast("int")
    return F.transform(F.array(out(usual)), lambda s: F.when(s["next"] >= buckets, s["at"]).otherwise(out(buckets)["at"]))[0].cast("int")


def key_hash(rows: DataFrame, key: str) -> Column:
    """64 bits of a key of any type that Spark hashes; a null integer is as 0."""
    whole = rows.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.xxhash64(F.coalesce(F.col(key), F.lit(0)).cast("long")) if whole else F.xxhash64(F.col(key))


def assign_shards(rows: DataFrame, key: str, shards: int, groups: int | None = None) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one shard more) and ``slot``.

    Only the key and the number of shards decide the shard.  Slots count from
    0 without gaps in each shard.  They are numbered in two levels: within
    (shard, part of the row's hash), then by an offset that each part gets from
    a table of counts with ``shards`` times ``groups`` rows, which is
    broadcast; so no task holds a shard, nor all rows of one key.  In a part
    rows are in the order of key and row hash, so slots are the same in every
    run; only rows alike in all columns can change places.

    Keys are integers or of any other type that Spark hashes.  A null integer has
    the place of 0, any other null one of its own.  Rows of one key share a shard
    and have slots of their own.  Columns of the input named as the results are
    dropped in their favour; a ``key`` of such a name is a ValueError.  Maps are
    not part of the row's hash.  An empty table gives no rows.
    """
    made = ("shard", "grown_shard", "slot")
    if key in made:
        raise ValueError(f"{key} is the name of a result")
    spark = rows.sparkSession
    groups = groups or min(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    kept = [c for c in rows.columns if c not in made]
    hashed = [F.col(c) for c in kept if "map<" not in rows.schema[c].dataType.simpleString() and rows.schema[c].dataType.simpleString() != "variant"]
    rows = rows.select(F.struct(*kept).alias("r"), key_hash(rows, key).alias("h"), F.xxhash64(*hashed).alias("row"))
    placed = rows.select("r", "row", jump_hash(F.col("h"), shards).alias("shard"), jump_hash(F.col("h"), shards + 1).alias("grown"), F.pmod(F.xxhash64("h", "row"), F.lit(groups)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    order = [F.col("r")[key].asc_nulls_first(), F.col("row")]
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("shard", "part").orderBy(*order)))
    joined = ranked.join(F.broadcast(offsets), ["shard", "part"])
    return joined.select("r.*", "shard", F.col("grown").alias("grown_shard"), (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
