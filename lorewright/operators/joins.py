"""Joins that Spark has no operator for: as of a time, on ranges, on overlapping intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stretches of time that a key's log is cut into.
PARTS = 64
#: Points of a bin that meet its ranges in one piece, and pairs that a task should have.
PIECE, PAIRS = 1024, 1 << 23


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], parts: int = PARTS) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` at or before its ``at``.

    Both sides become one log for each ``by``, and a running last value is taken, so
    a row meets no pairs.  Rows of ``right`` at the same time count in the order of
    their values, the greatest last.  Without an earlier row, or without an ``at``,
    the values are null.  Null keys are a key.

    A log is cut at quantiles of all times, so that no task holds a whole one, also
    if ``by`` is empty; what a stretch ends with is carried into the next ones.
    """
    held = F.struct(*values)
    kind = lambda df, c: df.select(c.alias("c")).schema["c"].dataType
    a = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind(right, held)).alias("__v"))
    b = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(kind(left, F.struct(*left.columns))).alias("__row"), held.alias("__v"))
    log = a.unionByName(b)
    # Cuts are of the type of the times; the driver gets one fewer than there are parts.
    cuts = sorted(set(log.agg(F.percentile_approx(_number(log, "__at"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []))
    part = reduce(lambda n, c: n + F.when(_number(log, "__at") >= F.lit(c), 1).otherwise(0), cuts, F.lit(0))
    log = log.withColumn("__part", part)
    w = W.partitionBy(*by, "__part").orderBy("__at", "__side", "__v").rowsBetween(W.unboundedPreceding, 0)
    within = log.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    ends = log.groupBy(*by, "__part").agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__v"))).alias("__end"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"__by_{k}") for k in by], F.col("__part").alias("__to"), F.last("__end", ignorenulls=True).over(before)["__v"].alias("__carried"))
    same = reduce(lambda x, k: x & within[k].eqNullSafe(carried[f"__by_{k}"]), by, F.col("__part") == F.col("__to"))
    met = within.join(carried, same, "left").withColumn("__v", F.when(F.col("__at").isNotNull(), F.coalesce("__v", "__carried")))
    return met.select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def _number(rows: DataFrame, name: str) -> Column:
    """A time as a number."""
    kind = rows.schema[name].dataType.simpleString()
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(name)


def _level(length: Column, width: float) -> Column:
    """How often the width must be doubled to be no less than the length."""
    return F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / F.lit(width)) - 1e-12).cast("int"))


def _bin(c: Column, level: Column, width: float) -> Column:
    return F.floor(c / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")


def _levels(*rows: DataFrame) -> Column:
    """All levels that any row has, as one array; few, as each is twice as wide as the one before."""
    found = sorted({r[0] for df in rows for r in df.select("__level").distinct().collect() if r[0] is not None})
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges that hold them (``low`` and ``high`` included).

    The line is cut into bins of ``width``, and into bins twice, four times as wide
    and so on.  A range is in the two bins, at most, that it touches of those as
    wide as it is long, and a point in one for each width that ranges have; so long
    ranges do not come again and again.  A width near the usual length of a range
    keeps the misses in a bin few.  Points of a bin are dealt to pieces, each of
    which meets all ranges of the bin, in as many tasks as there are pairs for.
    """
    held = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", _level(F.col(high) - F.col(low), width))
    spread = held.withColumn("__bin", F.explode(F.sequence(_bin(F.col(low), F.col("__level"), width), _bin(F.col(high), F.col("__level"), width))))
    at = points.withColumn("__level", F.explode(_levels(held))).withColumn("__bin", _bin(F.col(point), F.col("__level"), width))
    bins = ["__level", "__bin"]
    counts = at.groupBy(*bins).agg(F.count(F.lit(1)).alias("__n")).join(spread.groupBy(*bins).agg(F.count(F.lit(1)).alias("__m")), bins)
    pairs = counts.agg(F.sum(F.col("__n") * F.col("__m"))).first()[0] or 0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    pieces = counts.select(*bins, F.ceil(F.col("__n") / PIECE).cast("int").alias("__pieces"))
    key = F.xxhash64(*[F.col(c) for c, kind in points.dtypes if "map<" not in kind and "variant" not in kind])
    a = at.join(pieces, bins).withColumn("__piece", F.pmod(key, F.col("__pieces")).cast("int"))
    b = spread.join(pieces, bins).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
    on = [*bins, "__piece"]
    a, b = (x.drop("__pieces").repartition(tasks, *on) for x in (a, b))
    return a.join(b, on).where(F.col(point).between(F.col(low), F.col(high))).drop(*on)


def overlapping(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str, width: float) -> DataFrame:
    """Pairs of intervals of one ``by`` that overlap, each once; columns of ``b`` get a ``b_``.

    Intervals are half open.  They meet in the bins, as wide as the longer of the two,
    that both touch, and a pair counts in the first of them; so an interval is in
    two bins, at most, of each width from its own length on.
    """
    other = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    a = a.withColumn("__level", _level(F.col(end) - F.col(start), width))
    other = other.withColumn("__level", _level(F.col(f"b_{end}") - F.col(f"b_{start}"), width))
    levels = _levels(a, other)

    def spread(rows: DataFrame, s: str, e: str, side: str) -> DataFrame:
        rows = rows.withColumnRenamed("__level", f"__{side}").withColumn("__level", F.explode(F.filter(levels, lambda x: x >= F.col(f"__{side}"))))
        first = _bin(F.col(s), F.col("__level"), width)
        # The last bin is that of the last point before the end.
        last = F.greatest(first, F.ceil(F.col(e) / (F.lit(width) * F.pow(F.lit(2.0), F.col("__level")))).cast("long") - 1)
        return rows.withColumn(f"__first_{side}", first).withColumn("__bin", F.explode(F.sequence(first, last)))

    x, y = spread(a, start, end, "a"), spread(other, f"b_{start}", f"b_{end}", "b").withColumnsRenamed({"__level": "__b_level", "__bin": "__b_bin"})
    on = [F.col(k) == F.col(f"b_{k}") for k in by] + [F.col("__level") == F.col("__b_level"), F.col("__bin") == F.col("__b_bin")]
    met = x.join(y, reduce(lambda p, q: p & q, on)).where((F.col(start) < F.col(f"b_{end}")) & (F.col(f"b_{start}") < F.col(end)))
    once = met.where((F.col("__level") == F.greatest("__a", "__b")) & (F.col("__bin") == F.greatest("__first_a", "__first_b")))
    return once.select(*[c for c in a.columns if c != "__level"], *[c for c in other.columns if c != "__level"])
