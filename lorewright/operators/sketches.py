"""Sketches that are kept and merged: quantiles, frequent items and distinct counts of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch (a rank error of about 0.7 % at 400), items that a frequency sketch follows, and bits of a distinct count.
QUANTILE_SIZE, TRACKED, DISTINCT_BITS = 400, 1000, 14


def sketched(rows: DataFrame, by: list[str], value: str, item: str, size: int = QUANTILE_SIZE, tracked: int = TRACKED) -> DataFrame:
    """A row of sketches for each ``by``: ``n``, ``quantiles`` of ``value``, ``frequent`` and ``distinct`` of ``item``.

    The table is small and can be kept; what comes later is sketched alone and
    merged by ``merged``.  Nulls are in ``n`` alone.
    """
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("frequent"), F.hll_sketch_agg(item, DISTINCT_BITS).alias("distinct"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of longer periods from those of shorter ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr("approx_top_k_combine(frequent)").alias("frequent"), F.hll_union_agg("distinct").alias("distinct"))


def quantiles(sketches: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """(``by``, ``n``, ``at``, ``value``, ``distinct``): a row for each quantile that is asked for."""
    values = F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, at)))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("at"), values.alias("value"))).alias("q")
    return sketches.select(*by, "n", F.hll_sketch_estimate("distinct").alias("distinct"), each).select(*by, "n", F.col("q.at").alias("at"), F.col("q.value").alias("value"), "distinct")


def frequent_items(sketches: DataFrame, by: list[str], k: int) -> DataFrame:
    """(``by``, ``item``, ``count``): the k most frequent items; exact while no more are there than are tracked."""
    return sketches.select(*by, F.explode(F.expr(f"approx_top_k_estimate(frequent, {k})")).alias("f")).select(*by, "f.item", "f.count")
