"""Columns that leave the JVM hold few texts of a batch as Python objects."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewright.functions import parsers


def test_few_results_are_held_at_once(spark):
    live = [0]

    class Held(str):
        def __del__(self):
            live[0] -= 1

    def fn(text):
        live[0] += 1
        return Held(live[0])

    got = spark.range(0, 2000, 1, 1).select(parsers.column(fn, T.StringType())(F.col("id").cast("string")).cast("int").alias("n"))
    most, rows = got.agg(F.max("n"), F.count("n")).first()
    assert rows == 2000 and most <= 2 * parsers.SLICE


def test_kinds_and_nulls(spark):
    rows = spark.createDataFrame([("a",), (None,), ("",)], "t string").repartition(1)
    pair = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("of", T.ArrayType(T.StringType()))])
    maps = T.MapType(T.StringType(), T.StringType())
    out = rows.select("t", parsers.column(lambda t: {"n": len(t), "of": [t]}, pair)("t").alias("s"), parsers.column(lambda t: {"k": t}, maps)("t").alias("m")).collect()
    by = {r["t"]: (r["s"]["n"], r["s"]["of"], r["m"]) for r in out}
    assert by == {"a": (1, ["a"], {"k": "a"}), None: (0, [""], None), "": (0, [""], {"k": ""})}
