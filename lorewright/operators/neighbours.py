"""Nearest neighbours by random hyperplanes: signatures in several tables, candidates checked exactly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket, and such of them that ask, that meet in one task; larger buckets meet block by block.
BLOCK, ASKING = 4096, 1024
#: What a bucket should hold on the average.
BUCKET = 256


def plan(rows: int, least: float, recall: float, bits: int | None = None) -> tuple[int, int]:
    """Bits of a signature and number of tables, so that two rows of a cosine of ``least`` share a bucket with that chance.

    A hyperplane leaves them on one side with a chance of 1 - angle / pi.  Unless
    ``bits`` are given, they are as many as make buckets of about 256 rows.
    """
    bits = bits or max(1, round(math.log2(max(2, rows / BUCKET))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def nearest_by_hyperplanes(vectors: DataFrame, k: int = 8, least: float = 0.35, recall: float = 0.95, bits: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 7, asks: Column | None = None) -> DataFrame:
    """(``query``, ``neighbour``, ``score``, ``rank``): up to k others of each row with a cosine of ``least`` or more.

    With ``asks``, a condition on the columns of ``vectors``, the rows that it holds
    for are the queries, against all rows.  Buckets are then as wide as the number
    of queries allows, so rows are in few tables, and buckets without a query move
    nothing.

    Each pair of a cosine of ``least`` is found with a chance of ``recall``, and
    nearer ones more surely; scores are exact.  Equal scores rank by key, and of a
    key that comes again one row counts.  Null vectors and such without length have
    no neighbours and are none.  The lower ``least`` is, the more tables it takes:
    at 0.35 the work is no less than that of ``retrieval.nearest``, which is exact;
    at 0.8 and a million rows it is a hundredth.

    A bucket that holds many rows, such as copies, is dealt to blocks; each of those
    that ask meets each of all rows, and keeps k a query, so no pairs are collected.
    """
    wants = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = vectors.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), wants.alias("asks")).dropDuplicates(["id"])
    bits, tables = plan(rows.where("asks").count(), least, recall, bits)

    @F.pandas_udf("array<long>")
    def codes(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        data = np.stack(batch.to_numpy())
        planes = np.random.default_rng(seed).standard_normal((data.shape[1], tables * bits))
        sides = (data @ planes > 0).reshape(len(data), tables, bits)
        return pd.Series(list(sides @ (1 << np.arange(bits, dtype=np.int64))))

    dealt = rows.select("id", "v", "asks", F.posexplode(codes("v")).alias("nth", "code"))
    blocks = lambda n, most: F.ceil(n / most).cast("int")
    sizes = dealt.groupBy("nth", "code").agg(blocks(F.count(F.lit(1)), BLOCK).alias("held"), blocks(F.count_if("asks"), ASKING).alias("asking")).where("asking > 0")
    own = dealt.join(sizes, ["nth", "code"])
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = own.select("id", "v", F.lit(False).alias("asks"), "nth", "code", place("held").alias("i"), every("asking").alias("j"))
    met = held.unionByName(own.where("asks").select("id", "v", "asks", "nth", "code", every("held").alias("i"), place("asking").alias("j")))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.stack(pdf["v"].to_numpy())
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        ids, first = pdf["id"].to_numpy(), pdf["asks"].to_numpy()
        of, others = ids[first], ids[~first]
        score = np.round(unit[first] @ unit[~first].T, 12)
        score[of[:, None] == others[None, :]] = -2
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x, own_id in enumerate(of.tolist()):
            near = np.flatnonzero(score[x] >= least)
            near = near[np.lexsort((others[near], -score[x][near]))][:k]
            out.append((np.full(len(near), own_id), others[near], score[x][near]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query", "neighbour", "score"), zip(*out, strict=True), strict=True)})

    found = met.groupBy("nth", "code", "i", "j").applyInPandas(multiply, "query long, neighbour long, score double")
    once = found.groupBy("query", "neighbour").agg(F.max("score").alias("score"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
