"""Chunk index and search over vectors, entities and relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import merge
from .entities import community_hits, personal_rank

DIMENSIONS, SNIPPET = 64, 800
#: Groups of rows that all pairs are made of, where rows are few.
PAIR_GROUPS = 16
# Characters that are shown of a context, in a list and of an error.
SNIPPETS = {"context": SNIPPET, "list": 140, "error": 500}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of hashed token counts: the stand-in where no model is plugged in."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit(places: pa.Array) -> pa.Array:
        out = np.zeros((len(places), dimensions))
        for n, row in enumerate(places):
            if row.is_valid and len(row):
                out[n] = np.bincount(row.values.to_numpy(zero_copy_only=False), minlength=dimensions)
                out[n] /= max(1e-12, float(np.linalg.norm(out[n])))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * np.int32(dimensions)), pa.array(out.ravel()))

    return unit(F.transform(X.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int")))


def top_k(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows with ``rank``; ties go to the least key."""
    best = rows.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def search(chunks: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest vectors to one query, which is a literal in the plan."""
    return top_k(chunks.withColumn("score", cosine(F.col(vector), F.array(*map(F.lit, query)))), "score", key, k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """(``query``, ``neighbour``, ``score``, ``rank``): the k nearest of each query.

    Vectors and queries are dealt to groups; each group of the one meets each of
    the other once, as one matrix product of bounded size that keeps k rows a
    query.  Nothing is broadcast, and only the kept rows move on.  Null vectors
    have no neighbours and are none.
    """
    vectors, queries = (x.where(F.col(vector).isNotNull()) for x in (vectors, queries))
    n_v, n_q = (max(1, -(-x.count() // block_rows)) for x in (vectors, queries))
    group = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), group(n_v).alias("i"), every(n_q).alias("j"), F.lit(False).alias("asks"))
    q = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), every(n_v).alias("i"), group(n_q).alias("j"), F.lit(True).alias("asks"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        ids, asks = pdf["id"].to_numpy(), pdf["asks"].to_numpy()
        a, b = ids[asks], ids[~asks]
        s = unit[asks] @ unit[~asks].T
        out = []
        for x in range(len(a)):
            order = np.lexsort((b, -s[x]))[: k + 1]
            order = order[b[order] != a[x]][:k]
            out.append(pd.DataFrame({"query": a[x], "neighbour": b[order], "score": s[x][order]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "neighbour": [], "score": []})

    best = v.unionByName(q).groupBy("i", "j").applyInPandas(multiply, "query long, neighbour long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block_rows: int = 16384, strip: int = 1024) -> DataFrame:
    """(``a``, ``b``, ``score``), a < b: all pairs with a cosine of ``least`` or more.

    An exact join in blocks: rows are dealt to g groups, every pair of groups
    meets once, in strips of ``strip`` rows, each as one matrix product of bounded
    size.  A row moves g times, so groups are large; they are many where there are
    few rows, to have work for all tasks.  Null vectors are like none.
    """
    vectors = vectors.where(F.col(vector).isNotNull())
    n = vectors.count()
    groups = max(1, -(-n // block_rows), min(-(-n // strip), PAIR_GROUPS))
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h")
    spread = own.select("id", "v", "g", other).select("id", "v", "g", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        size = len(cell.column("v")[0])
        unit = cell.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        ids, mine = cell.column("id").to_numpy(), cell.column("g").to_numpy() == i
        (x, of), (y, to) = ((unit[k], ids[k]) for k in (mine, mine if i == j else ~mine))
        for p in range(0, len(x), strip):
            for q in range(p if i == j else 0, len(y), strip):
                s = x[p : p + strip] @ y[q : q + strip].T
                m, n = np.nonzero(s >= least)
                a, b, v = of[p + m], to[q + n], s[m, n]
                keep = a < b if i == j and p == q else np.ones(len(a), bool)
                yield pa.RecordBatch.from_arrays([pa.array(z[keep]) for z in (np.minimum(a, b), np.maximum(a, b), v)], names=["a", "b", "score"])

    return spread.groupBy("i", "j").applyInArrow(multiply, "a long, b long, score double")


def local_hits(entities: DataFrame, edges: DataFrame, words: list[str]) -> DataFrame:
    """Chunks of entities that the query names and of their neighbours: (``chunk``, ``score``)."""
    named = entities.where(F.lower("label").isin(*[w.lower() for w in words])).select("id")
    near = edges.join(named.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id")).unionAll(edges.join(named.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id")))
    weighed = named.select("id", F.lit(2.0).alias("w")).unionAll(near.select("id", F.lit(1.0).alias("w")))
    return weighed.join(entities, "id").select("w", F.explode("sources").alias("chunk")).groupBy("chunk").agg(F.sum("w").alias("score"))


def global_hits(entities: DataFrame, edges: DataFrame, words: list[str]) -> DataFrame:
    """Chunks of both ends of relations that the query names: (``chunk``, ``score``)."""
    wanted = [w.lower() for w in words]
    hit = edges.where(F.exists(F.split(F.lower("relation"), r"[\s_/]+"), lambda x: x.isin(*wanted)))
    ends = hit.select(F.col("source").alias("id")).unionAll(hit.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("w"))
    return ends.join(entities, "id").select("w", F.explode("sources").alias("chunk")).groupBy("chunk").agg(F.sum("w").cast("double").alias("score"))


def graph_hits(entities: DataFrame, edges: DataFrame, words: list[str], communities: DataFrame) -> DataFrame:
    """Chunks of the communities that a walk from the entities that the query names comes to: (``chunk``, ``score``)."""
    named = entities.where(F.lower("label").isin(*[w.lower() for w in words]) | F.col("id").isin(*[w.lower() for w in words])).select("id")
    return community_hits(personal_rank(edges, named), communities, entities)


def fused(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (``chunk``, ``rank``) lists."""
    out = None
    for one in ranked:
        part = one.select("chunk", (1.0 / (k + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("chunk").agg(F.sum("s").alias("score"))


def snippet(c: Column, kind: str = "context") -> Column:
    return F.left(c, F.lit(SNIPPETS[kind]))


MODES = ("naive", "local", "global", "hybrid", "mix")


def ranked(hits: DataFrame) -> DataFrame:
    """Hits (``chunk``, ``score``) with ``rank``; equal scores by chunk.

    Ranks are counted over ordered ranges of hits, so there may be any number.
    """
    placed = merge.positions(hits.select((-F.col("score")).alias("worst"), "chunk"), ["worst", "chunk"])
    return placed.select("chunk", (F.col("p") + 1).alias("rank"))


def by_mode(mode: str, nearest_chunks: DataFrame, entities: DataFrame, edges: DataFrame, words: list[str], k: int, communities: DataFrame | None = None) -> DataFrame:
    """The k best (``chunk``, ``score``) in a mode.

    ``naive`` are the chunks nearest to the query (``chunk``, ``rank``); ``local``
    those of entities that it names and their neighbours; ``global`` those at the
    ends of relations that it names; ``hybrid`` the fusion of both, ``mix`` that of
    all three.  Each list is cut to its best before they are fused.  With
    ``communities`` (``id``, ``community``), ``global`` are the chunks of those
    that a walk from the named entities comes to most.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    first = W.orderBy(F.desc("score"), "chunk")
    best = lambda hits: hits.orderBy(F.desc("score"), "chunk").limit(max(k, 60)).select("chunk", F.row_number().over(first).alias("rank"))
    lists = {
        "naive": lambda: nearest_chunks.select("chunk", "rank"),
        "local": lambda: best(local_hits(entities, edges, words)),
        "global": lambda: best(global_hits(entities, edges, words) if communities is None else graph_hits(entities, edges, words, communities)),
    }
    use = {"hybrid": ("local", "global"), "mix": ("naive", "local", "global")}.get(mode, (mode,))
    return fused(*(lists[name]() for name in use)).orderBy(F.desc("score"), "chunk").limit(k)


def answer(hits: DataFrame, mode: str) -> DataFrame:
    """(``answer``, ``contexts``, ``mode``) from ranked hits (``rank``, ``content``,
    ``file_path``): the first sentences of the contexts, with their numbers."""
    cut = hits.select("rank", F.left("content", F.lit(SNIPPET)).alias("content"), "file_path").where("content <> ''")
    first = F.concat(F.regexp_extract("content", r"^[\s\S]*?[.!?](?=\s|$)|^[\s\S]+", 0), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    rows = cut.select(F.struct("rank", "content", "file_path").alias("c"), first.alias("s"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("c.rank").alias("r"), "c", "s"))).alias("x"))
    return ordered.select(F.array_join(F.transform("x", lambda x: x["s"]), " ").alias("answer"), F.transform("x", lambda x: x["c"]).alias("contexts"), F.lit(mode).alias("mode"))


def source_path(doc: Column, chunk: Column, path: Column) -> Column:
    """Where a hit comes from: its document, else its chunk's, else its file."""
    return F.coalesce(X.nonempty(doc), X.nonempty(F.regexp_replace(chunk, r"-chunk-\d+$", "")), X.nonempty(path))
