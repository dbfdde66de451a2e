"""Ranked lexical search by a hierarchical max tree over document ranges.

The index has a row per term and chunk of documents: the chunk's documents that
hold the term, what the term gives each of them, and the greatest of that for
every range of 16, 256 and 4096 documents.  A search is best-first: the range
with the highest sum of its terms' maxima is opened next, until the best sum left
is below the last score that is kept.  Ranges of an equal sum are opened too, as
one of their documents may have a lesser key.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime, textops

#: What a term is made of, as Java and DuckDB write it.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ranges have 16 parts each; a chunk is one range of the third level.
BITS, LEVELS = 4, 3
CHUNK_DOCS = 1 << BITS * LEVELS
#: Bytes of text after which a chunk ends, if it has not so many documents.
CHUNK_TEXT = 8 << 20
#: (item, term) pairs that one pass over the index takes; they are broadcast.
BLOCK_PAIRS = 1 << 16

_POSTINGS = "chunk long, term string, df int, ords binary, impacts binary, max1 binary, max2 binary, max3 binary, keys array<bigint>"
_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("term", pa.string()), ("df", pa.int32())] + [(c, pa.binary()) for c in ("ords", "impacts", "max1", "max2", "max3")] + [("keys", pa.list_(pa.int64()))]
)


@dataclass
class Index:
    """``postings``, a row per chunk and term and one without a term for the chunk's keys; counts of all documents."""

    postings: DataFrame
    docs: int
    terms: int


def terms(text: Column) -> Column:
    """The terms of a text in their order; none if it is null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0))


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary row for each run of values from one start to the next."""
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


class _Chunk:
    """Documents of a range while their terms are counted."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)
        self.term, self.tf, self.keys, self.size, self.distinct, self.text = [], [], [], [], [], 0

    def add(self, key: int | None, text: bytes) -> None:
        found = _TERM.findall(text.lower())
        if not found:
            return
        counts = Counter(found)
        self.term.append(np.fromiter(map(self.ids.__getitem__, counts), np.int64, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.keys.append(key)
        self.size.append(len(found))
        self.distinct.append(len(counts))
        self.text += len(text)

    def full(self) -> bool:
        return len(self.keys) >= CHUNK_DOCS or self.text >= CHUNK_TEXT

    def rows(self, number: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        length = 75 + 25 * np.array(self.size, np.int64) * n_docs // n_terms
        ords = np.repeat(np.arange(len(self.keys)), self.distinct)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * length[ords])
        order = np.argsort(term, kind="stable")
        term, ords, impact = term[order], ords[order], impact[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        columns = [_packed(ords.astype("<u2"), starts), _packed(impact.astype("<i4"), starts)]
        for level in range(1, LEVELS + 1):
            node = term << 16 | ords >> BITS * level
            first = np.flatnonzero(np.diff(node, prepend=-1))
            columns.append(_packed(np.maximum.reduceat(impact, first).astype("<i4"), np.searchsorted(first, starts)))
        names = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        n = len(starts)
        one = pa.array([None], pa.binary())
        filled = [pa.array([number] * (n + 1), pa.int64()), pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array([*np.diff(np.append(starts, len(term))).tolist(), None], pa.int32())]
        filled += [pa.concat_arrays([c, one]) for c in columns]
        return pa.RecordBatch.from_arrays([*filled, pa.array([None] * n + [self.keys], pa.list_(pa.int64()))], schema=_SCHEMA)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every row of ``docs`` by the terms of its whole text, as a table in the shared folder.

    A chunk is a run of rows of one task, 4096 of them or 8 MB of text, so
    neither texts nor postings are shuffled.  Rows without terms, null texts too,
    can have no score and are not in it.  ``key`` must be an integer column, else
    a TypeError says so; null and repeated keys are kept as they are, and other
    columns are not looked at.
    """
    runtime.integer_key(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    in_term = textops.byte_class(bytes(b for b in range(256) if _TERM.match(bytes([b]))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = found = 0
        for batch in batches:
            for piece in textops.split_chunks(batch, "text"):
                each = np.diff(textops.word_spans(*textops.utf8(piece.column("text")), in_term)[2])
                held, found = held + int(np.count_nonzero(each)), found + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([found], pa.int64())], names=["docs", "terms"])

    totals = runtime.spread(rows).select("text").mapInArrow(textops.lean(counted), "docs long, terms long")
    said = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms"))).first()
    n_docs, n_terms = said["docs"], said["terms"]

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        made = _Chunk()
        for batch in batches:
            for piece in textops.split_chunks(batch, "text"):
                raw, offsets = textops.utf8(piece.column("text"))
                data, cut = raw.tobytes(), offsets.tolist()
                for k, a, b in zip(piece.column("key").to_pylist(), cut[:-1], cut[1:], strict=True):
                    made.add(k, data[a:b])
                    if made.full():
                        yield made.rows(number, n_docs, n_terms)
                        made, number = _Chunk(), number + 1
        if made.keys:
            yield made.rows(number, n_docs, n_terms)

    return Index(runtime.cut(runtime.spread(rows), textops.lean(postings, "ranked"), _POSTINGS), n_docs, n_terms)


class _Tree:
    """The maxima of a chunk's terms, and its postings by ranges of 16 documents."""

    def __init__(self, rows: pa.Table, vocabulary: int):
        held = rows.filter(pa.compute.is_valid(rows["tid"]))
        self.keys = rows.filter(pa.compute.is_valid(rows["keys"]))["keys"].to_pylist()[0]
        tid = held["tid"].to_numpy()
        self.at = np.full(vocabulary, -1)
        self.at[tid] = np.arange(len(tid))
        flat = lambda c, kind: np.frombuffer(b"".join(held[c].to_pylist()), kind).astype(np.int64)
        ords, impact = flat("ords", "<u2"), flat("impacts", "<i4")
        row = np.repeat(np.arange(len(tid)), held["df"].to_numpy())
        self.levels = []
        for level in range(1, LEVELS + 1):
            node = ords >> BITS * level
            first = np.flatnonzero(np.diff(row << 16 | node, prepend=-1))
            dense = np.zeros((len(tid), CHUNK_DOCS >> BITS * level), np.int64)
            dense[row[first], node[first]] = flat(f"max{level}", "<i4")
            self.levels.append(dense)
        order = np.argsort(ords >> BITS, kind="stable")
        self.row, self.ords, self.impact = row[order], ords[order], impact[order]
        self.leaf = np.searchsorted(self.ords >> BITS, np.arange((CHUNK_DOCS >> BITS) + 1)).tolist()
        self.weight = np.zeros(len(tid), np.int64)

    def best(self, tids: np.ndarray, weights: np.ndarray, kept: list, k: int) -> None:
        """Put into the heap ``kept`` what belongs to the k best of an item."""
        rows = self.at[tids]
        weights, rows = weights[rows >= 0], rows[rows >= 0]
        if not len(rows):
            return
        self.weight[rows] = weights
        bounds = [level[rows] for level in self.levels[:-1]]
        open_nodes = [(-int(weights @ self.levels[-1][rows, 0]), LEVELS, 0)]
        while open_nodes:
            bound, level, node = heapq.heappop(open_nodes)
            if len(kept) == k and -bound < kept[0][0]:
                break
            if level > 1:
                low = node << BITS
                sums = weights @ bounds[level - 2][:, low : low + (1 << BITS)]
                least = max(1, kept[0][0] if len(kept) == k else 1)
                for child in np.flatnonzero(sums >= least).tolist():
                    heapq.heappush(open_nodes, (-int(sums[child]), level - 1, low + child))
                continue
            a, b = self.leaf[node], self.leaf[node + 1]
            sums = np.zeros(1 << BITS, np.int64)
            np.add.at(sums, self.ords[a:b] & 15, self.weight[self.row[a:b]] * self.impact[a:b])
            for place in np.flatnonzero(sums).tolist():
                key = self.keys[(node << BITS) + place]
                # Nulls are the least keys.  The heap's first entry is the one to go.
                entry = (int(sums[place]), float("inf") if key is None else -key)
                if len(kept) < k:
                    heapq.heappush(kept, entry)
                elif entry > kept[0]:
                    heapq.heapreplace(kept, entry)
        self.weight[rows] = 0


def _weighed(index: Index, items: DataFrame, item: str, text: str) -> DataFrame:
    """(``item_row``, ``item_id``, ``term``, ``weight``): weights of terms times how often the item has them, none of 0."""
    numbered = items.select(F.monotonically_increasing_id().alias("item_row"), F.col(item).alias("item_id"), terms(F.col(text)).alias("terms"))
    each = numbered.select("item_row", "item_id", F.explode("terms").alias("term"))
    pairs = runtime.cut(each.groupBy("item_row", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats")))
    held = index.postings.select("term", "df").join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1)))
    return runtime.cut(pairs.join(held, "term").select("item_row", "item_id", "term", (weight * F.col("repeats")).cast("long").alias("weight")).where("weight > 0"))


def _blocks(weighed: DataFrame, most: int) -> tuple[Column, int]:
    """A block for each item, and their number: of at most ``most`` pairs, or of one item."""
    total, n = weighed.count(), 1
    while True:
        block = F.pmod(F.xxhash64("item_row"), F.lit(n))
        if total <= most * n:
            sizes = weighed.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_row").alias("items"))
            if sizes.where((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
                return block, n
        n *= 2


def search(index: Index, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): the k best documents of each item.

    Scores are above 0; equal ones rank by ascending key, nulls first.  An item
    that comes again is ranked again; one without terms, null or empty, or with
    none that a document has, gives no rows.  Documents of a repeated key are
    ranked each.  Other columns are not looked at.

    Items go in blocks of at most ``block_pairs`` distinct (item, term) pairs, or of one item,
    and a block is broadcast; each is a pass over the index.  Tasks read their
    chunks one by one and keep the k best of every item, so what one chunk gave
    prunes the next; k rows of an item and task are shuffled.
    """
    spark = items.sparkSession
    weighed = _weighed(index, items, item, text)
    block, blocks = _blocks(weighed, block_pairs)
    found = None
    for b in range(blocks):
        pairs = weighed.where(block == b).select("item_row", "term", "weight").orderBy("item_row", "term").collect()
        if not pairs:
            continue
        names = sorted({p["term"] for p in pairs})
        number = {t: i for i, t in enumerate(names)}
        wanted = defaultdict(lambda: ([], []))
        for p in pairs:
            wanted[p["item_row"]][0].append(number[p["term"]])
            wanted[p["item_row"]][1].append(p["weight"])
        sent = spark.sparkContext.broadcast([(i, np.array(t), np.array(w, np.int64)) for i, (t, w) in wanted.items()])
        best = _searched(index, spark.createDataFrame(list(number.items()), "term string, tid int"), sent, len(names), k)
        best = runtime.cut(best) if blocks > 1 else best
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item_row long, key long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_first("key")))).where(F.col("rank") <= k)
    names = weighed.select("item_row", "item_id").distinct()
    return ranked.join(names, "item_row").select("item_id", "rank", F.col("key").alias("doc_id"), "score")


def _searched(index: Index, vocabulary: DataFrame, sent, size: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in sent.value]

        def take(parts: list[pa.RecordBatch]) -> None:
            tree = _Tree(pa.Table.from_batches(parts), size)
            for (_, tids, weights), kept in zip(sent.value, heaps, strict=True):
                tree.best(tids, weights, kept, k)

        held, at = [], None
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and chunk[a] != at:
                    take(held)
                    held = []
                held.append(batch.slice(a, b - a))
                at = chunk[a]
        if held:
            take(held)
        rows = [(item, None if key == float("inf") else -key, score) for (item, _, _), kept in zip(sent.value, heaps, strict=True) for score, key in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_row", "key", "score"])

    spark = vocabulary.sparkSession
    met = index.postings.join(F.broadcast(vocabulary), "term", "left").where("tid is not null or keys is not null").drop("term")
    dealt = met.repartition(runtime.partitions(spark), "chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(textops.lean(run, "ranked"), "item_row long, key long, score long")
