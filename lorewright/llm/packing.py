"""Packing of token ids into sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences first; what is left of each
is shorter than one.  Lengths of those rests fall into classes, and a linear program
over patterns of classes says how often to use which pattern.  Its columns are
priced by knapsack dynamic programming.  Patterns are rounded to whole numbers,
and each class's documents, ranked, fill the patterns' places.  What rounding
leaves, less than a sequence for each class, is laid end to end and cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime, sstable, textops

SEQUENCE = 2048
#: Classes of lengths at most, and so rows of the linear program.
CLASSES = 256
#: How near the linear program's value comes to its bound, and how far prices are drawn to the bound's.
GAP, DRAWN = 1e-3, 0.8
_EPS = 1e-7


def length_classes(counts: np.ndarray, most: int) -> np.ndarray:
    """The greatest length of each class, ascending; ``counts`` has how many rests each length has.

    A class of its own for each length if they are few; else narrow classes where
    lengths are many (by the cube root of the counts, which makes the sum of what
    is lost to the greatest length of a class about least).
    """
    lengths = np.flatnonzero(counts)
    if len(lengths) <= most:
        return lengths
    share = np.cumsum(np.cbrt(counts[lengths]))
    part = np.minimum((share - share[0]) * most // share[-1], most - 1)
    return lengths[np.append(np.flatnonzero(np.diff(part)), len(lengths) - 1)]


def _knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest worth for each room up to ``room``, any number of each size; and the class taken last, or -1."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(int(sizes[0]), room + 1):
        n = int(np.searchsorted(sizes, r, side="right"))
        sums = best[r - sizes[:n]] + worth[:n]
        k = int(sums.argmax())
        if sums[k] > best[r - 1]:
            best[r], last[r] = sums[k], k
        else:
            best[r], last[r] = best[r - 1], -1
    return best, last


def _pattern(sizes: np.ndarray, last: np.ndarray, room: int) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    while room > 0:
        k = last[room]
        if k < 0:
            room -= 1
        else:
            out[k] += 1
            room -= int(sizes[k])
    return out


def _first_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> Iterator[np.ndarray]:
    """Patterns that meet the demand by taking the largest that fits, again and again."""
    left = demand.astype(np.int64)
    while left.any():
        new, free = np.zeros(len(sizes), np.int64), room
        for k in np.flatnonzero(left)[::-1].tolist():
            new[k] = min(left[k], free // sizes[k])
            free -= int(new[k] * sizes[k])
        held = new > 0
        left -= new * int((left[held] // new[held]).min())
        yield new


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (a row each), how often each is used, and a lower bound of the sequences.

    The linear program is min sum x with each class's demand met.  It begins with
    one pattern per class, then takes those that filling by size gives.  A knapsack's table gives for every class the best
    pattern that has it, so one table prices as many columns.  Prices are drawn
    towards those of the best bound so far, at first each size's share of the room,
    which keeps them from swinging; where such prices find nothing the program's
    own are taken.  It ends when these find no pattern worth more than 1, or when
    the value is within ``gap`` of the bound.
    """
    columns = np.diag(room // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(columns))
    use, worth = inverse @ demand, inverse.sum(axis=0)

    def enter(new: np.ndarray) -> bool:
        """Take a pattern into the basis if it is worth more than 1."""
        nonlocal use, worth
        over = float(worth @ new) - 1
        if over <= _EPS:
            return False
        into = inverse @ new
        rows = np.flatnonzero(into > 1e-9)
        out = int(rows[np.argmin(use[rows] / into[rows])])
        step = use[out] / into[out]
        use = np.maximum(0.0, use - step * into)
        use[out] = step
        pivot = inverse[out] / into[out]
        inverse[:] -= np.outer(into, pivot)
        inverse[out] = pivot
        worth = worth - over * pivot
        columns[out] = new
        return True

    for new in _first_patterns(sizes, demand, room):
        enter(new)
    centre = sizes / room
    bound, drawn, before, still = float(centre @ demand), DRAWN, float("inf"), 0
    while use.sum() > bound * (1 + gap) and still < 20:
        # Steps may move nothing; so many rounds of such end it.
        still = still + 1 if use.sum() > before - _EPS else 0
        before = float(use.sum())
        price = drawn * centre + (1 - drawn) * worth
        best, last = _knapsack(sizes, price, room)
        top = max(1.0, float(best[room]))
        if float(price @ demand) / top > bound:
            bound, centre = float(price @ demand) / top, price / top
        moved = False
        for k in np.argsort(-(price + best[room - sizes]), kind="stable").tolist():
            new = _pattern(sizes, last, room - int(sizes[k]))
            new[k] += 1
            moved |= enter(new)
        if moved:
            drawn = DRAWN
        elif drawn == 0:
            break
        else:
            drawn = drawn / 2 if drawn > 0.05 else 0.0
    return columns, use, bound


@dataclass
class Plan:
    """``edges``, the greatest length of each class; ``uses``, rows (pattern, class, how many in it); ``times`` of each pattern."""

    edges: np.ndarray
    uses: list[tuple[int, int, int]]
    times: list[int]
    bound: float


def plan_patterns(counts: np.ndarray, room: int = SEQUENCE, classes: int = CLASSES) -> Plan:
    """Whole numbers of patterns for rests of so many of each length below ``room``.

    First the linear program's numbers rounded down, then patterns once more while
    what is left has all their pieces, those with the greatest fraction first.
    """
    edges = length_classes(counts, classes)
    if not len(edges):
        return Plan(edges, [], [], 0.0)
    demand = np.add.reduceat(counts, np.append(0, edges[:-1] + 1))
    columns, use, bound = column_generation(edges, demand.astype(float), room)
    times = np.floor(use + 1e-9).astype(np.int64)
    left = demand - times @ columns
    # A basis pattern may hold more of a class than is asked for, so take back what is too much.
    for j in np.argsort(use, kind="stable").tolist():
        while times[j] and ((left < 0) & (columns[j] > 0)).any():
            times[j] -= 1
            left = left + columns[j]
    for j in np.argsort(-(use - np.floor(use)), kind="stable").tolist():
        # Only patterns that fill a sequence well; the rest is cut to fill it wholly.
        while columns[j] @ edges >= room * 0.98 and (left >= columns[j]).all():
            times[j] += 1
            left = left - columns[j]
    used = np.flatnonzero(times)
    uses = [(n, int(k), int(columns[j, k])) for n, j in enumerate(used.tolist()) for k in np.flatnonzero(columns[j]).tolist()]
    return Plan(edges, uses, times[used].tolist(), bound)


def encode(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``row``, ``doc_id``, ``n``, ``ids``) of every document, as a table in the shared folder.

    ``ids`` are little-endian integers of 16 bits if the vocabulary allows, else
    of 32; ``end_id`` ends each document and so is all of a null or empty text.
    ``tokenizer`` is a path on the driver.
    """
    runtime.integer_key(docs, key)
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sstable._encoder(sent.value)
        end = np.array([end_id], coder.kind).tobytes()
        for batch in batches:
            for piece in textops.split_chunks(batch, "text"):
                raw, offsets = textops.utf8(piece.column("text"))
                data, cut = raw.tobytes(), offsets.tolist()
                ids = [x + end for x in coder.encode([data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])]
                n = pa.array([len(x) // len(end) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), n, pa.array(ids, pa.binary())], names=["row", "doc_id", "n", "ids"])

    rows = runtime.spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).withColumn("row", F.monotonically_increasing_id())
    return runtime.cut(rows, textops.lean(run, "sstable"), "row long, doc_id long, n long, ids binary")


def _before(rows: DataFrame, by: list[str], value: Column, groups: int) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over earlier rows of the same ``by``, in the order of part and ``row``.

    Summed in two levels, in a part of the rows' hashes and then over the parts'
    sums, so that no task holds all rows of a ``by``.
    """
    parted = rows.withColumn("value", value).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    sums = parted.groupBy(*by, "part").agg(F.sum("value").alias("all"))
    first = sums.select(*by, "part", F.coalesce(F.sum("all").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inner = F.coalesce(F.sum("value").over(W.partitionBy(*by, "part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("inner", inner).join(first, [*by, "part"]).withColumn("before", F.col("first") + F.col("inner")).drop("value", "part", "first", "inner")


def _powers(start: int, length: int) -> list[tuple[int, int]]:
    """Spans of ``length`` from ``start`` on, each a power of two long, the longest first."""
    out = []
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            out.append((start, start + (1 << bit)))
            start += 1 << bit
    return out


def place(tokens: DataFrame, room: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """(``row``, ``whole``, ``first_whole``, ``rest``): where the ids of every row of ``encode`` go.

    The first ``whole * room`` ids fill the sequences from ``first_whole`` on.
    ``rest`` are the pieces of what is left: ``start``, ``length``, ``sequence_id``
    and ``offset`` in the sequence.  Sequences are numbered from 0 without gaps.
    Only lengths are looked at here, so no ids are moved.  The driver gets how
    many rests each length has, and plans.
    """
    spark = tokens.sparkSession
    groups = min(1024, 4 * runtime.partitions(spark))
    docs = tokens.select("row", F.floor(F.col("n") / room).cast("long").alias("whole"), F.pmod("n", F.lit(room)).cast("int").alias("length"))
    counts = np.zeros(room, np.int64)
    for length, n in docs.where("length > 0").groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    plan = plan_patterns(counts, room, classes)
    kind_of = np.searchsorted(plan.edges, np.arange(room)).tolist()

    rests = docs.where("length > 0").select("row", "whole", "length", F.get(runtime.literal_array(kind_of), F.col("length")).cast("int").alias("class"))
    ranked = runtime.cut(_before(rests, ["class"], F.lit(1), groups))
    first = [0, *np.cumsum(plan.times, dtype=np.int64).tolist()]
    taken, spans = [0] * max(1, len(plan.edges)), []
    for pattern, k, each in plan.uses:
        until = taken[k] + each * plan.times[pattern]
        spans.append((k, taken[k], until, first[pattern], each))
        taken[k] = until
    # A row for each class of each pattern: bounded by the classes and what fits a sequence.
    places = spark.createDataFrame(spans, "class int, low long, high long, first long, each long")
    met = ranked.join(F.broadcast(places), (ranked["class"] == places["class"]) & (F.col("before") >= F.col("low")) & (F.col("before") < F.col("high")))
    nth = F.col("before") - F.col("low")
    seated = met.select("row", F.col("whole") * room, "length", (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), ranked["class"], "before").toDF("row", "start", "length", "sequence_id", "class", "before")
    offset = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy(F.desc("class"), "before").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    piece = lambda start, length, sequence, at: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), sequence.cast("long").alias("sequence_id"), at.cast("long").alias("offset"))
    fitted = seated.select("row", F.array(piece(F.col("start"), F.col("length"), F.col("sequence_id"), offset)).alias("rest"))

    # What no pattern takes: less than a sequence for each class, so one task may order it.
    over = ranked.where(F.col("before") >= F.get(runtime.literal_array(taken), F.col("class")))
    laid = over.withColumn("at", F.coalesce(F.sum("length").over(W.orderBy("class", "before").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = int(over.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    cuts = [(a, a + room) for a in range(0, total - room + 1, room)]
    cuts += _powers(total - total % room, total % room)
    bounds = F.from_json(F.lit(str([{"a": a, "b": b, "s": first[-1] + i} for i, (a, b) in enumerate(cuts)]).replace("'", '"')), "array<struct<a: bigint, b: bigint, s: bigint>>")
    end = F.col("at") + F.col("length")
    mine = F.filter(bounds, lambda x: (x["a"] < end) & (x["b"] > F.col("at")))
    base = F.col("whole") * room
    part = lambda x: piece(base + F.greatest(x["a"], F.col("at")) - F.col("at"), F.least(x["b"], end) - F.greatest(x["a"], F.col("at")), x["s"], F.greatest(x["a"], F.col("at")) - x["a"])
    left = laid.select("row", F.transform(mine, part).alias("rest"))

    whole = _before(docs.where("whole > 0").select("row", "whole", F.lit(0).alias("one")), ["one"], F.col("whole"), groups).select("row", "whole", (F.col("before") + first[-1] + len(cuts)).alias("first_whole"))
    both = fitted.unionByName(left).join(whole, "row", "full")
    return both.select("row", F.coalesce("whole", F.lit(0)).cast("long").alias("whole"), F.col("first_whole").cast("long"), "rest")


_PIECES = "doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, end_id: int, room: int = SEQUENCE, key: str = "doc_id", text: str = "text", classes: int = CLASSES) -> DataFrame:
    """A row per piece: ``doc_id``, ``doc_tokens``, ``start``, ``length``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` are the piece's, little-endian with 32 bits; ``doc_tokens`` counts all
    of its document, the end id too.  Each id lies in one piece; sequences hold at
    most ``room`` ids, and their pieces lie end to end from offset 0.  Null and
    empty texts are the end id alone; null and repeated keys are documents of their
    own; an empty table gives no rows.  ``key`` must be an integer column, else a
    TypeError says so, and other columns are not looked at.

    Only documents longer than a sequence, and what rounding leaves, are cut.
    Sequences are filled but for what lengths are below the greatest of their
    class; those of the remainder are powers of two long.
    """
    tokens = encode(docs, tokenizer, end_id, key, text)
    with open(tokenizer, encoding="utf-8") as f:
        kind = sstable.Encoder(f.read()).kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, n, ids, whole, at, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "whole", "first_whole", "rest")), strict=True):
                wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
                pieces = [(k * room, room, at + k, 0) for k in range(whole)]
                pieces += [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in rest or ()]
                for start, length, sequence, offset in pieces:
                    out.append((doc, n, start, length, sequence, offset, wide[4 * start : 4 * (start + length)]))
                size += len(wide)
                if size > textops.CHUNK_BYTES:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    met = tokens.join(place(tokens, room, classes), "row").select("doc_id", "n", "ids", "whole", "first_whole", "rest")
    return met.mapInArrow(textops.lean(cut, "sstable"), _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"])
