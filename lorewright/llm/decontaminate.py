"""Benchmark decontamination by one Aho-Corasick automaton over word numbers.

Words of the items are numbered and texts become sequences of those numbers (0:
a word of no item).  Any window of ``width`` words of an item holds a whole one
of the blocks of half that length that tile the item, so the blocks are the
automaton's patterns: an item of n words has n nodes instead of ``width`` times
as many.  One pass over a text finds the blocks, and the windows around each are
then compared word for word with the items'.  A match's position is a word
number, so its place in the original text is that of the word.

Items of more text than one automaton should take are dealt to several.  Hashes
of all items' blocks then pick out the texts that can hold a window; these, few
and written to a table, pass one automaton after the other.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime, textops

#: Bytes of item text that one automaton takes; more items go to more automata.
ITEM_BYTES = 8 << 20

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z become a-z, and bytes that are in no word become spaces.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def block_words(width: int) -> int:
    """The longest tiles of which every window holds a whole one."""
    return (width + 1) // 2


_ODD = textops.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _hashes(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Of the ``size`` numbers from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out = textops.mix(out + (ids[starts + k].astype(np.uint64) + np.uint64(1)) * _ODD[k % 64])
    return out


class Matcher:
    """The automaton of a set of items, and what it finds in a text."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.width, self.block = width, block_words(width)
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        numbers, flat, self.names, sizes = self.numbers, [], [], []
        for item, text in items:
            ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in normal_words((text or "").encode()))
            if not ids:
                continue
            size = min(self.block, len(ids))
            for i in range(0, len(ids) - size + 1 if len(ids) >= width else 1, self.block):
                self.automaton.add_word(ids[i : i + size], size)
            flat.append(np.array(ids, np.int32))
            self.names.append(item)
            sizes.append(len(ids))
        self.empty = not flat
        if self.empty:
            return
        self.automaton.make_automaton()
        self.flat, self.first = np.concatenate(flat), np.cumsum([0, *sizes])
        #: For each length of window: hashes in order, and where they start; an item's equal windows once.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        length = np.minimum(np.array(sizes), width)
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            starts = np.concatenate([np.arange(self.first[k], self.first[k + 1] - size + 1) for k in mine])
            hashes, of = _hashes(self.flat, starts, size), np.searchsorted(self.first, starts, side="right")
            order = np.lexsort((of, hashes))
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
            self.windows[size] = (hashes[order[new]], starts[order[new]])

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word intervals that occurrences cover, joined, and their items."""
        if self.empty or not words:
            return [], set()
        get = self.numbers.get
        numbered = tuple([get(w, 0) for w in words])
        met = list(self.automaton.iter(numbered))
        if not met:
            return [], set()
        ids, blocks = np.array(numbered, np.int32), np.array(met, np.int64)
        step = np.zeros(len(ids) + 1, np.int32)
        items: set = set()
        for size, (known, at) in self.windows.items():
            mine = blocks[blocks[:, 1] == min(self.block, size)]
            begin = mine[:, 0] - mine[:, 1] + 1
            if size == self.width:
                begin = (begin[:, None] - np.arange(size - self.block + 1)).ravel()
            begin = np.unique(begin[(begin >= 0) & (begin <= len(ids) - size)])
            hashes = _hashes(ids, begin, size)
            low, high = np.searchsorted(known, hashes), np.searchsorted(known, hashes, side="right")
            for k in np.flatnonzero(high > low).tolist():
                own = ids[begin[k] : begin[k] + size]
                same = [int(x) for x in at[low[k] : high[k]] if np.array_equal(self.flat[x : x + size], own)]
                if same:
                    items.update(self.names[i] for i in (np.searchsorted(self.first, same, side="right") - 1).tolist())
                    step[begin[k]] += 1
                    step[begin[k] + size] -= 1
        edge = np.flatnonzero(np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), items


_MATCHERS: dict[tuple, Matcher] = textops.cache("decontaminate")


def _matcher(sent) -> Matcher:
    if sent.id not in _MATCHERS:
        _MATCHERS.clear()
        items, width = sent.value
        _MATCHERS[sent.id] = Matcher(items, width)
    return _MATCHERS[sent.id]


class _Sent:
    """A broadcast with a number to know it by in a worker."""

    def __init__(self, spark, value):
        self.variable = spark.sparkContext.broadcast(value)
        self.id = (spark.sparkContext.applicationId, hashlib.sha256(pickle.dumps(value)).hexdigest())

    @property
    def value(self):
        return self.variable.value


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two lists of intervals as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and out[-1][1] >= x:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _scan(sent: _Sent, text: str, columns: list[str], found: list[str], again: bool):
    """Adds the columns ``found``; ``again`` joins them to what they hold already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(sent)
        for batch in batches:
            for chunk in textops.split_chunks(batch, text):
                raw, offsets = textops.utf8(chunk.column(text))
                data = raw.tobytes().translate(_NORMAL)
                before = list(zip(*(chunk.column(c).to_pylist() for c in found[2:]), strict=True)) if again else None
                out: list[list] = [[], [], [], [], []]
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    words = data[a:b].split()
                    spans, items = matcher.find(words)
                    named = {str(x) for x in items if x is not None}
                    if before:
                        spans = _joined(spans, list(zip(*before[row][:2], strict=True)))
                        named |= set(before[row][2])
                    out[0].append(len(words))
                    out[1].append(sum(y - x for x, y in spans))
                    out[2].append([x for x, _ in spans])
                    out[3].append([y for _, y in spans])
                    out[4].append(sorted(named))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                made = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in columns), *made], names=[*columns, *found])

    return run


def _block_hashes(width: int):
    """(size, hash) of the blocks of items' bodies, by the bytes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, "body"):
                words, row, first = _hashed_words(chunk.column("body"))
                for size in range(1, block_words(width) + 1):
                    n = np.diff(first)
                    tiled = np.minimum(n, width) >= block_words(width)
                    mine = tiled if size == block_words(width) else n == size
                    hashes = textops.window_hashes(words, size)
                    place = np.arange(len(hashes)) - first[row[: len(hashes)]]
                    inside = (place + size <= n[row[: len(hashes)]]) & (place % size == 0) & mine[row[: len(hashes)]]
                    kept = np.unique(hashes[inside])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), size, np.int32)), pa.array(kept.view(np.int64))], names=["size", "hash"])

    return run


def _hashed_words(column: pa.Array):
    raw, offsets = textops.utf8(column)
    folded = np.frombuffer(raw.tobytes().translate(_NORMAL), np.uint8)
    starts, ends, first = textops.word_spans(folded, offsets, _IN_WORD)
    return textops.span_hashes(folded, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def _pick(sent: _Sent, text: str, columns: list[str], found: list[str]):
    """Adds the empty columns ``found`` and whether a text can hold a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        for batch in batches:
            for chunk in textops.split_chunks(batch, text):
                words, row, first = _hashed_words(chunk.column(text))
                may = np.zeros(len(chunk), bool)
                for size, known in blocks:
                    hashes = textops.window_hashes(words, size)
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
                    may[row[hit[row[hit] == row[hit + size - 1]]]] = True
                n = len(chunk)
                none = [pa.array(np.zeros(n, np.int64)), *(pa.array([[]] * n, pa.list_(k)) for k in (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in columns), pa.array(np.diff(first)), *none, pa.array(may)], names=[*columns, *found])

    return run


def original_span(text: str, first_word: int, last_word: int) -> tuple[int, int]:
    """Character range in the original text of normalised words, both included."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = textops.word_spans(raw, np.array([0, len(raw)]), _IN_WORD)
    before = raw[: starts[first_word]].tobytes().decode()
    return len(before), len(raw[: ends[last_word]].tobytes().decode())


_IN_WORD = textops.byte_class(_WORD_BYTES + bytes(range(0x41, 0x5B)))


_LONGS = T.ArrayType(T.LongType())
_FOUND = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_from", _LONGS), ("hit_to", _LONGS), ("items", T.ArrayType(T.StringType())))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, key: str = "item_id", text: str = "text", text_of_item: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Each row of ``docs`` with what it shares with the benchmark.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window of
    ``width`` item words), ``hit_from`` and ``hit_to`` (the word intervals),
    ``items`` (item ids as sorted strings) and ``contaminated``: some hit words
    that are a twentieth of all or more.  An item of fewer words is one window.

    The items are collected in blocks of at most about ``item_bytes`` of text,
    one automaton each and one at a time; with several, eight bytes for each
    block of words of the items reach the driver and the workers as well.
    Null and empty texts have no words; an empty benchmark hits nothing;
    repeated items count by id.  An item without an id hits as others do, but
    ``items`` does not name it.  Input columns named as the results are dropped
    in their favour; others keep their names and values, whatever they are.
    """
    spark = docs.sparkSession
    made = ("n_words", "n_hit", "hit_from", "hit_to", "items", "contaminated")
    columns = [c for c in docs.columns if c not in made]
    rows = docs.select(*[docs[c] for c in columns])
    items = benchmark.select(F.col(key).alias("item"), F.col(text_of_item).alias("body")).where("body is not null")
    total = items.agg(F.sum(F.octet_length("body")).alias("b")).first()["b"] or 0
    found = list(made[:5])
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in _FOUND)])
    parts = -(-total // item_bytes) or 1
    if parts == 1:
        sent = _Sent(spark, (sorted(map(tuple, items.collect()), key=str), width))
        out = runtime.spread(rows).mapInArrow(textops.lean(_scan(sent, text, columns, found, False), "decontaminate"), schema)
    else:
        hashes = items.select("body").mapInArrow(textops.lean(_block_hashes(width)), "size int, hash long").distinct().toPandas()
        blocks = [(int(k), np.sort(h["hash"].to_numpy().view(np.uint64))) for k, h in hashes.groupby("size")]
        flag = max([*columns, *made], key=len) + "_"
        marked = rows.mapInArrow(textops.lean(_pick(_Sent(spark, blocks), text, columns, [*found, flag])), T.StructType([*schema.fields, T.StructField(flag, T.BooleanType())]))
        met = runtime.cut(marked.where(F.col(flag)).select(*schema.names))
        for part in range(parts):
            mine = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part)
            sent = _Sent(spark, (sorted(map(tuple, mine.collect()), key=str), width))
            met = runtime.cut(met, textops.lean(_scan(sent, text, columns, found, True), "decontaminate"), schema)
            sent.variable.unpersist()
        out = marked.where(~F.col(flag)).select(*schema.names).unionByName(met)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
