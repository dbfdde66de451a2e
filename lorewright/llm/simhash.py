"""SimHash fingerprints, linked by pigeonring filtering.

A fingerprint's eight bytes form a ring of segments.  If two fingerprints
differ in at most t bits, then from some segment on every chain of n
consecutive segments differs in at most floor(n * t / 8) bits in total
(pigeonring principle).  The budgets of the chain of five say how many of its
segments must be equal; those equal bytes are the key by which fingerprints
meet (32 bits for t = 3).  Within a key the chain budgets are tested one after
the other, and what passes the chain of eight passes the Hamming check.

Fingerprints are made distinct first, so copies cost nothing.  A key's
fingerprints are not paired off: a search outward from one finds its component
in the key, and only a link per member comes out.  A key with more than
``BLOCK`` fingerprints is split into blocks, and every two blocks meet in a task
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, runtime, textops

SEGMENTS = 8
CHAIN = 5
BLOCK = 2048
#: Keys with more fingerprints that are broadcast, at most.
MAX_BROADCAST_KEYS = 100_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def budget(length: int, bits: int) -> int:
    return length * bits // SEGMENTS


def equal_segments(bits: int) -> list[tuple[int, ...]]:
    """For each table its chain's start, then the segments that must be equal."""
    forced = sum(budget(n, bits) == 0 for n in range(1, CHAIN + 1))
    free = CHAIN - budget(CHAIN, bits) - forced
    if free < 0 or not 0 <= bits < SEGMENTS:
        raise ValueError("bits must be 0 to 7")
    return [(s, *((s + k) % SEGMENTS for k in (*range(forced), *more))) for s in range(SEGMENTS) for more in combinations(range(forced, CHAIN), free)]


def fingerprint(text: bytes, words_each: int) -> int:
    return int(_fingerprints([text], words_each)[0])


def _fingerprints(texts: list[bytes], words_each: int) -> np.ndarray:
    digest = xxhash.xxh64_digest
    out, counts = [], []
    for text in texts:
        words = text.translate(_LOWER).split()
        n = len(words) - words_each + 1
        joined = b" ".join(words)
        if not words:
            counts.append(0)
        elif n <= 1:
            out.append(digest(joined, 42))
            counts.append(1)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: n - 1].tolist()]
            out.extend([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)])
            counts.append(n)
    made = np.zeros(len(texts), np.uint64)
    n = np.array(counts, np.int64)
    if out:
        bits = np.unpackbits(np.frombuffer(b"".join(out), np.uint8).reshape(-1, 8), axis=1)
        some = np.flatnonzero(n)
        first = np.cumsum(n) - n
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        made[some] = np.packbits(2 * ones > n[some, None], axis=1).view(">u8").ravel()
    return made


def _fingerprint_rows(key: str, text: str, words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, text, textops.CHUNK_BYTES // 2):
                raw, offsets = textops.utf8(chunk.column(text))
                data, at = raw.tobytes(), offsets.tolist()
                made = _fingerprints([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], words_each)
                yield pa.RecordBatch.from_arrays([chunk.column(key).cast(pa.int64()), pa.array(made.view(np.int64))], names=["id", "fp"])

    return run


def _close(a: np.ndarray, b: np.ndarray, start: int, bits: int) -> np.ndarray:
    """Of each a and b, whether each chain from ``start`` keeps its budget."""
    turn = np.uint64(8 * start)
    both = a[:, None] ^ b[None, :]
    if start:
        both = (both << turn) | (both >> (np.uint64(64) - turn))
    ok = np.bitwise_count(both >> np.uint64(64 - 8 * CHAIN)) <= budget(CHAIN, bits)
    i, j = np.nonzero(ok)
    chain = both[i, j]
    for n in (*range(1, CHAIN), *range(CHAIN + 1, SEGMENTS + 1)):
        good = np.bitwise_count(chain >> np.uint64(64 - 8 * n)) <= budget(n, bits)
        i, j, chain = i[good], j[good], chain[good]
    out = np.zeros(len(b), bool)
    out[j] = True
    return out


def group_links(fps: np.ndarray, start: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Components of two or more among a key's fingerprints: one member, all others."""
    rest = np.unique(fps)
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        front, found = rest[:0], []
        turn = np.array([seed])
        while len(turn) and len(rest):
            near = _close(turn, rest, start, bits)
            new, rest = rest[near], rest[~near]
            found.append(new)
            front = np.concatenate((front, new))
            turn, front = front[:128], front[128:]
        members = np.concatenate(found) if found else rest[:0]
        if len(members):
            yield int(seed), members


class _Union:
    """Union-find over what one task links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def add(self, x: int, others: list[int]) -> None:
        for y in others:
            a, b = self.root(x), self.root(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def rows(self) -> Iterator[pa.RecordBatch]:
        links = [(x, self.root(x)) for x in self.up]
        for k in range(0, len(links), 50_000):
            yield _links([x for x, _ in links[k : k + 50_000]], [y for _, y in links[k : k + 50_000]])


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def _find(tables: list[tuple[int, ...]], bits: int):
    """Links among rows sorted by key and two of its blocks, which may be one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = _Union()
        at, held = None, []

        def close():
            if held:
                for seed, members in group_links(np.concatenate(held), tables[at[0] >> 40][0], bits):
                    union.add(seed, members.tolist())

        for batch in batches:
            k, i, j, fps = (batch.column(x).to_numpy() for x in range(4))
            edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))).tolist()
            for a, b in zip(edge, [*edge[1:], len(k)], strict=True):
                if (int(k[a]), int(i[a]), int(j[a])) != at:
                    close()
                    at, held = (int(k[a]), int(i[a]), int(j[a])), []
                held.append(fps[a:b].view(np.uint64))
        close()
        yield from union.rows()

    return run


def link_fingerprints(distinct: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect what differs in ``bits`` bits or fewer.

    ``distinct`` has each fingerprint once, as a long in ``fp``.
    """
    tables = equal_segments(bits)
    n = runtime.partitions(distinct.sparkSession)
    width = 8

    def byte(k: int):
        return F.shiftrightunsigned("fp", 56 - 8 * k).bitwiseAND(F.lit(255).cast("long"))

    def key(table: int, segments: tuple[int, ...]):
        # Up to five bytes; the table's number above them.
        out = F.lit(table << 40).cast("long")
        for i, s in enumerate(segments):
            out = out.bitwiseOR(F.shiftleft(byte(s), width * i))
        return out

    keyed = distinct.select(F.explode(F.array(*[key(t, x[1:]) for t, x in enumerate(tables)])).alias("key"), "fp")
    dealt = _dealt(keyed).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return runtime.cut(dealt, _find(tables, bits), "a long, b long")


def _dealt(keyed: DataFrame) -> DataFrame:
    """(``key``, ``i``, ``j``, ``fp``): what meets in one group.

    Keys are counted first.  One with more than ``BLOCK`` fingerprints is dealt to
    blocks by their hash, and every two of its blocks, or a block with itself, are a
    group; so no task holds all of a key.  Keys that are so large are broadcast if
    they are few.
    """
    large = runtime.cut(keyed.groupBy(F.col("key").alias("large")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    few = large.count()
    if not few:
        return keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    met = keyed.join(F.broadcast(large) if few <= MAX_BROADCAST_KEYS else large, F.col("key") == F.col("large"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = met.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def near_duplicates(docs: DataFrame, words_each: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``fingerprint``, ``component_id``) of every row.

    Texts are lower-cased in A-Z and split at space and U+0009 to U+000D.  A
    text's shingles are its runs of ``words_each`` words, repeats included; with
    fewer words, all of them; with none the fingerprint is zero.  A bit is 1 if
    it is set in more than half of the shingles' XXH64 (seed 42).  Fingerprints
    that differ in ``bits`` bits or fewer are linked; ``component_id`` is the
    least key that links reach.

    Null texts are as empty ones, and link like any other.  Repeated rows
    share a fingerprint.  A null key is never the least; a component of null
    keys only has none.  ``key`` must be an integer column, else a TypeError says
    so.  Other columns are not looked at.
    """
    runtime.integer_key(docs, key)
    made = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = runtime.cut(runtime.spread(made), textops.lean(_fingerprint_rows("id", "text", words_each)), "id long, fp long")
    first = runtime.cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components.connected(link_fingerprints(first.select("fp"), bits), "a", "b")
    joined = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = runtime.cut(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    of = runtime.cut(joined.join(least, "root").select("fp", "component_id"))
    out = rows.join(of, "fp")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words_each: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, of which one document of each group stays.

    Of what ``near_duplicates`` puts together the least key stays.  Rows of one
    key stay or go together; rows that have only null keys to go with stay.
    """
    found = near_duplicates(docs, words_each, bits, key, text)
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("stays")).distinct()
    return docs.join(stay, docs[key].eqNullSafe(stay["stays"]), "left_semi")
