"""Near duplicates by similarity: wide SimHash finds candidates, shingles decide.

A SimHash of 512 bits estimates the similarity of two texts' shingles: with
Jaccard similarity s about arccos(2s / (1 + s)) / pi of the bits differ.  Which
fingerprints meet is decided by parts of the shingles: hash values deal a text's
shingles to groups of about ``GROUP`` each, and a group is a key.  The number of
groups follows the text's length by powers of two; lengths near a border take
both.  A text of fewer than ``KEYS`` groups is dealt anew by other hash values,
until there are so many.  Of texts of a similarity of 0.8 a group is the same,
and has two shingles at least, in about a third of cases, so ``KEYS`` groups
miss less than one pair in a thousand (the README has the share by length).

What meets in a key must be within a Hamming budget, which is wide enough that
only chance of less than one in a million loses a pair; pairs are dropped segment
by segment.  The segments are a ring, as in ``simhash``: a pair within the budget has
a segment from which every chain of segments keeps its share of the budget
(pigeonring principle), so pairs without one are dropped before the distance is
taken.  The
candidates' components are small tables of their own, in which the shingles
themselves are compared: only texts of which the exact similarity is enough are
linked.

Texts of the same set of shingles are one node, so copies cost nothing; others
keep keys of their own, even if one shingle that is repeated fills most of each.
Shingles are made distinct first.  The nodes of a key or component are not
paired off, as in ``simhash``; one with too many is split in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, runtime, textops
from .simhash import BLOCK, _Union

WORDS, BITS, SEGMENTS = 8, 512, 8
GROUP, KEYS = 4, 24
#: Up to this power of two of groups, keys are odd and one shingle may be a key.
SHORT = 2
#: Nodes of a block where a key has few blocks, and how many are few.
SMALL_BLOCK, FEW_BLOCKS = 256, 12
#: Shingles of a block of texts that are compared, at most about.
BLOCK_BYTES = 16 << 20
#: Keys of many texts that are broadcast, at most.
MAX_BROADCAST_KEYS = 100_000
_U = np.uint64
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_SEEDS = [_U(0x1F83D9ABFB41BD6B + 2 * k * 0x5BE0CD19137E2179 & (1 << 64) - 1) for k in range(WORDS)]


def bit_budget(similarity: float, short: bool = False) -> int:
    """Differing bits to allow: what is expected, and five standard deviations.

    Texts of a few shingles have many ties, so ``short`` ones have nine.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(BITS * p + (9 if short else 5) * math.sqrt(BITS * p * (1 - p)))


def _shingles(raw: np.ndarray, offsets: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted; a shorter text is one."""
    folded = _FOLD[raw]
    starts, ends, first = textops.word_spans(folded, offsets, textops.NOT_SPACE)
    words = textops.span_hashes(folded, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = textops.window_hashes(words, words_each)
    ok = np.flatnonzero(row[: len(hashes)] == row[words_each - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < words_each))
    own = np.array([xxhash.xxh64_intdigest(words[first[i] : first[i + 1]].tobytes()) for i in short], np.uint64)
    row, hashes = np.concatenate((row[ok], short)), np.concatenate((hashes[ok], own))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def _set_ids(row: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    """128 bits for the set of shingles of each of ``n`` rows; zeros if it is empty."""
    out = np.zeros((n, 2), np.uint64)
    some, first = np.unique(row, return_index=True)
    for k, salt in enumerate((_U(0x3C6EF372FE94F82B), _U(0xBB67AE8584CAA73B)) if len(some) else ()):
        out[some, k] = textops.mix(np.add.reduceat(textops.mix(hashes ^ salt), first))
    data = out.tobytes()
    return [data[i : i + 16] for i in range(0, 16 * n, 16)]


def sketches(raw: np.ndarray, offsets: np.ndarray, words_each: int) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """512-bit fingerprints as eight words a row, the keys of each row, its set's id."""
    n = len(offsets) - 1
    row, hashes = _shingles(raw, offsets, words_each)
    sets = _set_ids(row, hashes, n)
    count = np.bincount(row, minlength=n)
    some = np.flatnonzero(count)
    prints = np.zeros((n, WORDS), np.uint64)
    first = (np.cumsum(count) - count)[some]
    for k, seed in enumerate(_SEEDS if len(some) else ()):
        bits = np.unpackbits(textops.mix(hashes + seed).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        prints[some, k] = np.packbits(2 * ones > count[some, None], axis=1).view(">u8").ravel()
    x = np.log2(np.maximum(count, 1) / GROUP)
    rows, keys = [np.flatnonzero(count == 0)], [np.zeros(int((count == 0).sum()), np.uint64)]
    low, high = (np.maximum(1, np.rint(x + d)).astype(np.int64) for d in (-0.17, 0.17))
    for turn in range(KEYS // 2):
        if turn:
            again = np.flatnonzero((turn << np.minimum(low, 5) < KEYS)[row])
            row, hashes = row[again], hashes[again]
        dealt = textops.mix(hashes + _U(turn)) if turn else hashes
        for which, use in ((low, count > 0), (high, (count > 0) & (high != low))):
            # Of a text's groups those of this turn, so that it has KEYS in all.
            most = KEYS - (turn << np.minimum(which, 5))
            level = which[row]
            group = dealt >> (64 - level).astype(np.uint64)
            mine = np.flatnonzero((use & (most > 0))[row] & (group < np.clip(most, 0, KEYS)[row].astype(np.uint64)))
            if not len(mine):
                continue
            place = row[mine] * KEYS + group[mine].astype(np.int64)
            order = np.argsort(place, kind="stable")
            place = place[order]
            edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            total = np.add.reduceat(textops.mix(hashes[mine[order]] ^ _U(0xA5A5A5A5)), edge)
            size = np.diff(edge, append=len(place))
            of, at = place[edge] // KEYS, place[edge] % KEYS
            # One shingle alone is shared by many longer texts that are not alike.
            enough = (size > 1) | (which[of] <= SHORT)
            made = textops.mix(total + textops.mix(((turn << 16) + which[of] * KEYS + at).astype(np.uint64)))
            rows.append(of[enough])
            keys.append((made[enough] & ~_U(1)) | (which[of[enough]] <= SHORT))
    of, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(of, kind="stable")
    return prints, np.split(key[order], np.searchsorted(of[order], np.arange(1, n))), sets


def _sketch_rows(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, "text", textops.CHUNK_BYTES // 2):
                prints, keys, sets = sketches(*textops.utf8(chunk.column("text")), words_each)
                data = prints.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id"), pa.array([data[i : i + 8 * WORDS] for i in range(0, len(data), 8 * WORDS)], pa.binary()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["id", "print", "keys", "set"]
                )

    return run


def _ringed(apart: np.ndarray, bits: int) -> np.ndarray:
    """Of rows of the segments' distances, whether from some segment each chain around the ring keeps its share of ``bits``."""
    ok, chain = np.ones(apart.shape, bool), np.zeros(apart.shape, np.int32)
    for n in range(SEGMENTS):
        chain += np.roll(apart, -n, axis=1)
        ok &= SEGMENTS * chain <= (n + 1) * bits
    return ok.any(axis=1)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Of each b, whether some a is within ``bits`` of it; half of the segments, the ring's chains, then all."""
    out = np.zeros(len(b), bool)
    for k in range(0, len(b), 512):
        part = b[k : k + 512]
        # Half of the segments show nearly all pairs that are not alike to differ too much.
        half = sum(np.bitwise_count(a[:, None, n] ^ part[None, :, n]).astype(np.int16) for n in range(SEGMENTS // 2))
        i, j = np.nonzero(half <= bits)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            apart = np.bitwise_count(a[p] ^ part[q]).astype(np.int32)
            kept = _ringed(apart, bits)
            q, apart = q[kept], apart[kept]
            out[k + q[apart.sum(axis=1) <= bits]] = True
    return out


def key_links(ids: np.ndarray, prints: np.ndarray, bits: int) -> Iterator[tuple[int, list[int]]]:
    """Components among a key's fingerprints: one member, all others."""
    rest = np.arange(len(ids))
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        turn, front, found = seed, rest[:0], []
        while len(turn) and len(rest):
            near = _near(prints[turn], prints[rest], bits)
            new, rest = rest[near], rest[~near]
            found.append(new)
            front = np.concatenate((front, new))
            turn, front = front[:32], front[32:]
        members = np.concatenate(found) if found else rest[:0]
        if len(members):
            yield int(ids[seed[0]]), ids[members].tolist()


def exact_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, list[int]]]:
    """Components among sets of shingles by Jaccard similarity: one member, all others."""
    sets = sorted(zip(map(len, sets), ids.tolist(), sets, strict=True), key=lambda x: x[:2])
    size, ids = np.array([n for n, _, _ in sets]), np.array([i for _, i, _ in sets], np.int64)
    names, code = np.unique(np.concatenate([x for _, _, x in sets]), return_inverse=True)
    parts = np.split(code, np.cumsum(size)[:-1])
    mark = np.zeros(len(names), bool)
    # What is not found yet, by size; the codes are packed again as it shrinks.
    free = np.ones(len(ids), bool)
    held, flat = np.arange(len(ids)), code
    for seed in range(len(ids)):
        if not free[seed]:
            continue
        free[seed] = False
        turn, found = [seed], []
        while turn and free.any():
            x = turn.pop()
            if 2 * np.count_nonzero(free) < len(held):
                held = np.flatnonzero(free)
                flat = np.concatenate([parts[k] for k in held])
            lens = size[held]
            low, high = np.searchsorted(lens, similarity * size[x] - 1e-9), np.searchsorted(lens, size[x] / similarity + 1e-9, side="right")
            if low == high:
                continue
            edge = np.concatenate(([0], np.cumsum(lens)))
            mark[parts[x]] = True
            both = np.add.reduceat(mark[flat[edge[low] : edge[high]]], edge[low:high] - edge[low], dtype=np.int32)
            mark[parts[x]] = False
            # The similarity is exact, but for the rounding of its bound.
            near = held[low:high][both >= similarity * (lens[low:high] + size[x] - both) - 1e-9]
            near = near[free[near]]
            free[near] = False
            turn.extend(near.tolist())
            found.extend(near.tolist())
        if found:
            yield int(ids[seed]), ids[found].tolist()


def _set_rows(words_each: int):
    """Of rows (id, text, set, root): the shingles as a binary, if they are that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, "text", textops.CHUNK_BYTES // 2):
                row, hashes = _shingles(*textops.utf8(chunk.column("text")), words_each)
                parts = np.split(hashes, np.searchsorted(row, np.arange(1, len(chunk))))
                same = zip(_set_ids(row, hashes, len(chunk)), chunk.column("set").to_pylist(), strict=True)
                some = [k for k, (a, b) in enumerate(same) if a == b and len(parts[k])]
                data = pa.array([parts[k].tobytes() for k in some], pa.binary())
                some = pa.array(some, pa.int64())
                yield pa.RecordBatch.from_arrays([chunk.column("root").take(some), chunk.column("id").take(some), data], names=["key", "node", "data"])

    return run


def _by_print(similarity: float):
    bits = [bit_budget(similarity), bit_budget(similarity, short=True)]
    return lambda key, ids, data: key_links(ids, np.frombuffer(b"".join(data), np.uint64).reshape(-1, WORDS), bits[key & 1])


def _by_shingles(similarity: float):
    return lambda key, ids, data: exact_links(ids, [np.frombuffer(x, np.uint64) for x in data], similarity)


def _find(links):
    """Links among the rows of each (key, i, j), which come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = _Union()
        at, ids, held = None, [], []

        def close():
            if len(ids) > 1:
                for seed, members in links(at[0], np.array(ids, np.int64), held):
                    union.add(seed, members)
            ids.clear()
            held.clear()

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for place, i, x in zip(places, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if place != at:
                    close()
                    at = place
                ids.append(i)
                held.append(x)
        close()
        for made in union.rows():
            yield made.select(["a", "b"])

    return run


def _linked(keyed: DataFrame, links) -> DataFrame:
    """(``a``, ``b``) of what ``links`` finds in each key of (key, node, data)."""
    n = runtime.partitions(keyed.sparkSession)
    dealt = _dealt(keyed).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return runtime.cut(dealt, textops.lean(_find(links)), "a long, b long")


def _dealt(keyed: DataFrame) -> DataFrame:
    """(``key``, ``i``, ``j``, ``node``, ``data``): what meets in one group.

    A key with more than ``SMALL_BLOCK`` nodes, or ``BLOCK_BYTES``, is dealt to
    blocks by the nodes' hash, and every two of its blocks, or a block with itself,
    are a group.  Up to ``FEW_BLOCKS`` blocks are small, so that one key's groups go
    to many tasks; beyond they have ``BLOCK`` nodes, as each block more is one more
    copy of the key.  The keys that are so large are counted first; they are
    broadcast if they are few.
    """
    n = F.count(F.lit(1))
    small = F.least(F.ceil(n / SMALL_BLOCK), F.lit(FEW_BLOCKS))
    blocks = F.greatest(small, F.ceil(n / BLOCK), F.ceil(F.sum(F.octet_length("data")) / BLOCK_BYTES)).cast("int")
    large = runtime.cut(keyed.groupBy(F.col("key").alias("large")).agg(blocks.alias("blocks")).where("blocks > 1"))
    few = large.count()
    if not few:
        return keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "data")
    met = keyed.join(F.broadcast(large) if few <= MAX_BROADCAST_KEYS else large, F.col("key") == F.col("large"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "data")


def similar_documents(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``component_id``) of every row whose key is not null.

    Texts are lower-cased in A-Z and split at space and U+0009 to U+000D;
    shingles are the distinct runs of ``words_each`` words, or all words of a
    shorter text.  ``component_id`` is the least key that links of a Jaccard
    similarity of ``similarity`` or more reach.  Texts without words are alike.
    Rows of one key count as that key's; other columns are not looked at.
    """
    runtime.integer_key(docs, key)
    made = runtime.spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null"))
    rows = runtime.cut(made, textops.lean(_sketch_rows(words_each)), "id long, print binary, keys array<long>, set binary")
    nodes = runtime.cut(rows.groupBy("set").agg(F.min(F.struct("id", "print", "keys")).alias("m")).select("set", F.col("m.id").alias("node"), "m.print", "m.keys"))
    maybe = _linked(nodes.select(F.explode("keys").alias("key"), "node", F.col("print").alias("data")), _by_print(similarity))
    met = nodes.select("set", "node").join(components.connected(maybe, "a", "b"), "node").select(F.col("node").alias("id"), "set", "root")
    sets = runtime.cut(made.join(met, "id").select("id", "text", "set", "root"), textops.lean(_set_rows(words_each)), "key long, node long, data binary")
    roots = components.connected(_linked(sets, _by_shingles(similarity)), "a", "b")
    of = nodes.select("set", "node").join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("component_id"))
    return rows.select("id", "set").join(runtime.cut(of), "set").select(F.col("id").alias(key), "component_id")


def drop_similar(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, of which one document of each group stays.

    That of the least key stays.  Rows of one key stay or go together, and go if
    any of them belongs to a smaller key's group; rows with a null key stay.
    """
    found = similar_documents(docs, words_each, similarity, key, text)
    gone = found.where(F.col(key) > F.col("component_id")).select(F.col(key).alias("goes"))
    return docs.join(gone, docs[key] == gone["goes"], "left_anti")
