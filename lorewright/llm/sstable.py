"""Sorted string tables of token ids.

A table file holds one range of keys in ascending order:

    blocks   zstd of entries: (shared key length, rest length, value length as
             variable-length integers, rest of the key, value), then the
             offsets of the entries whose key is whole (every ``RESTART``) and
             their number, both as unsigned 32-bit integers
    index    one entry per block: first key, offset, length, ids before it
    bloom    bits set by double hashing of the key's XXH64
    footer   fixed: offsets and lengths of index and bloom, number of entries,
             number of ids, bytes per id, magic

A key is a byte for null or not, the id as a big-endian integer with its sign
bit turned, a share number (0, but for an id that so many rows have that several
tasks write them) and a count among rows of one id and share, so that bytes sort
as ids do.  A look-up tests the Bloom filter, searches the sparse index, reads
one block and searches its whole keys.

Spark sorts the rows; a task writes block after block and starts a new file at
``FILE_BYTES``, and reading goes block by block as well, so what a task holds
does not grow with the table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files, runtime, textops

MAGIC = b"LWSSTAB1"
BLOCK_BYTES = 64 << 10
#: Compressed bytes after which a new file begins; bytes read at a time.
FILE_BYTES, READ_BYTES = 128 << 20, 2 << 20
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")
_ENTRY = struct.Struct("<17sQIQ")
#: Distinct pieces of text that one worker remembers.
REMEMBERED = 1_500_000
#: Texts with other bytes, an apostrophe or a special token's string go to the
#: library whole; what is left is ASCII and Latin letters of two bytes.
_OTHER = re.compile(rb"[^\t\n\r -&(-~\x80-\xbf\xc3-\xc5]|\xc3[\x97\xb7]")
_SPACE, _LETTER, _DIGIT, _REST = range(4)
_CLASS = np.array([_SPACE if b in b"\t\n\r " else _DIGIT if 0x30 <= b <= 0x39 else _LETTER if b >= 0x80 or chr(b).isalpha() else _REST for b in range(256)], np.uint8)


_KEY = struct.Struct(">BQII")


def key_bytes(doc_id: int | None, share: int = 0, nth: int = 0) -> bytes:
    return _KEY.pack(doc_id is not None, ((doc_id or 0) + (1 << 63)) & (1 << 64) - 1, share, nth)


def key_id(key: bytes) -> int | None:
    known, value, _, _ = _KEY.unpack(key)
    return value - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


class Writer:
    """Writes one table from entries in ascending order of key, block by block."""

    def __init__(self, sink, id_bytes: int):
        """``sink`` has ``write``."""
        self.sink, self.id_bytes, self.pack = sink, id_bytes, zstandard.ZstdCompressor(level=3)
        self.at, self.index, self.bloom_of = 0, [], []
        self.ids = self.entries = 0
        self._start()

    def _start(self) -> None:
        self.body, self.size, self.restarts, self.last, self.n = [], 0, [], b"", 0
        self.first, self.before = None, self.ids

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.body += [entry, value]
        self.size += len(entry) + len(value)
        self.first = self.first or key
        self.last, self.n = key, self.n + 1
        self.bloom_of.append(xxhash.xxh64_intdigest(key))
        self.ids += len(value) // self.id_bytes
        self.entries += 1
        if self.size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.n:
            block = self.pack.compress(b"".join([*self.body, struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))]))
            self.index.append(_ENTRY.pack(self.first, self.at, len(block), self.before))
            self.sink.write(block)
            self.at += len(block)
            self._start()

    def finish(self) -> None:
        self._close()
        index, bloom = b"".join(self.index), _bloom(np.array(self.bloom_of, np.uint64))
        self.sink.write(index + bloom + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.id_bytes, MAGIC))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return (hashes[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
    out = np.zeros(bits, np.uint8)
    out[_places(hashes, bits).ravel().astype(np.int64)] = 1
    return np.packbits(out).tobytes()


class Reader:
    """One table: whole scans, and look-ups that read one block."""

    def __init__(self, read, size: int):
        """``read(offset, length)`` gives bytes of the file of ``size`` bytes."""
        self.read = read
        at, n, self.bloom_at, self.bloom_n, self.entries, self.ids, self.id_bytes, magic = _FOOTER.unpack(read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        self.index = list(_ENTRY.iter_unpack(read(at, n)))
        self.unpack = zstandard.ZstdDecompressor()
        self.blooms = None

    @classmethod
    def of(cls, data: bytes) -> Reader:
        return cls(lambda offset, length: data[offset : offset + length], len(data))

    @classmethod
    def at(cls, uri: str) -> Reader:
        system, path = files.opened(uri)
        return cls(lambda offset, length: files.read_range(uri, offset, length), system.get_file_info(path).size)

    def _block(self, k: int) -> bytes:
        _, offset, length, _ = self.index[k]
        return self.unpack.decompress(self.read(offset, length))

    @staticmethod
    def _entries(block: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _unvarint(block, at)
            rest, at = _unvarint(block, at)
            size, at = _unvarint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, block[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries in order; blocks that follow one another are read together."""
        k = 0
        while k < len(self.index):
            begin, end = k, self.index[k][1]
            while k < len(self.index) and (k == begin or end + self.index[k][2] - self.index[begin][1] <= READ_BYTES):
                end += self.index[k][2]
                k += 1
            data, base = self.read(self.index[begin][1], end - self.index[begin][1]), self.index[begin][1]
            for _, offset, length, _ in self.index[begin:k]:
                block = self.unpack.decompress(data[offset - base : offset - base + length])
                (n,) = struct.unpack_from("<I", block, len(block) - 4)
                yield from self._entries(block, 0, len(block) - 4 * n - 4)

    def may_have(self, key: bytes) -> bool:
        if self.blooms is None:
            self.blooms = np.unpackbits(np.frombuffer(self.read(self.bloom_at, self.bloom_n), np.uint8))
        return bool(self.blooms[_places(np.array([xxhash.xxh64_intdigest(key)], np.uint64), len(self.blooms)).astype(np.int64)].all())

    def get(self, doc_id: int | None, share: int = 0, nth: int = 0) -> list[int] | None:
        key = key_bytes(doc_id, share, nth)
        k = bisect_right(self.index, key, key=lambda x: x[0]) - 1
        if k < 0 or not self.may_have(key):
            return None
        block = self._block(k)
        (n,) = struct.unpack_from("<I", block, len(block) - 4)
        whole = struct.unpack_from(f"<{n}I", block, len(block) - 4 * n - 4)
        at = bisect_right(whole, key, key=lambda x: next(self._entries(block, x, x + 1))[0]) - 1
        for k, value in self._entries(block, whole[max(at, 0)], len(block) - 4 * n - 4):
            if k >= key:
                return np.frombuffer(value, f"<u{self.id_bytes}").tolist() if k == key else None
        return None


def piece_starts(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level pre-tokenisation begin.

    Runs of letters, of digits and of other marks are pieces, each with one
    space before it if there is one.  Of white space that something follows the
    last character stands alone or is that space; the rest is one piece.
    """
    kind = _CLASS[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    begins[1:] = kind[1:] != kind[:-1]
    begins[edges] = True
    at = np.flatnonzero(begins)
    out = np.zeros(len(raw), bool)
    out[at[kind[at] == _SPACE]] = True
    runs = at[kind[at] != _SPACE]
    first = np.zeros(len(raw), bool)
    first[0] = first[edges] = True
    inner = runs[~first[runs]]
    out[runs[first[runs]]] = True
    before = kind[inner - 1] == _SPACE
    out[inner[before] - 1] = True
    out[inner[raw[inner - 1] != 0x20]] = True
    return np.flatnonzero(out)


def _heads(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length and first eight bytes of each piece, so that short ones differ if their texts do."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))[starts]
    size = ends - starts
    kept = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(size, 7).astype(np.uint64))) - np.uint64(1))
    return (eight & kept) + textops.mix(size.astype(np.uint64))


class _Memory:
    """Ids of pieces by hash and head: two sorted levels over one pool."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.levels = [none, none]
        self.pool, self.size = np.zeros(1 << 16, self.kind), 0

    def find(self, hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Place and number of the ids of each piece, number 0 if not known; whether a hash has two heads."""
        at, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        clash = False
        for known, head, where, count in self.levels:
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                ok = known[k] == hashes
                clash |= bool((head[k[ok]] != heads[ok]).any())
                at[ok], n[ok] = where[k[ok]], count[k[ok]]
        return at, n, clash

    def add(self, hashes: np.ndarray, heads: np.ndarray, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        while self.size + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), self.kind)))
        self.pool[self.size : self.size + total] = np.fromiter(chain.from_iterable(ids), self.kind, total)
        new = (hashes, heads, self.size + np.cumsum(count) - count, count)
        self.size += total
        large, small = self.levels
        small = self._merged(small, new)
        self.levels = [large, small] if len(small[0]) < 100_000 else [self._merged(large, small), tuple(x[:0] for x in small)]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0])
        return tuple(x[order] for x in both)

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)


class Encoder:
    """The tokenizers library, remembering pieces that come again."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        said = json.loads(spec)
        self.special = [x["content"].encode() for x in said["added_tokens"]]
        before = said["pre_tokenizer"] or {}
        #: Pieces can be encoded one by one only where this is all that is done.
        self.by_piece = said["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.memory = _Memory(self.kind)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian integers of ``kind``."""
        out = [b""] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self.by_piece and _OTHER.search(t) is None and not any(s in t for s in self.special) else other).append(i)
        for i, ids in zip(other, self._ids([texts[i].decode() for i in other]), strict=True):
            out[i] = np.array(ids, self.kind).tobytes()
        for i, ids in zip(plain, self._by_piece([texts[i] for i in plain]) if plain else [], strict=True):
            out[i] = ids
        return out

    def _by_piece(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        raw, edges = np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)])
        starts = piece_starts(raw, edges[:-1])
        ends = np.append(starts[1:], len(raw))
        heads = _heads(raw, starts, ends)
        distinct, example, which = np.unique(textops.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        mine = heads[example]
        at, n, clash = self.memory.find(distinct, mine)
        if clash or (heads != mine[which]).any():
            # Two pieces share a hash: the library takes the texts whole.
            return [np.array(ids, self.kind).tobytes() for ids in self._ids([t.decode() for t in texts])]
        new = np.flatnonzero(n == 0)
        if len(new):
            of = example[new]
            self.memory.add(distinct[new], mine[new], self._ids([data[a:b].decode() for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)]))
            at, n, _ = self.memory.find(distinct, mine)
        count = n[which]
        stop = np.cumsum(count)
        place = np.arange(stop[-1]) + np.repeat(at[which] - stop + count, count)
        flat, size = self.memory.pool[place].tobytes(), self.memory.pool.itemsize
        cut = (size * np.append(0, stop)[np.searchsorted(starts, edges)]).tolist()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = textops.cache("sstable")


def _encoder(spec: str) -> Encoder:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(spec)
    return _ENCODERS[name]


_MANIFEST = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("entries", pa.int64()), ("ids", pa.int64())])
_MANIFEST_SQL = "part int, nth int, file string, first_key binary, last_key binary, entries long, ids long"


def write_tables(docs: DataFrame, tokenizer: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", groups: int | None = None) -> DataFrame:
    """Encode every text and write the ids as tables below ``folder`` (a URI).

    Returns the manifest, one row per file: ``part``, ``nth`` (file of the
    part), ``file``, ``first_key``, ``last_key`` (as in the file), ``entries``,
    ``ids`` and ``ids_before``, those of all files before it.  ``tokenizer`` is
    a path on the driver.  Parts are ranges of keys, cut at quantiles of all
    keys, and follow one another in ascending order.  A key that several
    quantiles fall on is dealt to as many parts by hash.  ``end_id`` ends every
    document.

    Null and empty texts are the end id alone; null keys come first; rows of
    one key are kept apart, in each of its shares in the order of their ids.
    ``key`` must be an integer column, else a TypeError says so; other columns
    are not looked at.  A file is named by the attempt that wrote it and counts
    only if the manifest lists it, so a repeated task leaves no half file in use.
    """
    runtime.integer_key(docs, key)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    cuts = runtime.range_cuts(rows, F.coalesce("key", F.lit(runtime.LEAST)), groups or runtime.partitions(spark))
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    files.make_dir(folder)
    size = Encoder(sent.value).kind

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent.value)
        end = np.array([end_id], coder.kind).tobytes()
        for batch in batches:
            for chunk in textops.split_chunks(batch, "text"):
                raw, offsets = textops.utf8(chunk.column("text"))
                data, cut = raw.tobytes(), offsets.tolist()
                ids = [x + end for x in coder.encode([data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])]
                part, share = runtime.range_parts(chunk.column("key"), cuts, ids)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(share, pa.int32()), chunk.column("key"), pa.array(ids, pa.binary())], names=["part", "share", "key", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = first = last = uri = at = None
        nth = 0

        def closed() -> pa.RecordBatch:
            writer.finish()
            sink.close()
            values = (at, nth, uri, first, last, writer.entries, writer.ids)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _MANIFEST, strict=True)], schema=_MANIFEST)

        count, before = 0, None
        for batch in batches:
            for part, share, doc, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer and (part != at or writer.at > FILE_BYTES):
                    yield closed()
                    writer, nth = None, nth + 1 if part == at else 0
                if writer is None:
                    at, uri = part, f"{folder}/part-{part:06d}-{nth:04d}-{files.attempt_name()}.sst"
                    system, path = files.opened(uri)
                    sink = system.open_output_stream(path, compression=None)
                    writer, first = Writer(sink, int(size[-1])), None
                count = count + 1 if (part, share, doc) == before else 0
                before = (part, share, doc)
                last = key_bytes(doc, share, count)
                first = first or last
                writer.add(last, value)
        if writer:
            yield closed()

    coded = runtime.spread(rows).mapInArrow(textops.lean(encode, "sstable"), "part int, share int, key long, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("key"), "ids")
    written = runtime.cut(dealt, textops.lean(write, "sstable"), _MANIFEST_SQL)
    # One row per part reaches the driver, whatever the input's size.
    before, offsets = 0, []
    for part, ids in sorted(map(tuple, written.groupBy("part").agg(F.sum("ids")).collect())):
        offsets.append((part, before))
        before += ids
    met = written.join(F.broadcast(spark.createDataFrame(offsets, "part int, part_before long")), "part")
    inner = F.coalesce(F.sum("ids").over(W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("ids_before", F.col("part_before") + inner).drop("part_before")


def read_tables(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``key``, ``start``, ``n_tokens``, ``ids``.

    ``ids`` is binary, little-endian unsigned 32-bit; ``start`` is the number of
    ids of all documents before.  A task reads the footer and index of a file,
    then its blocks by ranges.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = Reader.at(uri)
                out: list[list] = [[], [], [], []]
                held = 0
                for key, value in table.scan():
                    n = len(value) // table.id_bytes
                    ids = value if table.id_bytes == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    for x, v in zip(out, (key_id(key), at, n, ids), strict=True):
                        x.append(v)
                    at += n
                    held += len(ids)
                    if held > 4 << 20:
                        yield _read_rows(out)
                        out, held = [[], [], [], []], 0
                if out[0]:
                    yield _read_rows(out)

    return manifest.select("file", "ids_before").repartition(runtime.partitions(manifest.sparkSession)).mapInArrow(textops.lean(parse, "sstable"), "key long, start long, n_tokens long, ids binary")


def _read_rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["key", "start", "n_tokens", "ids"])


def find_documents(keys: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, ``ids``) of each row of ``keys``, ids null for what no table has.

    The manifest's keys, one entry a file, go to the tasks, which search them;
    rows are dealt by file, and there each asks the Bloom filter and searches
    the sparse index and one block.  Of ids that several rows have the first
    counts.  A null key asks for the rows without one.
    """
    runtime.integer_key(keys, key)
    listed = sorted((bytes(r["first_key"]), r["file"]) for r in manifest.select("first_key", "file").collect())
    sent = keys.sparkSession.sparkContext.broadcast(listed)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _ in sent.value]
        for batch in batches:
            at = [bisect_right(firsts, key_bytes(k)) - 1 for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], names=["key", "at"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, opened = None, -1
        for batch in batches:
            out = []
            for doc, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != opened:
                    table, opened = Reader.at(sent.value[at][1]) if at >= 0 else None, at
                found = table.get(doc) if table else None
                out.append(None if found is None else np.array(found, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "ids"])

    n = runtime.partitions(keys.sparkSession)
    routed = keys.select(F.col(key).cast("long").alias("key")).mapInArrow(route, "key long, at int")
    return routed.repartition(n, "at", "key").sortWithinPartitions("at", "key").mapInArrow(look, "key long, ids binary").withColumnRenamed("key", key)
