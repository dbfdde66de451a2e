"""Removal of word windows that an earlier document already holds.

Every window of ``width`` consecutive words is hashed (Rabin-Karp over word
hashes) and the occurrences are counted in Spark: grouped by hash, the least
document id of each hash is found, and every occurrence in a larger document
is marked.  Marked windows merge into maximal intervals of words, which go.

What moves is packed.  Consecutive windows mostly share the least hash of
their five-word parts and are dealt by it, so one row holds many runs of
windows and a window costs little more than its eight hash bytes.  A part that
common wording puts into too many windows is dealt by the windows' own hashes
instead; such parts are found in a sample, which decides where windows meet but
not which.  Windows are equal if two hashes are: their own of 64 bits, and their
part's, or for a common part's windows a second of their own from another base.
So 64 bits keep apart only windows of one part that is not common, 128 all
others: of 10^13 windows, as 100 TB of text have, a pair or two may be confused.

Within a chunk of texts only the least document's occurrence of a hash is sent
on, and of a common part's windows that within a task, so a passage that a third
of all rows share arrives once per task.  Buckets are as many as the input's
size asks for.  Texts move once, compressed, to meet their marks.  Nothing but
the common parts' hashes, at most ``MAX_HOT``, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime, textops

PART = 5
FLUSH_BYTES = 16 << 20
SPLIT_WINDOWS = 4 << 20
#: Input bytes for each bucket of windows and each group of texts.
BUCKET_BYTES = 8 << 20
#: Windows of one part that are too many for a bucket; such parts at most.
HOT_WINDOWS, MAX_HOT = 200_000, 1_000_000
#: The sample that they are found in: so many bytes of input, or this share.
SAMPLE_BYTES, SAMPLE_SHARE = 16 << 20, 0.001
#: Windows of common parts that a task remembers.
REMEMBERED = 1 << 20
_ROW = "kind int, dest int, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("blob", pa.binary())])
_MARK, _WINDOW, _TEXT = 0, 1, 2
_U = np.uint64
_OTHER_STEP = _U(0xD6E8FEB86659FD93)


def _dest(key: np.ndarray, n: int) -> np.ndarray:
    return (textops.mix(key.astype(np.uint64) + _U(0x51ED270B)) % _U(n)).astype(np.int64)


def _tags(batch: pa.RecordBatch, text: str) -> np.ndarray:
    raw, offsets = textops.utf8(batch.column(text))
    view = memoryview(raw)
    return np.array([zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32)


def _pack(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, run: np.ndarray, check: np.ndarray, hashes: np.ndarray) -> bytes:
    head = np.array([len(doc), len(check), len(hashes)], np.int64).tobytes()
    delta = np.diff(doc, prepend=0)
    return b"".join((head, delta.tobytes(), check.tobytes(), hashes.tobytes(), tag.tobytes(), pos.astype(np.uint32).tobytes(), run.astype(np.uint8).tobytes()))


def _unpack(blob: bytes):
    """Of a blob: doc, tag, position, length and second hash of each run, hash of each window."""
    runs, checks, windows = np.frombuffer(blob, np.int64, 3)
    at, out = 24, []
    for kind, n in ((np.int64, runs), (np.uint64, checks), (np.uint64, windows), (np.uint32, runs), (np.uint32, runs), (np.uint8, runs)):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    doc, check, hashes, tag, pos, run = out
    return np.cumsum(doc), tag, pos, run, check, hashes


def _packed_runs(dest: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, check: np.ndarray | None = None, hashes: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """Blobs by destination of windows, those one after the other of one second hash as one run."""
    if not len(doc):
        return []
    order = np.lexsort((pos, doc, dest))
    dest, doc, tag, pos = dest[order], doc[order], tag[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (dest[1:] != dest[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1)
    if check is not None:
        check, hashes = check[order], hashes[order]
        new[1:] |= check[1:] != check[:-1]
    first = np.flatnonzero(new)
    length = np.diff(first, append=len(doc))
    if length.max() > 255:
        first = np.concatenate([np.arange(f, f + n, 255) for f, n in zip(first, length, strict=True)])
        length = np.diff(first, append=len(doc))
    none = np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(dest[first], prepend=-1))
    out = []
    for a, b in zip(edge, [*edge[1:], len(first)], strict=True):
        lo, hi = first[a], first[b] if b < len(first) else len(doc)
        runs = first[a:b]
        out.append((int(dest[lo]), _pack(doc[runs], tag[runs], pos[runs], length[a:b], *((none, none) if check is None else (check[runs], hashes[lo:hi])))))
    return out


def _rows(kind: int, made: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(made), pa.int32()), pa.array([d for d, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], schema=_SCHEMA
    )


def _least_parts(words: np.ndarray, width: int) -> np.ndarray:
    """For each window the least hash among its parts."""
    part = min(PART, width)
    least = textops.window_hashes(words, part)
    n = max(0, len(words) - width + 1)
    low = least[:n].copy()
    for k in range(1, width - part + 1):
        np.minimum(low, least[k : k + n], out=low)
    return low


def _chunk_windows(batch: pa.RecordBatch, key: str, text: str, width: int, hot: np.ndarray):
    """Of a chunk's windows: doc, tag, position, hash, second hash and what deals them."""
    ids = batch.column(key)
    if ids.null_count:
        batch = batch.filter(ids.is_valid())
        ids = batch.column(key)
    doc = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(doc) > 1 and (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        batch, doc = batch.take(pa.array(order)), doc[order]
    raw, offsets = textops.utf8(batch.column(text))
    words, row, first = _words(raw, offsets)
    windows = textops.window_hashes(words, width)
    ok = np.flatnonzero(row[: len(windows)] == row[width - 1 :]) if len(windows) else np.zeros(0, np.int64)
    row, hashes, least = row[ok], windows[ok], _least_parts(words, width)[ok]
    common = np.zeros(len(ok), bool) if not len(hot) else hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
    deal, check = least, least
    if common.any():
        deal = np.where(common, hashes, least)
        check = np.where(common, textops.window_hashes(words, width, _OTHER_STEP)[ok], least)
    return doc[row], _tags(batch, text)[row], ok - first[row], hashes, check, deal, common


def _words(raw: np.ndarray, offsets: np.ndarray):
    starts, ends, first = textops.word_spans(raw, offsets, textops.NOT_SPACE)
    return textops.span_hashes(raw, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def _first_only(doc: np.ndarray, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Whether each window is in the least document of its two hashes, here."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if (same & (check[order[1:]] != check[order[:-1]])).any():
        order = np.lexsort((check, hashes))
        same = (hashes[order[1:]] == hashes[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    edge = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(doc[order], edge)
    out = np.empty(len(doc), bool)
    out[order] = doc[order] == np.repeat(least, np.diff(edge, append=len(doc)))
    return out


def _count_parts(text: str, width: int):
    """(part, windows) of each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, text):
                words, row, _ = _words(*textops.utf8(chunk.column(text)))
                least = _least_parts(words, width)
                parts, n = np.unique(least[row[: len(least)] == row[width - 1 :]] if len(least) else least, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts.view(np.int64)), pa.array(n)], names=["part", "n"])

    return run


def _common_parts(docs: DataFrame, text: str, width: int, size: int) -> np.ndarray:
    """Hashes, sorted, of the parts that are in too many windows for one bucket.

    Found in a sample of the rows: this steers how windows are dealt, not which
    are compared.  At most ``MAX_HOT`` are kept, the most frequent.
    """
    share = min(1.0, max(SAMPLE_BYTES / max(1, size), SAMPLE_SHARE))
    rows = docs.select(text) if share == 1 else docs.select(text).sample(share, seed=7)
    found = rows.mapInArrow(textops.lean(_count_parts(text, width)), "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    most = found.where(F.col("n") >= max(8.0, HOT_WINDOWS * share)).orderBy(F.desc("n")).limit(MAX_HOT)
    return np.sort(np.array([r["part"] for r in most.select("part").collect()], np.int64).view(np.uint64))


class _Seen:
    """The least document that a task has sent a window for."""

    def __init__(self):
        self.doc, self.hashes, self.check = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def late(self, doc: np.ndarray, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Which windows an earlier document here has; the others are remembered."""
        if len(self.hashes) > REMEMBERED:
            self.__init__()
        n = len(self.hashes)
        both = [np.concatenate(x) for x in ((self.doc, doc), (self.hashes, hashes), (self.check, check))]
        first = _first_only(*both)
        self.doc, self.hashes, self.check = (x[first] for x in both)
        return ~first[n:]


def _send_windows(key: str, text: str, width: int, buckets: int, groups: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        hot, seen = common.value, _Seen()

        def flush():
            doc, tag, pos, hashes, check, deal, common_part = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(doc):
                return
            first = _first_only(doc, hashes, check)
            mine = np.flatnonzero(first & common_part)
            if len(mine):
                first[mine[seen.late(doc[mine], hashes[mine], check[mine])]] = False
            yield _rows(_WINDOW, _packed_runs(_dest(deal[first], buckets), doc[first], tag[first], pos[first], check[first], hashes[first]))
            if not first.all():
                doc, tag, pos = doc[~first], tag[~first], pos[~first]
                yield _rows(_MARK, _packed_runs(_dest(doc, groups), doc, tag, pos))

        for batch in batches:
            for chunk in textops.split_chunks(batch, text):
                held.append(_chunk_windows(chunk, key, text, width, hot))
                size += 36 * len(held[-1][0])
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _mark_windows(groups: int):
    """Of sorted rows of buckets: the windows that a smaller document has."""

    def marks(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b) for b in blobs]
        doc, tag, pos, run, check, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        blobs.clear()
        of = np.repeat(np.arange(len(doc)), run)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(run, dtype=np.int64) - run, run)
        passes = max(1, -(-len(hashes) // SPLIT_WINDOWS))
        for k in range(passes):
            mine = slice(None) if passes == 1 else np.flatnonzero(hashes % _U(passes) == _U(k))
            at = of[mine]
            if not len(at):
                continue
            late = ~_first_only(doc[at], hashes[mine], check[at])
            if late.any():
                at, where = at[late], shift[mine][late]
                yield _rows(_MARK, _packed_runs(_dest(doc[at], groups), doc[at], tag[at], pos[at].astype(np.int64) + where))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        dest = None
        for batch in batches:
            kinds, dests, blobs = (batch.column(i) for i in range(3))
            for i in range(len(batch)):
                if kinds[i].as_py() == _MARK:
                    yield batch.slice(i, 1)
                    continue
                if held and dests[i].as_py() != dest:
                    yield from marks(held)
                dest = dests[i].as_py()
                held.append(blobs[i].as_py())
        if held:
            yield from marks(held)

    return run


def _send_texts(key: str, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(key)
            dest = _dest(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), groups)
            order = np.argsort(dest, kind="stable")
            edge = np.flatnonzero(np.diff(dest[order], prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.take(pa.array(order[a:b])))
                yield _rows(_TEXT, [(int(dest[order[a]]), pack.compress(sink.getvalue()))])

    return run


def _cut_words(text: bytes, covered: np.ndarray, keep_layout: bool) -> bytes:
    """The text without the covered words."""
    if not keep_layout:
        return b" ".join(w for w, c in zip(text.split(), covered, strict=True) if not c)
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = textops.word_spans(raw, np.array([0, len(raw)]), textops.NOT_SPACE)
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = starts[b] if b < len(starts) else ends[b - 1]
    return b"".join([*out, text[at:]])


def _apply(columns: list[str], key: str, text: str, width: int, keep_layout: bool):
    def rows(batch: pa.RecordBatch, marked: dict) -> pa.RecordBatch:
        raw, offsets = textops.utf8(batch.column(text))
        data, tags = raw.tobytes(), _tags(batch, text)
        n_words, n_removed, kept = [], [], []
        for i, doc in enumerate(batch.column(key).to_pylist()):
            body = data[offsets[i] : offsets[i + 1]]
            runs = marked.get((doc, int(tags[i])))
            words = body.split()
            n_words.append(len(words))
            if runs is None:
                n_removed.append(0)
                kept.append(body.decode() if keep_layout else b" ".join(words).decode())
                continue
            step = np.zeros(len(words) + 1, np.int32)
            np.add.at(step, runs[0], 1)
            np.add.at(step, np.minimum(runs[0] + runs[1] + width - 1, len(words)), -1)
            covered = np.cumsum(step[:-1]) > 0
            n_removed.append(int(covered.sum()))
            kept.append(_cut_words(body, covered, keep_layout).decode())
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, "n_words", "n_removed", "kept_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        dest, marked, blobs = None, {}, []
        for batch in batches:
            kinds, dests, packed = (batch.column(i) for i in range(3))
            for i in range(len(batch)):
                if dests[i].as_py() != dest:
                    dest, marked, blobs = dests[i].as_py(), {}, []
                blob = packed[i].as_py()
                if kinds[i].as_py() == _MARK:
                    blobs.append(blob)
                    continue
                if blobs:
                    doc, tag, pos, length = (np.concatenate(x) for x in zip(*(_unpack(b)[:4] for b in blobs), strict=True))
                    blobs = []
                    order = np.lexsort((tag, doc))
                    doc, tag, pos, length = doc[order], tag[order], pos[order].astype(np.int64), length[order].astype(np.int64)
                    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
                    marked = {(int(doc[a]), int(tag[a])): (pos[a:b], length[a:b]) for a, b in zip(edge, [*edge[1:], len(doc)], strict=True)}
                for part in pa.ipc.open_stream(unpack.decompress(blob)):
                    for chunk in textops.split_chunks(part, text):
                        yield rows(chunk, marked)

    return run


def remove_repeats(docs: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text", keep_layout: bool = False) -> DataFrame:
    """Each row with ``n_words``, ``n_removed`` and ``kept_text``.

    Words are runs of bytes other than space and U+0009 to U+000D.  A word goes
    if a window of ``width`` words that covers it also starts in a document
    with a smaller ``key``; windows are judged on the input.  ``kept_text`` is
    the kept words joined by one space, or with ``keep_layout`` the text with
    the removed stretches cut out and all else as it was.

    Null and empty texts have no words; texts shorter than the window keep
    all.  A null key is neither smaller nor larger than any: such rows keep
    all their words and cost no other row any.  Repeated rows and rows of one
    key keep what no smaller key has.  ``key`` must be an integer column, else a
    TypeError says so.  Input columns named as the three results are dropped in
    their favour.  An empty table gives no rows.
    """
    runtime.integer_key(docs, key)
    made = ("n_words", "n_removed", "kept_text")
    columns = [c for c in docs.columns if c not in made]
    docs = docs.select(*[docs[c] for c in columns])
    n = runtime.partitions(docs.sparkSession)
    size = runtime.estimated_bytes(docs, text)
    buckets = groups = max(8 * n, min(1 << 30, size // BUCKET_BYTES))
    place = F.pmod("dest", F.lit(n))
    common = docs.sparkSession.sparkContext.broadcast(_common_parts(docs, text, width, size))
    sent = docs.select(key, text).mapInArrow(textops.lean(_send_windows(key, text, width, buckets, groups, common)), _ROW)
    marks = sent.repartitionById(n, place).sortWithinPartitions("kind", "dest").mapInArrow(textops.lean(_mark_windows(groups)), _ROW)
    texts = docs.mapInArrow(textops.lean(_send_texts(key, groups)), _ROW)
    met = marks.unionByName(texts).repartitionById(n, place).sortWithinPartitions("dest", "kind")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return met.mapInArrow(textops.lean(_apply(columns, key, text, width, keep_layout)), schema)
