"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A chunk of texts is one byte array with offsets.  Words, word hashes and
hashes of word windows come from whole-array operations, so the cost per word
is some tens of nanoseconds and memory is bounded by the chunk, not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


#: What operators keep in a worker between tasks, by operator.
CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    return CACHES.setdefault(name, {})


def lean(fn: Callable, own: str | None = None) -> Callable:
    """``fn`` over Arrow batches, with little left in an idle worker.

    Workers serve one operator after another: what others have cached goes
    before, and freed memory is given back after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget(own)
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return run


def _forget(own: str | None) -> None:
    for name, kept in CACHES.items():
        if name != own:
            kept.clear()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def split_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, a row at least."""
    _, offsets = utf8(batch.column(text))
    row, rows = 0, len(batch)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield batch.slice(row, end - row)
        row = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """Starts and ends of words, and the first word's number of each row.

    ``in_word`` says for each of the 256 byte values whether it is part of a
    word.  A word never crosses from one row into the next.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = in_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = _U(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[int(base)] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, from one polynomial prefix sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_BASE, len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * power[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` word hashes, row edges ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(step, len(words) + 1)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=prefix[1:])
    return mix((prefix[width:] - prefix[:n]) * inverse[:n])


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


NOT_SPACE = ~byte_class(SPACE)
