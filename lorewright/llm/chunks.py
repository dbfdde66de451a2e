"""Document fingerprints from content-defined chunks.

A gear hash over the last ``REACH`` bytes marks possible borders; which bits
must be zero depends on whether the chunk is still short of its usual size
(more bits) or past it (fewer), so sizes gather around it.  Borders depend on
nearby bytes only and move with the text.  A fingerprint is the set of the
chunks' digests with their lengths; containment is the share of one's length
whose chunks the other has too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime, textops

LEAST, USUAL, MOST = 8, 32, 128
#: Bytes of a chunk in a fingerprint: digest and length.
ENTRY = 9
REACH = 8
BATCH_BYTES = 1 << 20
_GEAR = (textops.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: The top bits, which all of the last REACH bytes reach.
_STRICT, _LOOSE = (np.uint32(0xFFFFFFFF << (32 - n) & 0xFFFFFFFF) for n in (6, 4))


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte the hash of it and the bytes before, by doubling the reach."""
    h = _GEAR[raw]
    reach = 1
    while reach < REACH:
        # Each byte back weighs a bit more, so the oldest still fills the top.
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def _next(ok: np.ndarray) -> np.ndarray:
    """For each place the first one at or after it that is marked."""
    n = len(ok)
    at = np.where(ok, np.arange(n, dtype=np.int64), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


def chunk_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every chunk of the rows' bytes."""
    h = gear_hashes(raw)
    strict, loose = _next((h & _STRICT) == 0), _next((h & _LOOSE) == 0)
    rows = np.flatnonzero(np.diff(offsets))
    start, stop = offsets[rows], offsets[rows + 1]
    out: list[tuple] = []
    top = len(raw)
    while len(rows):
        # A border after byte i ends the chunk at i + 1.
        first = strict[np.minimum(start + LEAST - 1, top)] + 1
        second = loose[np.minimum(start + USUAL - 1, top)] + 1
        end = np.where(first < start + USUAL, first, second)
        end = np.minimum(np.minimum(end, start + MOST), stop)
        out.append((rows, start, end))
        more = end < stop
        rows, start, stop = rows[more], end[more], stop[more]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Prints:
    """The fingerprints of some texts."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        row, start, end = chunk_ends(raw, offsets)
        digest = textops.span_hashes(raw, start, end)
        order = np.lexsort((digest, row))
        row, digest, size = row[order], digest[order], (end - start)[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
        self.n, self.row, self.digest, self.size = len(texts), row[new], digest[new], size[new]

    def strings(self) -> list[str]:
        """Base64 of, for each chunk in order of digest, digest and length."""
        data = np.zeros((len(self.row), ENTRY), np.uint8)
        data[:, :8] = self.digest.astype(">u8").view(np.uint8).reshape(-1, 8)
        data[:, 8] = self.size
        flat = data.tobytes()
        edge = (ENTRY * np.searchsorted(self.row, np.arange(self.n + 1))).tolist()
        return [base64.b64encode(flat[a:b]).decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def contained(self, other: Prints) -> np.ndarray:
        """For each row its containment in the same row of ``other``."""
        salt = textops.mix(np.arange(1, self.n + 1, dtype=np.uint64))
        there = np.isin(self.digest ^ salt[self.row], other.digest ^ salt[other.row])
        total = np.bincount(self.row, self.size, self.n)
        shared = np.bincount(self.row[there], self.size[there], self.n)
        # An empty text is contained in an empty one only.
        both_empty = np.bincount(other.row, minlength=self.n) == 0
        return np.where(total > 0, shared / np.maximum(total, 1), both_empty.astype(float))


def containment(a: str, b: str) -> float:
    """Of two fingerprint strings: the share of a's length that b has too."""
    x, y = (np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, ENTRY) for s in (a, b))
    if not len(x):
        return float(not len(y))
    there = {r[:8].tobytes() for r in y}
    size = [int(r[8]) for r in x]
    return sum(n for r, n in zip(x, size, strict=True) if r[:8].tobytes() in there) / sum(size)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with ``fingerprint``; equal texts have equal ones, null is as empty."""
    columns = [c for c in docs.columns if c != "fingerprint"]
    docs = runtime.spread(docs.select(*[docs[c] for c in columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.split_chunks(batch, text, BATCH_BYTES):
                raw, offsets = textops.utf8(chunk.column(text))
                data, at = raw.tobytes(), offsets.tolist()
                made = Prints([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]).strings()
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in columns), pa.array(made)], names=[*columns, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


_OUT = "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (part, ghost, id): each row but ghosts, with its next."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        # The last row only serves as the next one of the row before it.
        pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        if not pairs:
            return None
        texts = [r[3] for r in rows]
        edited = []
        for k in pairs:
            part = len(texts[k]) // 4
            edited.append(texts[k][: len(texts[k]) - part] + texts[k + 1][:part])
        own, next_ = Prints([texts[k].encode() for k in pairs]), Prints([texts[k + 1].encode() for k in pairs])
        changed = Prints([x.encode() for x in edited])
        values = (
            pa.array([rows[k][2] for k in pairs], pa.int64()), pa.array([len(texts[k]) for k in pairs], pa.int64()), pa.array(edited), pa.array(own.strings()),
            pa.array(changed.strings()), pa.array(own.contained(changed)), pa.array(own.contained(next_)),
        )
        return pa.RecordBatch.from_arrays(list(values), names=_NAMES)

    for batch in batches:
        for chunk in textops.split_chunks(batch, "text", BATCH_BYTES // 2):
            new = list(zip(*(chunk.column(c).to_pylist() for c in ("part", "ghost", "id", "text")), strict=True))
            held += [(p, g, i, t or "") for p, g, i, t in new]
            if (made := flush(held)) is not None:
                yield made
            held = held[-1:]
    if (made := flush(held)) is not None:
        yield made


def edited_and_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they are.

    The edited text has its last floor(n / 4) code points replaced by the first
    as many, or all, of the next document in ascending ``key``; after the last
    comes the first.  Gives ``key``, ``n_chars``, ``edited_text``,
    ``fingerprint``, ``edited_fingerprint``, and the containment of the text in
    its edited text (``near_edited``) and in the next one (``near_next``).

    Texts move once, to the range of their key, where they are sorted; a copy
    of the first row of each range goes to the end of the range before it.
    Cuts are quantiles of all keys; a key that several quantiles fall on has as
    many ranges, by the hash of the text.  Null and empty texts are empty; rows
    of one key follow one another by the hash of the text, then by text; null
    keys come first.  A single row is its own next one.  ``key`` must be an
    integer column, else a TypeError says so.  Other columns are not looked at.
    """
    runtime.integer_key(docs, key)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at, mixed = F.coalesce("id", F.lit(runtime.LEAST)), F.xxhash64("text")
    n = runtime.partitions(spark)
    cuts = runtime.range_cuts(rows, at, n)
    part = runtime.range_part(F.col("at"), F.col("mixed"), cuts)
    rows = rows.select("id", "text", at.alias("at"), mixed.alias("mixed")).select("id", "text", "at", "mixed", part.alias("part"))
    # A row for each range, and there are as many as shuffle partitions.
    firsts = sorted(map(tuple, rows.groupBy("part").agg(F.min(F.struct("at", "mixed")).alias("m")).select("part", "m.at", "m.mixed").collect()))
    if not firsts:
        return spark.createDataFrame([], _OUT.replace("id long", f"{key} long", 1))
    before = {k: firsts[i - 1][0] for i, (k, _, _) in enumerate(firsts)}
    of = lambda values: F.get(runtime.literal_array(values), F.col("part"))
    by_part = {k: (a, m) for k, a, m in firsts}
    every = range(len(cuts) + 1)
    first = (F.col("at") == of([by_part.get(k, (0, 0))[0] for k in every])) & (F.col("mixed") == of([by_part.get(k, (0, 0))[1] for k in every]))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost"))
    ghost = F.struct(of([before.get(k, 0) for k in every]).cast("int").alias("part"), F.lit(1).alias("ghost"))
    dealt = rows.select(F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("p"), "id", "mixed", "text").select("p.part", "p.ghost", "id", "mixed", "text")
    met = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "ghost", F.asc_nulls_first("id"), "mixed", "text")
    return met.drop("mixed").mapInArrow(textops.lean(_compare), _OUT).withColumnRenamed("id", key)
