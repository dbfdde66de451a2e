"""WARC archives with a two-level capture index.

Archives are files of separately compressed WARC/1.1 records.  A record with a
payload that another one holds is a ``revisit``: it names the record it repeats
and has no payload.

The index has a line per record, sorted by reversed-host URL key.  Lines are
compressed in blocks; each index file ends with a sparse directory (the first
key, place and length of each block) and belongs to one range of keys, listed
in a manifest.  A look-up searches the manifest, then the file's directory, then
one block, and reads the record's bytes only.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, runtime, textops

BLOCK_LINES = 1000
FILE_BYTES = 32 << 20
MAGIC = b"LWCDXIX1"
_FOOTER = struct.Struct("<QQ8s")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host parts from the last to the first, then port, path and query.

    The scheme, a leading ``www.`` and the fragment are left out and letters of
    the host are lower-cased.  What has no host is its own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A compressed record.  A revisit keeps the payload's length in its HTTP part."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """Headers, payload (null for a revisit) and its length of a compressed record."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(said["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    revisit = said["WARC-Type"] == "revisit"
    sha1 = said["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"payload of {said['WARC-Record-ID']} differs from its digest")
    of = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = of(said["WARC-Refers-To"]) if revisit else None
    return {"page_id": of(said["WARC-Record-ID"]), "url": said["WARC-Target-URI"], "record_type": said["WARC-Type"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": sha1, "refers_to": refers}


_CAPTURE = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("sha1", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_SQL = "url_key string, page_id long, record_type string, sha1 string, file string, offset long, length long"


def _write_records(folder: str, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, at, n = None, None, 0, 0
        for chunk in (c for batch in batches for c in textops.split_chunks(batch, "html")):
            out: list[list] = [[] for _ in _CAPTURE]
            for page_id, url, html, latest in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
                if sink is None:
                    uri = f"{folder}/archive-{files.attempt_name()}-{n:04d}.warc.gz"
                    system, path = files.opened(uri)
                    sink, at, n = system.open_output_stream(path, compression=None), 0, n + 1
                payload = (html or "").encode()
                sha1 = digest(payload)
                revisit = latest is not None and page_id != latest and len(payload) >= min_bytes
                data = record_bytes(page_id, url, payload, sha1, latest, revisit)
                sink.write(data)
                for x, v in zip(out, (url_key(url), page_id, "revisit" if revisit else "response", sha1, uri, at, len(data)), strict=True):
                    x.append(v)
                at += len(data)
                if at > FILE_BYTES:
                    sink.close()
                    sink = None
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _CAPTURE, strict=True)], schema=_CAPTURE)
        if sink is not None:
            sink.close()

    return run


def index_block(lines: list[list]) -> bytes:
    return zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode(), 6)


def _footer(at: int, length: int) -> bytes:
    return _FOOTER.pack(at, length, MAGIC)


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, directory, lines, at, count, last = None, [], [], 0, 0, None
        uri = f"{folder}/index-{files.attempt_name()}.cdx"

        def close_block():
            nonlocal lines, at
            data = index_block(lines)
            sink.write(data)
            directory.append([lines[0][0], at, len(data), len(lines)])
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    system, path = files.opened(uri)
                    sink = system.open_output_stream(path, compression=None)
                lines.append(list(row))
                last, count = row[0], count + 1
                if len(lines) == BLOCK_LINES:
                    close_block()
        if sink is None:
            return
        if lines:
            close_block()
        data = zlib.compress(json.dumps(directory).encode())
        sink.write(data + _footer(at, len(data)))
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (uri, directory[0][0], last, count)], names=["file", "first_key", "last_key", "captures"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record per row below ``folder`` (a URI); the index's manifest.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the
    largest key is the response and others revisit it.  The manifest, one row
    per index file, has ``file``, ``first_key``, ``last_key``, ``captures``.

    Payloads are equal if their SHA-256 is.  Digests are grouped with keys alone,
    so one that a third of all rows share is pre-aggregated; payloads move once,
    to meet those of several rows, in a join whose large partitions Spark splits.
    A null payload is empty, a null URL has the empty key.  A row with a null
    key revisits the largest key of its payload; if all are null, all are
    responses, as are repeated rows of the largest key.  Files are named by the
    attempt that wrote them and count only if the index lists them.  ``key`` must
    be an integer column, else a TypeError says so.  Other columns are not
    looked at.
    """
    runtime.integer_key(pages, key)
    spark = pages.sparkSession
    n = runtime.partitions(spark)
    files.make_dir(folder)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    latest = rows.groupBy("sha256").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1 and latest is not null").select("sha256", "latest")
    met = rows.join(runtime.cut(latest), "sha256", "left").select("page_id", "url", "html", "latest")
    captures = runtime.cut(met, textops.lean(_write_records(folder, min_bytes)), _CAPTURE_SQL)
    ordered = captures.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return runtime.cut(ordered, _write_index(folder), "file string, first_key string, last_key string, captures long")


def _directory(uri: str) -> list[list]:
    system, path = files.opened(uri)
    size = system.get_file_info(path).size
    at, n, magic = _FOOTER.unpack(files.read_range(uri, size - _FOOTER.size, _FOOTER.size))
    if magic != MAGIC:
        raise ValueError(f"{uri} is no index file")
    return json.loads(zlib.decompress(files.read_range(uri, at, n)))


def _block(uri: str, entry: list) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(files.read_range(uri, entry[1], entry[2])).split(b"\n")]


def _blocks_of(directory: list[list], key: str) -> range:
    """The blocks, by binary search, that can have lines of a key."""
    # Equal keys may begin in the block before the one that they open.
    first = max(0, bisect_left(directory, key, key=lambda x: x[0]) - 1)
    return range(first, bisect_right(directory, key, key=lambda x: x[0]))


class Lookup:
    """Finds captures of a URL with range reads only, from the driver."""

    def __init__(self, manifest: DataFrame):
        # One row per index file, as many as there were partitions.
        self.index = sorted((r["first_key"], r["last_key"], r["file"]) for r in manifest.collect())

    def captures(self, url: str) -> list[list]:
        key, out = url_key(url), []
        for at in _files_of([x[0] for x in self.index], [x[1] for x in self.index], key):
            directory = _directory(self.index[at][2])
            for k in _blocks_of(directory, key):
                out += [x for x in _block(self.index[at][2], directory[k]) if x[0] == key]
        return out

    def records(self, url: str) -> list[dict]:
        return [parse_record(files.read_range(x[4], x[5], x[6])) for x in self.captures(url)]


def _files_of(firsts: list[str], lasts: list[str], key: str) -> range:
    """The index files, by binary search, that can have lines of a key."""
    end = bisect_right(firsts, key)
    return range(bisect_left(lasts, key, 0, end), end)


_PLACES = pa.schema([("url_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def find_captures(urls: DataFrame, manifest: DataFrame, url: str = "url") -> DataFrame:
    """(``url_key``, ``file``, ``offset``, ``length``) of each capture of any of the URLs, once.

    The manifest's keys, two for each index file, go to the tasks, which search
    them for the files of a key; keys are dealt by file and sorted.  There the
    file's sparse directory is searched for the key's blocks, and only those are
    read, each once.  A null URL asks for captures without one; one that no
    index has gives no row; repeated ones count once.
    """
    listed = sorted((r["first_key"], r["last_key"], r["file"]) for r in manifest.collect())
    sent = urls.sparkSession.sparkContext.broadcast(listed)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [x[0] for x in sent.value], [x[1] for x in sent.value]
        for batch in batches:
            asked = [(at, key) for key in {url_key(u) for u in batch.column(0).to_pylist()} for at in _files_of(firsts, lasts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in asked], pa.int32()), pa.array([k for _, k in asked], pa.string())], names=["at", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, uri, directory, held, lines, before = None, None, [], None, {}, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for at, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, key) == before:
                    continue
                before = (at, key)
                if at != opened:
                    opened, uri, held = at, sent.value[at][2], None
                    directory = _directory(uri)
                for k in _blocks_of(directory, key):
                    if k != held:
                        held, lines = k, {}
                        for x in _block(uri, directory[k]):
                            lines.setdefault(x[0], []).append(x)
                    for x in lines.get(key, ()):
                        for to, v in zip(out, (key, x[4], x[5], x[6]), strict=True):
                            to.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PLACES, strict=True)], schema=_PLACES)

    asked = urls.select(F.col(url).alias("url")).distinct().mapInArrow(textops.lean(route), "at int, key string")
    return asked.repartitionById(max(1, len(listed)), "at").sortWithinPartitions("at", "key").mapInArrow(textops.lean(search), "url_key string, file string, offset long, length long")


_READ_SQL = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_READ_AT_ONCE = 4 << 20


def _list_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            for entry in _directory(uri):
                lines = _block(uri, entry)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(r[4], r[5], r[6]) for r in lines], strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])


def _read_records(with_payload: bool):
    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] if with_payload or f.name != "payload" else None for r in found], f.type) for f in _READ], schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            k = 0
            while k < len(places):
                # Records that follow one another are read together.
                uri, first, _ = places[k]
                j, end = k, first
                while j < len(places) and places[j][0] == uri and places[j][1] == end and (j == k or end + places[j][2] - first <= _READ_AT_ONCE):
                    end += places[j][2]
                    j += 1
                data = files.read_range(uri, first, end - first)
                yield rows([parse_record(data[o - first : o - first + n]) for _, o, n in places[k:j]])
                k = j

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record that the index lists, read by ranges and checked.

    Gives ``page_id``, ``url``, ``record_type``, ``payload`` (null for revisits),
    ``payload_bytes`` and ``payload_digest`` of the full payload, ``refers_to``.
    """
    n = runtime.partitions(spark)
    return read_records(manifest.select("file").repartition(n).mapInArrow(_list_captures, "file string, offset long, length long"), with_payload)


def read_captures(urls: DataFrame, manifest: DataFrame, url: str = "url", with_payload: bool = True) -> DataFrame:
    """As ``read_archives``, the records of the URLs' captures, found through the index."""
    return read_records(find_captures(urls, manifest, url), with_payload)


def read_records(places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at (``file``, ``offset``, ``length``)."""
    part = F.floor(F.col("offset") / F.lit(_READ_AT_ONCE))
    dealt = places.select("file", "offset", "length").repartition(runtime.partitions(places.sparkSession), "file", part).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(textops.lean(_read_records(with_payload)), _READ_SQL)
