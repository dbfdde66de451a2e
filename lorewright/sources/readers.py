"""Sources: folders of materials, web pages, messages, audio samples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions import text as X
from ..schema import CATEGORIES

AUDIO_SUFFIXES = ("wav", "mp3", "m4a", "flac", "ogg")


def materials(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """Text files below ``folder``/source: path, source, name, size, compiled, text.

    A source that is asked for is the only folder read.  Sorted, sources ascend
    and the names in each descend.
    """
    at = f"{folder}/{source}" if source else f"{folder}/*"
    rows = spark.read.option("pathGlobFilter", "*.md").text(at, wholetext=True)
    path = F.col("_metadata.file_path")
    out = rows.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("source"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    return out.withColumn("compiled", F.coalesce(X.compiled_flag(F.col("text")), F.lit(False))).orderBy(F.asc("source"), F.desc("name"))


def numbered(listing: DataFrame) -> DataFrame:
    """A listing with ``n``, each row's place in its source, in the order of ``materials``."""
    from pyspark.sql import Window as W

    ranked = listing.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("name"))).cast("long"))
    return ranked.orderBy("source", "n")


def uncompiled(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("compiled") & ~F.col("name").startswith("."))


def read_materials(rows: DataFrame) -> DataFrame:
    """Listed materials with ``meta`` (fields of a header in YAML, none of a bad one), ``body`` and ``id``; a missing source is the folder's name."""
    met = rows.withColumn("meta", parsers.full_header(F.col("text"))).withColumn("body", F.regexp_replace("text", r"\A---\s*\n[\s\S]*?\n---[^\n]*\n?", ""))
    field = lambda name: X.nonempty(F.try_element_at("meta", F.lit(name)))
    return met.withColumn("source", F.coalesce(field("source"), "source")).withColumn("id", F.coalesce(field("id"), X.content_id(X.strip(F.col("body")))))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """(``name``, ``raw``) of all pages below a folder, at any depth; names are paths below it."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    return rows.select(F.regexp_extract("_metadata.file_path", f"/{re.escape(root)}/(.*)$", 1).alias("name"), F.col("value").alias("raw"))


def settled(rows: DataFrame, now: float, still: float = 0.5) -> DataFrame:
    """Files (``modified``, a timestamp) that have not changed for so many seconds."""
    return rows.where(F.unix_micros("modified") / 1e6 <= F.lit(now - still))


def transcribed(spark: SparkSession, folder: str, transcribe, done: DataFrame | None = None) -> DataFrame:
    """(``path``, ``text``, ``error``) of audio files that are not among ``done`` (``path``); a failure is a row's error.

    ``transcribe(path) -> str`` is plugged in, such as ``functions.service.transcriber``.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(AUDIO_SUFFIXES) + "}").load(folder).select("path")
    todo = found if done is None else found.join(done.select("path"), "path", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"].tolist():
                try:
                    rows.append((path, transcribe(path.removeprefix("file:")).strip(), None))
                except Exception as failure:  # noqa: BLE001  a plugged-in program may fail in any way
                    rows.append((path, None, str(failure)))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("path", "text", "error"))})

    return todo.mapInPandas(run, "path string, text string, error string")


def watched_dirs(*lists: list[str]) -> list[str]:
    """All folders of the lists once, in order; blank ones left out."""
    return list(dict.fromkeys(d.strip() for dirs in lists for d in dirs if d.strip()))


def decoded_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("md", "markdown", "txt")) -> DataFrame:
    """(path, text) of files in UTF-8, GBK or Latin-1."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": b["content"].map(lambda x: parsers.decode(bytes(x)))})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return rows.select("path", "content").mapInPandas(decode, "path string, text string")


def watched_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of new text files; each path is taken once."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{md,markdown,txt}").option("maxFilesPerTrigger", per_trigger).load(folder).where(X.strip(F.col("value")) != "")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the five category folders, in category order, then by name."""
    rows = spark.read.option("pathGlobFilter", "*.md").text([f"{folder}/{c}" for c in CATEGORIES], wholetext=True)
    category = F.element_at(F.split("_metadata.file_path", "/"), -2)
    out = rows.select(category.alias("category"), F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("slug"), F.col("value").alias("raw"))
    return out.orderBy(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), "slug")


class _Text(HTMLParser):
    """Text of a page's main part, without scripts, styles and navigation."""

    SKIP = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form"}
    BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "tr", "table", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.main, self.in_title = 0, 0, False
        self.title, self.all, self.inner = [], [], []

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title" or self.in_title
        self.skip += tag in self.SKIP
        self.main += tag in ("article", "main")
        if tag in self.BLOCK:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BLOCK:
            self.handle_data("\n")
        self.main = max(0, self.main - (tag in ("article", "main")))

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.all.append(data)
            if self.main:
                self.inner.append(data)


def page_text(html: str) -> tuple[str, str]:
    """Title and main text; blanks and blank lines are collapsed."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    body = "".join(parser.inner) if "".join(parser.inner).strip() else "".join(parser.all)
    body = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v]+", " ", body)).strip()
    return " ".join("".join(parser.title).split()), body


def page_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, title, text, error) of pages; bad addresses and empty pages say so."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few pages are Python objects at once, as each can be long.
        for batch in batches:
            for n in range(0, len(batch), parsers.SLICE):
                part = batch.slice(n, parsers.SLICE)
                rows = []
                for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    address = (url or "").strip().strip("`").strip()
                    title, body = page_text(html or "")
                    error = "address" if not re.match(r"https?://", address) else "script page" if not body and "<script" in (html or "") else "empty" if not body else None
                    rows.append((address, title, body, error))
                texts = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), *texts], names=[key, "url", "title", "text", "error"])

    return pages.select(key, "url", "html").mapInArrow(extract, f"{key} long, url string, title string, text string, error string")


def messages(events: DataFrame, content: str = "content") -> DataFrame:
    """Chat events with ``text`` of their content, the first of each message_id."""
    return events.dropDuplicates(["message_id"]).withColumn("text", X.message_text(F.col(content)))


def segments(frames: DataFrame, frame: str, per_segment: int) -> DataFrame:
    """Frames with ``segment``: so many frames each, the last one shorter."""
    return frames.withColumn("segment", F.floor(F.col(frame) / F.lit(per_segment)).cast("long"))


def is_silent(samples: Column, least: int = 100) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("int")))), F.lit(0)) < least


def mixed(a: Column, b: Column, top: int = 32767) -> Column:
    """Two sample arrays added and clipped; the shorter is silent at its end."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(-top), F.least(F.lit(top), F.coalesce(x.cast("int"), F.lit(0)) + F.coalesce(y.cast("int"), F.lit(0)))))


def resampled(samples: Column, n: int) -> Column:
    """``n`` samples at even places, linear between neighbours."""
    size = F.size(samples)

    def at(i):
        x = i.cast("double") * (size - 1) / F.lit(max(1, n - 1))
        k = F.floor(x).cast("int")
        lo, hi = F.element_at(samples, k + 1), F.element_at(samples, F.least(k + 2, size))
        return (lo + (hi - lo) * (x - k)).cast("double")

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).otherwise(F.array().cast("array<double>"))


def duration_seconds(frames: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.round(frames / rate, 1))
