"""A folder that is watched: files come once, and not while they are written.

``watched`` is the stream; ``register`` makes the format ``settled_files`` known to a
session's ``readStream``.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, size long, modified timestamp, content binary"
#: Files of a task, and what files are taken, if nothing else is said.
FILES_EACH, SUFFIXES, STILL = 64, "md,markdown,txt", 0.5


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class Reader(DataSourceStreamReader):
    """Offsets are the files that have settled, with the size and time that they had.

    A file has settled when two looks in a row find it alike, or when it has not
    changed for ``still`` seconds.  What the offset before has not is given, so a
    file that goes and comes again, or is written again, is given again; the state
    of ``watched`` drops it.
    """

    def __init__(self, options: dict):
        self.folder, self.still = options["path"], float(options.get("still", STILL))
        self.suffixes = tuple(f".{s.strip().lower()}" for s in options.get("suffixes", SUFFIXES).split(","))
        self.seen: dict[str, list[int]] = {}

    def _look(self) -> dict[str, list[int]]:
        system, folder = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.path: [f.size, f.mtime_ns or 0] for f in found if f.type == fs.FileType.File and f.size and f.path.lower().endswith(self.suffixes) and not f.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        now, before = self._look(), self.seen
        self.seen = now
        old = (time.time() - self.still) * 1e9
        return {"files": {p: x for p, x in sorted(now.items()) if before.get(p) == x or x[1] <= old}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [(p, x[0]) for p, x in sorted(end["files"].items()) if p not in start["files"]]
        return [Files(new[i : i + FILES_EACH]) for i in range(0, len(new), FILES_EACH)]

    def read(self, partition: Files) -> Iterator[tuple]:
        from datetime import datetime, timezone

        system, _ = opened(self.folder)
        for path, size in partition.files:
            info = system.get_file_info(path)
            with system.open_input_stream(path) as f:
                yield path, size, datetime.fromtimestamp((info.mtime_ns or 0) / 1e9, timezone.utc), f.read(size)


class SettledFiles(DataSource):
    """Options: ``path``; ``suffixes``, by comma; ``still``, seconds."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def watched(spark: SparkSession, folder: str, suffixes: str = SUFFIXES, still: float = STILL) -> DataFrame:
    """A stream of the files of a folder (``path``, ``size``, ``modified``, ``content``), each path once, whatever becomes of it later.

    Names that begin with a dot or underscore, empty files and folders below are
    left out.  Contents are read by the tasks; the checkpoint's state has the paths.
    """
    register(spark)
    return spark.readStream.format("settled_files").option("path", folder).option("suffixes", suffixes).option("still", str(still)).load().dropDuplicates(["path"])


def register(spark: SparkSession) -> None:
    # The process that plans a source may not find this package, so its code goes along.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SettledFiles)
