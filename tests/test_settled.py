"""A watched folder: half-written files wait, and a restart takes nothing twice."""

from __future__ import annotations

import os
import time

from lorewright.sources import settled


def put(folder, name, text, age=0.0):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(path, (time.time() - age,) * 2)


def test_reader_waits_for_files_that_change(tmp_path):
    """By looks alone: what changes between two looks is not given, whatever its name."""
    reader = settled.Reader({"path": str(tmp_path), "still": "3600"})
    put(tmp_path, "a.md", "half")
    put(tmp_path, "old.txt", "done", age=7200)
    put(tmp_path, "c.pdf", "no")
    put(tmp_path, ".hidden.md", "no")
    put(tmp_path, "empty.md", "")
    given = lambda: {os.path.basename(p) for p in reader.latestOffset()["files"]}
    assert given() == {"old.txt"}
    put(tmp_path, "a.md", "half and more")
    assert given() == {"old.txt"}
    assert given() == {"a.md", "old.txt"}
    assert settled.Reader({"path": f"{tmp_path}/none"}).latestOffset() == {"files": {}}


def test_restart_takes_nothing_twice(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)
    put(folder, "a.md", "first", age=60)
    put(folder, "b.md", "second", age=60)

    def run():
        stream = settled.watched(spark, folder, still=30)
        query = stream.selectExpr("regexp_extract(path, '[^/]+$', 0) as name", "decode(content, 'UTF-8') as text").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    assert run() == [("a.md", "first"), ("b.md", "second")]
    assert run() == [("a.md", "first"), ("b.md", "second")]
    # One more, one that changes after it was taken, and one that is new a moment ago.
    put(folder, "c.md", "third", age=60)
    put(folder, "a.md", "changed", age=60)
    assert run() == [("a.md", "first"), ("b.md", "second"), ("c.md", "third")]
    os.remove(f"{folder}/b.md")
    put(folder, "a.md", "changing")
    put(folder, "d.md", "fourth", age=60)
    last = [("a.md", "first"), ("b.md", "second"), ("c.md", "third"), ("d.md", "fourth")]
    assert run() == last
    # What went comes again, and what changed has settled.
    put(folder, "b.md", "again", age=60)
    put(folder, "a.md", "changed again", age=60)
    assert run() == last


def test_engine_watches_a_folder(spark, tmp_path):
    from lorewright.engine import Engine

    folder = str(tmp_path / "in")
    os.mkdir(folder)
    put(folder, "a.md", "first", age=60)
    with open(f"{folder}/b.txt", "wb") as f:
        f.write("café".encode("latin-1"))
    os.utime(f"{folder}/b.txt", (time.time() - 60,) * 2)
    engine = Engine(spark, str(tmp_path / "engine"))
    query = engine.watch("folder", folder, still=30)
    try:
        query.processAllAvailable()
    finally:
        engine.stop()
    assert sorted(r["content"] for r in engine.materials().collect()) == ["café", "first"]
