"""Versions that two writers make, and buckets that alone are written."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lorewright.engine import Engine
from lorewright.operators import retrieval
from lorewright.sources import sinks

KIND = "id long"


def rows(spark, at):
    return sorted(r["id"] for r in sinks.read_state(spark, at, KIND).collect())


def test_of_two_writers_one_fails(spark, tmp_path):
    """Both read the first version; the second to write does not undo the other's."""
    at = str(tmp_path / "t")
    sinks.replace_state(spark.range(1), at)
    sinks.replace_state(spark.range(2), at, base=1)
    with pytest.raises(sinks.Conflict):
        sinks.replace_state(spark.range(9), at, base=1)
    assert rows(spark, at) == [0, 1]
    sinks.replace_state(spark.range(3), at)
    assert rows(spark, at) == [0, 1, 2]


def test_an_update_is_made_again_after_a_conflict(spark, tmp_path):
    at, seen = str(tmp_path / "t"), []
    sinks.replace_state(spark.range(1), at)

    def change(old):
        seen.append(old.count())
        if len(seen) == 1:
            # Another writer is faster.
            sinks.update_state(spark, at, KIND, lambda o: o.unionByName(spark.range(10, 11)))
        return old.unionByName(spark.range(20, 21))

    sinks.update_state(spark, at, KIND, change)
    assert rows(spark, at) == [0, 10, 20] and seen == [1, 2]
    with pytest.raises(sinks.Conflict):
        sinks.update_state(spark, at, KIND, lambda o: (sinks.replace_state(spark.range(5), at), o)[1], tries=2)


def test_a_version_without_rows_or_name_does_not_count(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace_state(spark.range(2), at)
    open(f"{at}/_current-00000002", "w").close()
    assert rows(spark, at) == [0, 1]
    sinks.update_state(spark, at, KIND, lambda old: old.unionByName(spark.range(7, 8)))
    assert rows(spark, at) == [0, 1, 7]


def files(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.startswith("part-")}


def test_one_changed_page_writes_one_bucket(spark, tmp_path):
    """The index of an engine with an embedding of its own."""
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    engine = Engine(spark, str(tmp_path), embed=embed)
    pages = {f"knowledge/concepts/p{i}.md": f"page {i} says {'x ' * i}" for i in range(40)} | {"knowledge/concepts/empty.md": ""}
    entries = lambda: spark.createDataFrame(list(pages.items()), "rel_path string, raw string")
    assert tuple(engine.index(entries()).first()) == (41, 41, 0)
    before = files(f"{tmp_path}/chunks")
    assert tuple(engine.index(entries()).first()) == (41, 0, 41) and files(f"{tmp_path}/chunks") == before
    pages["knowledge/concepts/p3.md"] = "another text"
    assert tuple(engine.index(entries()).first()) == (41, 1, 40)
    after = files(f"{tmp_path}/chunks")
    changed = {p.split("bucket=")[1].split("/")[0] for p in before if after.get(p) != before[p]}
    assert len(changed) == 1
    assert engine.search("another text", 1).first()["file_path"] == "knowledge/concepts/p3.md"
    engine.remove(spark.createDataFrame([("knowledge/concepts/p3.md",)], "rel_path string"))
    assert engine.search("another text", 100).where("file_path like '%p3.md'").count() == 0
    assert engine._chunks().select("rel_path").distinct().count() == 40
    assert tuple(engine.index(entries(), rebuild=True).first()) == (41, 41, 0)
    assert retrieval.embed is not embed and engine._chunks().where("chunk_id is null").count() == 1
