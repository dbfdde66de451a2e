"""Jobs over growing input, on copies; runs again; command lines."""

from __future__ import annotations

import hashlib
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import index_documents, ingest_materials
from lorewright.functions.windows import token_windows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
KIND = "doc_id long, text string, source string"


def add(spark, folder, rows) -> None:
    """One more file of documents."""
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- materials from a stream


def ingest(spark, at, **options):
    ingest_materials.run(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", options)
    return {(r["doc_id"], r["fate"], r["of"], r["batch"], r["content"]) for r in ingest_materials.output(spark, f"{at}/out").collect()}


FIRST = [(5, " # Head\nalpha beta ", "src1"), (2, "alpha", "src1"), (9, "alpha\n", "src2"), (4, None, "src1"), (6, " \n", "src3"), (7, "gamma", "other"), (8, "delta", None), (None, "no key", "src1"), (2, "alpha", "src1")]
SECOND = [(1, "alpha", "src1"), (11, "new", "src1"), (10, "new ", "src4"), (2, "alpha", "src1"), (12, "gamma", "src5")]
FIRST_FATES = {
    (5, "accepted", None, 0, "# Head\nalpha beta"), (2, "accepted", None, 0, "alpha"), (9, "duplicate", 2, 0, None), (4, "empty", None, 0, None), (6, "empty", None, 0, None),
    (7, "unknown source", None, 0, None), (8, "unknown source", None, 0, None), (None, "no id", None, 0, None),
}
SECOND_FATES = {(1, "duplicate", 2, 1, None), (10, "accepted", None, 1, "new"), (11, "duplicate", 10, 1, None), (2, "duplicate", 2, 1, None), (12, "accepted", None, 1, "gamma")}


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    at = str(tmp_path)
    add(spark, f"{at}/in", FIRST)
    assert ingest(spark, at) == FIRST_FATES
    assert ingest(spark, at) == FIRST_FATES
    add(spark, f"{at}/in", SECOND)
    assert ingest(spark, at) == FIRST_FATES | SECOND_FATES
    assert ingest(spark, at) == FIRST_FATES | SECOND_FATES
    rows = {r["doc_id"]: r for r in ingest_materials.output(spark, f"{at}/out").where("fate = 'accepted'").collect()}
    assert (rows[5]["title"], rows[5]["hash"], rows[5]["id"]) == ("alpha beta", sha("# Head\nalpha beta"), hashlib.sha1(b"# Head\nalpha beta").hexdigest()[:12])


def test_ingest_gives_the_same_after_a_crash(spark, tmp_path):
    """A batch whose end was not noted is taken again, and is there once."""
    at = str(tmp_path)
    add(spark, f"{at}/in", FIRST)
    ingest(spark, at)
    add(spark, f"{at}/in", SECOND)
    ingest(spark, at)
    for name in ("1", ".1.crc"):
        os.remove(f"{at}/checkpoint/commits/{name}")
    assert ingest(spark, at) == FIRST_FATES | SECOND_FATES


def test_ingest_of_many_files(spark, tmp_path):
    """A batch a file: each content is accepted once, and every row has a fate."""
    at, pick = str(tmp_path), random.Random(1)
    rows = [(n, f"text {pick.randrange(60)}", f"src{n % 4}") for n in range(300)]
    for k in range(0, 300, 100):
        add(spark, f"{at}/in", rows[k : k + 100])
    got = ingest(spark, at, files_each=1)
    assert {b for *_, b, _ in got} == {0, 1, 2} and len(got) == 300
    accepted = {d: c for d, fate, _, _, c in got if fate == "accepted"}
    text = {d: t for d, t, _ in rows}
    assert sorted(accepted.values()) == sorted(set(text.values()))
    assert all(accepted[of] == text[d] for d, fate, of, _, _ in got if fate == "duplicate")


# --- index by buckets


def index(spark, at, docs, **options):
    spark.createDataFrame(docs, KIND).write.mode("overwrite").parquet(f"{at}/in")
    counts = index_documents.run(spark, f"{at}/in", f"{at}/index", options)
    return counts, sorted(tuple(r) for r in index_documents.output(spark, f"{at}/index").drop("bucket").collect())


def expected(docs, size, overlap):
    out = []
    for d, text, _ in docs:
        words = (text or "").split()
        starts = range(0, max(1, len(words) - overlap), size - overlap) if words else ()
        made = [(n, len(words[a : a + size]), " ".join(words[a : a + size])) for n, a in enumerate(starts, 1)]
        out += [(d, sha(text or ""), len(made), *w) for w in made or [(None, None, None)]]
    return sorted(out, key=str)


def files(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{at}/index") for f in fs if f.startswith("part-")}


def test_index_rewrites_only_what_changed(spark, tmp_path):
    at, pick = str(tmp_path), random.Random(2)
    text = lambda: " ".join(f"w{pick.randrange(50)}" for _ in range(pick.randint(0, 40)))
    docs = [(n, text(), "s") for n in range(40)] + [(90, None, "s"), (91, "  \n", "s")]
    said = {"buckets": 8, "size": 10, "overlap": 3}
    counts, rows = index(spark, at, docs, **said)
    assert counts["new"] == 42 and sorted(rows, key=str) == expected(docs, 10, 3)
    before = files(at)
    counts, again = index(spark, at, docs, **said)
    assert counts == {"new": 0, "changed": 0, "gone": 0, "chunks": 0, "buckets": 0} and again == rows and files(at) == before
    # One is new, one changed, one gone.
    docs = [(d, "changed text" if d == 7 else t, s) for d, t, s in docs if d != 11] + [(100, "one more text", "s")]
    counts, rows = index(spark, at, docs, **said)
    assert (counts["new"], counts["changed"], counts["gone"]) == (1, 1, 1) and sorted(rows, key=str) == expected(docs, 10, 3)
    touched = {int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) % 8 for d in (7, 11, 100)}
    assert counts["buckets"] == len(touched)
    kept = {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in touched}
    assert {p: t for p, t in files(at).items() if p in kept} == {p: before[p] for p in kept}


def test_index_of_a_bucket_that_empties(spark, tmp_path):
    at = str(tmp_path)
    index(spark, at, [(1, "a b", "s"), (2, "c", "s")], buckets=4096)
    assert index(spark, at, [(2, "c", "s")], buckets=4096)[1] == [(2, sha("c"), 1, 1, 1, "c")]
    assert index(spark, at, [], buckets=4096)[1] == []
    assert index(spark, at, [(1, "a b", "s"), (None, "x", "s"), (1, "a b", "s")], buckets=4096)[1] == [(1, sha("a b"), 1, 1, 2, "a b")]


def test_index_mends_a_bucket_that_is_missing(spark, tmp_path):
    """As after a run that ended between the removal of a bucket and its new files."""
    at, docs = str(tmp_path), [(n, f"text {n}", "s") for n in range(20)]
    _, rows = index(spark, at, docs, buckets=4)
    gone = f"{at}/index/bucket=2"
    os.rename(gone, f"{at}/away")
    counts, again = index(spark, at, docs, buckets=4)
    assert again == rows and counts["buckets"] == 1 and os.path.isdir(gone)


def test_token_windows(spark):
    texts = [(0, None), (1, ""), (2, " a  b\tc d e "), (3, "漢字 x"), (4, "w " * 95), (5, "one")]
    rows = spark.createDataFrame(texts, "k int, t string").select("k", token_windows(F.col("t"), 4, 1).alias("w")).collect()
    got = {r["k"]: [tuple(w) for w in r["w"]] for r in rows}
    assert got[0] == got[1] == [] and got[5] == [(1, 1, "one")]
    assert got[2] == [(1, 4, "a  b\tc d"), (2, 2, "d e")] and got[3] == [(1, 3, "漢字 x")]
    assert len(got[4]) == 32 and got[4][-1] == (32, 2, "w w")
    with pytest.raises(ValueError):
        token_windows(F.col("t"), 5, 5)


# --- command lines


def test_command_lines(spark, tmp_path):
    at = str(tmp_path)
    add(spark, f"{at}/in", FIRST)
    for name, places in (("ingest_materials", ["--materials", f"{at}/out", "--checkpoint", f"{at}/checkpoint"]), ("index_documents", ["--index", f"{at}/index"])):
        config = f"{at}/{name}.json"
        with open(config, "w", encoding="utf-8") as f, open(f"{ROOT}/jobs/{name}.json", encoding="utf-8") as given:
            json.dump(json.load(given), f)
        done = subprocess.run(
            [sys.executable, "-m", f"jobs.{name}", "--documents", f"{at}/in", *places, "--config", config, "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT}, check=False
        )
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"{at}/in" in done.stderr and "wrote" in done.stderr
    assert {(r["doc_id"], r["fate"], r["of"], r["batch"], r["content"]) for r in ingest_materials.output(spark, f"{at}/out").collect()} == FIRST_FATES
    assert index_documents.output(spark, f"{at}/index").select("doc_id").distinct().count() == 7
