from __future__ import annotations

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from lorewright.engine import Engine
from lorewright.functions import chunking, pages, parsers, service
from lorewright.operators import graph, links, procedures, retrieval, state
from lorewright.plans.procedure_queries import _next_digest
from lorewright.sources import readers
from lorewright.streaming import jobs


def test_digests_go_on_from_checkpoints(spark):
    texts = {"a": "\n\n".join(f"Sentence {i} of some length here." * 20 for i in range(12)), "b": "", "c": "short", "d": None}
    rows = spark.createDataFrame(list(texts.items()), "source_path string, content string")
    out = collections.defaultdict(list)
    for r in procedures.fold_digests(rows, _next_digest).orderBy("source_path", "index").collect():
        out[r["source_path"]].append(r["digest"])
    for name, text in texts.items():
        digest, want = "", []
        for c in chunking.chunks(text or "", 1200, 100):
            digest = _next_digest(digest, c["main"])
            want.append(digest)
        assert out[name] == want
    assert len(out["a"]) > 3
    done = procedures.fold_digests(rows, _next_digest).where("index <= 2")
    later = procedures.fold_digests(rows, _next_digest, checkpoints=done).where("source_path = 'a'").orderBy("index").collect()
    assert [r["index"] for r in later] == list(range(3, len(out["a"]) + 1)) and later[-1]["digest"] == out["a"][-1]
    other = procedures.fold_digests(rows, _next_digest, target=1500, checkpoints=done).where("source_path = 'a'").orderBy("index").first()
    assert other["index"] == 1


def test_long_materials_are_read_in_chunks(spark):
    long = "\n\n".join(f"Part {i}. " * 300 for i in range(30))
    seen = []

    def generate(text):
        return f"---FILE: knowledge/concepts/x.md---\n---\ntype: concept\n---\n{len(text)}\n---END FILE---"

    rows = spark.createDataFrame([("l", long), ("s", "short")], "source_path string, content string")
    none = spark.createDataFrame([], "path string, slug string, title string, category string")
    cache = spark.createDataFrame([], "source_path string, hash string, files_written array<string>")
    out = procedures.compile_materials(rows, none, cache, "2030-01-02", generate, step=_next_digest, max_ctx=16000)
    got = {r["source_path"]: pages.header_and_body(r["content"])[1] for r in out.entries.collect()}
    assert got == {"l": "32", "s": "5"} and seen == []
    assert sorted(r["path"] for r in out.entries.collect()) == ["knowledge/concepts/x-2.md", "knowledge/concepts/x.md"]


def test_engine_from_materials_to_answers(spark, tmp_path):
    def model(text: str) -> str:
        if "propose" in text:
            return '{"links": [{"term": "boats", "target": "boats"}]}'
        name = text.split()[0].lower()
        return f"---FILE: knowledge/concepts/{name}.md---\n---\ntype: concept\ntitle: {name}\ntags: [{name}]\n---\n{text}\n---END FILE---\n---REVIEW: duplicate | {name}---\nwhy\n---END REVIEW---"

    engine = Engine(spark, str(tmp_path), model)
    engine.ingest(spark.createDataFrame([("web", 1, "boats on the river"), ("file", 2, "rivers with boats, propose"), ("file", 3, "ships on the sea")], "source string, seq long, content string"))
    engine.import_bytes("x.txt", "café".encode("latin-1"), 4)
    engine.compile("2030-01-02")
    paths = sorted(r["path"] for r in engine.entries().collect())
    assert paths == ["knowledge/concepts/boats.md", "knowledge/concepts/café.md", "knowledge/concepts/ships.md"]
    assert engine.compile("2030-01-02").entries.count() == 0 and engine.entries().count() == 3
    page = engine.read(paths[0]).first()["content"]
    assert pages.read_array(page, "sources") and pages.front_matter(page)[0]["title"] == "boats"
    assert engine.resolve(spark.createDataFrame([("duplicate::boats", "seen"), ("none", "x")], "id string, note string").orderBy("id")).where("hit").count() == 1
    assert {r["id"]: r["status"] for r in engine.reviews().collect()} == {"duplicate::boats": "resolved", "duplicate::ships": "open", "duplicate::café": "open"}
    engine.enqueue(spark.createDataFrame([("m1", 1, "enqueue"), ("m1", 2, "take"), ("m2", 3, "enqueue")], "source_path string, seq long, event string"))
    status = engine.manager_status().first()
    assert (status["processing"], status["pending"], status["uncompiled"], status["open_reviews"]) == (1, 1, 1, 2)
    engine.save(spark.createDataFrame([("knowledge/concepts/lake.md", "---\ntype: concept\n---\nsee boats, propose"), ("knowledge/concepts/port.md", "---\ntags: [p]\n---\n[[ships|big]]")], "path string, content string"))
    added = {r["path"]: r["added"] for r in engine.enrich().collect()}
    assert added == {"knowledge/concepts/lake.md": ["boats"]} and "[[boats]]" in engine.read("knowledge/concepts/lake.md").first()["content"]
    groups = spark.createDataFrame([(1, ["boats", "ships"]), (2, ["boats", "lake"])], "seq long, slugs array<string>")
    white = spark.createDataFrame([(["lake", "Boats"],)], "slugs array<string>")
    assert [tuple(r) for r in engine.merge(groups, white).collect()] == [("ships", "boats")]
    assert "[[boats|big]]" in engine.read("knowledge/concepts/port.md").first()["content"] and engine.read("knowledge/concepts/ships.md").count() == 0
    assert pages.read_array(engine.read("knowledge/concepts/boats.md").first()["content"], "tags") == ["boats", "ships"]
    with pytest.raises(Exception, match="no safe path"):
        engine.save(spark.createDataFrame([("../x.md", "y")], "path string, content string"))
    engine.index(engine.entries().select(F.col("path").alias("rel_path"), F.col("content").alias("raw")))
    entities = spark.createDataFrame([("e1", "boats", ["knowledge/concepts/boats.md-chunk-1"]), ("e2", "lake", ["knowledge/concepts/lake.md-chunk-1"])], "id string, label string, sources array<string>")
    edges = spark.createDataFrame([("e1", "e2", "floats_on")], "source string, target string, relation string")
    for mode, first in {"naive": "knowledge", "local": "boats", "global": "boats", "hybrid": "boats", "mix": "boats"}.items():
        hit = engine.ask("boats floats", 2, mode, entities, edges).first()
        assert first in hit["contexts"][0]["file_path"] and hit["mode"] == mode
    with pytest.raises(ValueError):
        engine.search("x", mode="odd")
    engine.trigger("in\\m9", 9)
    assert engine.tasks().where("source_path = 'in/m9' and status = 'pending'").count() == 1
    cafe = engine.read("knowledge/concepts/café.md").select(F.explode(parsers.header_list("sources")(F.col("content"))).alias("id"))
    assert [r["path"] for r in engine.forget(cafe).collect()] == ["knowledge/concepts/café.md"] and engine.read("knowledge/concepts/café.md").count() == 0
    engine.delete(spark.createDataFrame([("knowledge/concepts/lake.md",)], "path string"))
    assert engine.read("knowledge/concepts/lake.md").count() == 0


def test_titles_of_one_character(spark):
    q = spark.createDataFrame([("ab",), ("b",), ("zz",), (None,)], "query string")
    t = spark.createDataFrame([("b",), ("B",), ("xyz b",), ("q",), (None,)], "title string")
    got = {(r["query"], r["title"]): r["score"] for r in links.similar_titles(q, t).collect()}
    assert got == {("ab", "b"): 0.82, ("ab", "B"): 0.82, ("b", "b"): 1.0, ("b", "B"): 1.0, ("b", "xyz b"): 0.82}


def test_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["a"], r["b"]) for r in retrieval.similar_pairs(v, 0.5).collect()] == [(1, 2)]
    assert {(r["query"], r["neighbour"]) for r in retrieval.nearest(v, v, 1).collect()} >= {(1, 2), (2, 1)}


def test_communities_settle(spark):
    pick = random.Random(1)
    edges = [(f"{g}{a}", f"{g}{b}") for g in "abcd" for a in range(12) for b in range(a) if pick.random() < 0.7] + [("a1", "b1"), ("c2", "d2")]
    df = spark.createDataFrame([(a, b) for a, b in edges], "source string, target string")
    nodes = df.select(F.col("source").alias("id")).union(df.select("target")).union(spark.createDataFrame([("lone",)], "id string")).distinct()
    labels = graph.communities(df, nodes)
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert len(got) == 49 and got["lone"] == "lone"
    assert all(len({got[f"{g}{i}"] for i in range(12)}) == 1 for g in "abcd")
    row = graph.modularity(df, labels).first()
    assert row["modularity"] > 0.7 and row["communities"] == 5


def test_task_logs_in_parts(spark):
    """The composed functions give what a fold over the whole log gives, also for one hot key."""
    pick = random.Random(7)
    events = [("hot" if i % 3 else f"k{pick.randrange(9)}", i, pick.choice([*state.EVENTS, "odd", "take", "take", "fail"])) for i in range(3000)]
    want: dict = {}
    for key, _, event in events:
        s, r, n = want.get(key, ("none", 0, 0))
        want[key] = (*state.next_state(s, r, event), n + 1)
    df = spark.createDataFrame(events, "source_path string, seq long, event string").repartition(5)
    for parts in (1, 64):
        assert {r[0]: tuple(r[1:]) for r in state.task_states(df, parts=parts).collect()} == want


def test_late_rows_and_batches_that_come_again(spark, tmp_path):
    """Rows later than the watermark are dropped; a batch is taken once."""
    at = lambda *minutes: spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "event_id long, m int").selectExpr("event_id", "timestampadd(MINUTE, m, timestamp_ntz'2030-01-01 00:00:00') as ts", "1L as user_id", "'click' as event_type", "1.0D as value", "'{}' as props")
    for n, minutes in enumerate(((0, 5, 200), (210, 220), (1, 230, 400))):
        at(*minutes).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = jobs.event_stream(spark, str(tmp_path / "in"), "30 minutes", files_each=1)
    out = jobs.run_to_end(jobs.tumbling(stream, "10 minutes"), "complete")
    assert out.agg(F.sum("n")).first()[0] == 8
    appended = jobs.run_to_end(jobs.tumbling(jobs.event_stream(spark, str(tmp_path / "in"), "30 minutes", files_each=1), "10 minutes"))
    assert sorted((r["start"].hour * 60 + r["start"].minute, r["n"]) for r in appended.where("start < timestamp'2030-01-01 03:00:00'").collect()) == [(0, 2)]
    taken = []
    sink = jobs.once(lambda df, n: taken.append((n, df.count())), str(tmp_path / "done"))
    for n in (0, 0, 1, 0, 1):
        sink(spark.range(3), n)
    assert taken == [(0, 3), (1, 3)]
    contents = jobs.run_to_end(jobs.new_contents(jobs.event_stream(spark, str(tmp_path / "in")).select(F.col("event_type").alias("value"))))
    assert contents.count() == 1


def test_files_and_sources(spark, tmp_path):
    for name, text in {"web/a.md": "---\nsource: file\nid: x1\n---\nbody", "web/b.md": "plain", "concepts/index.md": "i", "concepts/deep/c.md": "# See\nx"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["name"]: (r["source"], r["body"]) for r in readers.read_materials(readers.materials(spark, str(tmp_path), "web")).collect()}
    assert got == {"a.md": ("file", "body"), "b.md": ("web", "plain")}
    rows = procedures.page_rows(readers.tree(spark, str(tmp_path))).collect()
    assert [(r["idx"], r["name"], r["title"]) for r in sorted(rows, key=lambda r: r["idx"])] == [(0, "concepts/deep/c", "See"), (1, "web/a", "a"), (2, "web/b", "b")]
    (tmp_path / "au").mkdir()
    for n in ("one.wav", "two.mp3", "x.txt"):
        (tmp_path / "au" / n).write_bytes(b"1")

    def hear(path):
        if "two" in path:
            raise RuntimeError("deaf")
        return " heard "

    heard = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.transcribed(spark, str(tmp_path / "au"), hear).collect()}
    assert heard == {"one.wav": ("heard", None), "two.mp3": (None, "deaf")}
    assert readers.watched_dirs(["a", " b "], ["b", "", "c"]) == ["a", "b", "c"]
    files = spark.createDataFrame([("a", 100.0), ("b", 99.4)], "path string, t double").withColumn("modified", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert [r["path"] for r in readers.settled(files, 100.0).collect()] == ["b"]


def test_snippets_and_progress(spark):
    assert spark.range(1).select(F.length(retrieval.snippet(F.lit("x" * 900), "list")).alias("n")).first()["n"] == 140
    seen = []
    listener = jobs.Progress(lambda name, batch, rows: seen.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        jobs.run_to_end(spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 7).option("numPartitions", 1).load().limit(7))
        for _ in range(50):
            if seen:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert seen and seen[0][0] == 0


def test_services():
    assert service.endpoint("https://h/v1/") == service.endpoint("https://h/v1/chat/completions") == "https://h/v1/chat/completions"
    assert service.text_of(["a", {"text": "b"}, {"x": 1}]) == "ab" and service.text_of(None) == ""
    assert service.invalid_settings({"base_url": "ftp://x", "url": "", "port": 0, "web_port": 80, "name": 1}) == {"base_url": "no http address", "port": "no port"}
    lines = ['data: {"choices": [{"delta": {"content": "a"}}]}', ": ping", 'data: {"choices": [{"delta": {"content": "b"}}]}', "data: [DONE]", "never"]
    assert service.Provider("https://h", "m", lambda url, body: lines)("q") == "ab"
    with pytest.raises(RuntimeError, match="no"):
        service.Provider("https://h", "m", lambda url, body: ['data: {"error": {"message": "no"}}'])("q")
    assert service.seed("# Title \n\nrest\n") == ("Title", "rest") and service.secret("K", {}) is None
    assert parsers.nfkc("ﬁ") == "fi"
