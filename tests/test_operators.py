from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorewright.engine import Config, Engine
from lorewright.functions import text as X
from lorewright.operators import compiling, graph, links, merge, state
from lorewright.sources import readers, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, X.similarity(lit("Knowledge/Alpha.md"), lit("alpha"))) == 1.0
    assert value(spark, X.similarity(lit("x/alpha"), lit("y/alpha"))) == 0.96
    assert value(spark, X.similarity(lit("知识图谱建"), lit("知识图谱造"))) == 0.8
    assert value(spark, X.tokens(lit("知识 a b2_c d"))) == ["知识", "b2", "知", "识"]
    assert value(spark, X.bigrams(lit("a"))) == ["a"] and value(spark, X.bigrams(lit(""))) == []
    assert value(spark, X.matches_language(lit("这是一个足够长的中文样本用来检查语言守卫是否放行"))) is True
    assert value(spark, X.matches_language(lit("plain text without the script asked for"))) is False
    assert value(spark, X.slugify(lit("　Hello, 世界 / x! "))) == "hello-世界-x"
    assert value(spark, X.message_text(lit('{"text": "a"}'))) == "a" and value(spark, X.message_text(lit('{"b": 1}'))) == "" and value(spark, X.message_text(lit("[1]"))) == "[1]"
    assert value(spark, X.review_title(lit(" Missing page:  A  b "))) == "a b"
    assert value(spark, X.marked_compiled(lit("---\nid: a\ncompiled: false\n---\nx"))) == "---\nid: a\ncompiled: true\n---\nx"
    assert value(spark, X.compiled_flag(lit("---\ncompiled: True\n---\ncompiled: false"))) is True


def test_samples(spark):
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    assert value(spark, readers.mixed(ints(30000, 5), ints(9000, -7, 3))) == [32767, -2, 3]
    assert value(spark, readers.is_silent(ints(-99, 5))) is True and value(spark, readers.is_silent(ints(-100))) is False
    assert value(spark, readers.resampled(ints(0, 10), 3)) == [0.0, 5.0, 10.0]


def test_material_sink_and_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, "web", " a "), (2, "web", "a"), (4, "file", " "), (5, "file", "c"), (5, "web", "c")], "seq long, source string, content string")
    folder = str(tmp_path / "m")
    assert sorted(r["seq"] for r in sinks.append_materials(rows, folder).collect()) == [1, 5]
    assert sorted(r["seq"] for r in spark.read.parquet(folder).collect()) == [1, 5]
    assert sinks.append_materials(rows, folder).count() == 0
    assert spark.read.parquet(folder).count() == 2
    with pytest.raises(Exception, match="no source: nope"):
        sinks.append_materials(spark.createDataFrame([(3, "nope", "b")], "seq long, source string, content string"), folder)
    at, schema = str(tmp_path / "s"), "id long"
    assert sinks.read_state(spark, at, schema).count() == 0
    for n in (3, 2, 5):
        sinks.replace_state(sinks.read_state(spark, at, schema).where("id < 0").unionByName(spark.range(n)), at)
        assert sinks.read_state(spark, at, schema).count() == n
    assert len([x for x in (tmp_path / "s").iterdir() if x.name.startswith("v")]) == 2
    (tmp_path / "s" / "v00000009-half").mkdir()
    assert sinks.read_state(spark, at, schema).count() == 5
    index = spark.createDataFrame([("concepts", 1, "a")], "category string, n long, text string")
    assert [sinks.write_index(index, str(tmp_path / "i")), sinks.write_index(index, str(tmp_path / "i")), sinks.write_index(index.withColumn("text", F.lit("b")), str(tmp_path / "i"))] == [True, False, True]
    for _ in range(2):
        sinks.append_lines(spark.createDataFrame([("x",), ("y",), ("x",)], "line string"), str(tmp_path / "l"))
    assert sinks.read_state(spark, str(tmp_path / "l"), "line string").count() == 2


def test_listing_and_decoding(spark, tmp_path):
    for source, name, body in (("web", "a.md", "---\ncompiled: true\n---\nx"), ("web", "b.md", "y"), ("file", "c.md", "z")):
        (tmp_path / "in" / source).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / source / name).write_text(body)
    listed = readers.materials(spark, str(tmp_path / "in"))
    assert [(r["source"], r["name"], r["compiled"]) for r in listed.collect()] == [("file", "c.md", False), ("web", "b.md", False), ("web", "a.md", True)]
    assert readers.uncompiled(listed).count() == 2
    (tmp_path / "in" / "web" / "g.txt").write_bytes("中文".encode("gbk"))
    assert {r["text"] for r in readers.decoded_files(spark, str(tmp_path / "in" / "web"), ("txt",)).collect()} == {"中文"}


def test_page_text():
    html = "<html><head><title>A  b</title><script>x</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two</p></article><footer>f</footer></body></html>"
    assert readers.page_text(html) == ("A b", "Head\nOne & two")


def test_task_states(spark):
    log = [("a", i, e) for i, e in enumerate(["enqueue", "take", "fail", "take", "fail", "take", "fail", "take", "enqueue"])]
    log += [("b", 1, "take"), ("b", 2, "enqueue"), ("b", 3, "cancel"), ("b", 4, "complete")]
    out = {r["source_path"]: (r["status"], r["retry_count"]) for r in state.task_states(spark.createDataFrame(log, "source_path string, seq long, event string")).collect()}
    assert out == {"a": ("pending", 0), "b": ("cancelled", 0)}


def test_components_of_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    nodes = spark.range(402).select("id")
    out = {r["id"]: r["component"] for r in graph.components(edges, nodes).collect()}
    assert out == {**dict.fromkeys(range(401), 0), 401: 401}


def test_communities_partition(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    out = {r["id"]: r["community"] for r in graph.communities(edges, nodes).collect()}
    assert len(out) == 10 and len({out[f"a{i}"] for i in range(1, 5)}) == 1


def test_batches(spark):
    for n in (1, 80, 81, 153, 200):
        rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("title"), F.col("id").alias("slug"))
        got = {}
        for r in merge.overlapping_batches(rows, ["title", "slug"]).collect():
            got.setdefault(r["batch"], []).append(r["slug"])
        want = [list(range(s, min(n, s + 80))) for s in ([0] if n <= 80 else range(0, n, 72))]
        want = [w for w in want if len(w) > 1 or n <= 80]
        assert [sorted(got[k]) for k in sorted(got)] == want, n


def test_compile_and_lint(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "alpha beta gamma"), ("m2", None)], "source_path string, content string")
    out = {r["source_path"]: r for r in compiling.compiled(rows).collect()}
    assert out["m1"]["reject"] is None and out["m1"]["path"].startswith("knowledge/")

    def failing(text):
        raise RuntimeError("no model")

    assert compiling.generated(rows, failing).where("error = 'no model'").count() == 2
    pages = spark.createDataFrame([(0, "a", "concepts/a", "A", "[[b]] [[zzz]]"), (1, "b", "concepts/b", "B", ""), (2, "b", "lessons/b", "b", "[[a]]")], "idx long, slug string, name string, title string, body string")
    found = links.links_of(pages)
    assert [r["dst"] for r in links.resolve_links(found, pages).orderBy("src", "pos").collect()] == [2, None, 0]
    kinds = sorted(r["kind"] for r in Engine(spark, str(tmp_path)).lint(pages).collect())
    assert kinds == ["broken-link", "duplicate-slug", "duplicate-title", "no-outlinks", "orphan"]


def test_engine_index_and_search(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    entries = spark.createDataFrame([("a.md", "solar panels and batteries"), ("b.md", "river boats and locks")], "rel_path string, raw string")
    assert tuple(engine.index(entries).first()) == (2, 2, 0)
    assert tuple(engine.index(entries).first()) == (2, 0, 2)
    assert engine.search("boats on the river", 1).first()["file_path"] == "b.md"
    assert "[1]" in engine.ask("solar", 1).first()["answer"]
    engine.remove(spark.createDataFrame([("a.md",)], "rel_path string"))
    assert tuple(engine.index(entries).first()) == (2, 1, 1)


def test_config():
    c = Config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}})
    c.set("x.y", 5)
    assert (c.get("a.b"), c.get("a.c"), c.get("x.y"), c.get("no", 7)) == (3, 2, 5, 7)
