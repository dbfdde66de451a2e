from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lorewright.llm import registry, runtime, toolcalls, warc


def archive(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/warc", **options)
    return manifest, warc.read_archives(spark, manifest)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://www.h{i % 7}.example.com/p{i % 50}?q={i}", f"<p>{i % 60}é</p>" * (i % 5)) for i in range(200)]
    rows += [(500, None, None), (501, "no host", ""), (502, "http://a.b/x y\n", None), (None, "http://n.b/", "null key"), (None, "http://n.b/", "null key"), (503, "http://n.b/", "null key"), (7, "http://again.b/", "tie"), (7, "http://again.b/", "tie")]
    manifest, out = archive(spark, tmp_path, rows)
    latest: dict = {}
    for i, _, html in rows:
        if i is not None:
            latest[html or ""] = max(i, latest.get(html or "", i))
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = latest.get(html or "")
        revisit = first is not None and first != i
        want.append((i, len(body), warc.digest(body), "revisit" if revisit else "response", first if revisit else None, None if revisit else body))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    urls = spark.createDataFrame([(u,) for _, u, _ in rows] + [("http://gone.example/",), (None,)], "url string").withColumn("at", F.lit("clash"))
    again = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read_captures(urls, manifest).collect()]
    assert sorted(again, key=key) == sorted(want, key=key)
    some = warc.read_captures(urls.where("url like '%h3.%'"), manifest).collect()
    assert sorted(r["page_id"] for r in some) == [i for i in range(200) if i % 7 == 3]
    assert warc.find_captures(urls.limit(0), manifest).count() == 0 and warc.find_captures(urls.where("url like '%gone%'"), manifest).count() == 0
    with pytest.raises(TypeError):
        warc.write_archives(spark.createDataFrame([("a", "b", "c")], "page_id string, url string, html string"), f"file://{tmp_path}/no")
    find = warc.Lookup(manifest)
    assert sorted(r["page_id"] for r in find.records("HTTPS://h3.EXAMPLE.com/p3?q=3#x")) == [3]
    assert len(find.captures("http://again.b/")) == 2 and find.captures("http://gone.example/") == []


def test_least_payload_and_large_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rows = [(i, "http://same.example/", "tiny") for i in range(40)] + [(100 + i, f"http://x{i}.example/", "a longer payload") for i in range(30)]
    manifest, out = archive(spark, tmp_path, rows, min_bytes=10)
    kinds = {r["page_id"]: r["record_type"] for r in out.collect()}
    assert all(kinds[i] == "response" for i in range(40)) and sum(kinds[100 + i] == "revisit" for i in range(30)) == 29
    find = warc.Lookup(manifest)
    assert len(find.captures("http://same.example/")) == 40
    assert all(len(find.captures(f"http://x{i}.example/")) == 1 for i in range(30))
    asked = spark.createDataFrame([("http://same.example/",), ("http://x3.example/",), ("http://same.example/#again",)], "url string")
    assert sorted(r["page_id"] for r in warc.read_captures(asked, manifest).collect()) == [*range(40), 103]


def test_null_keys_and_long_pages(spark, tmp_path):
    """Null keys revisit the largest key of their payload; of null keys alone all are responses."""
    rows = [(None, "http://a/", "shared")] * 20 + [(5, "http://a/", "shared"), (None, "http://b/", "none"), (None, "http://b/", "none"), (6, "http://c/", "x" * 3_000_000)]
    manifest, out = archive(spark, tmp_path, rows)
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(None, "revisit", 5, 6)] * 20 + [(5, "response", None, 6), (None, "response", None, 4), (None, "response", None, 4), (6, "response", None, 3_000_000)], key=str)


def test_empty(spark, tmp_path):
    manifest, out = archive(spark, tmp_path, [])
    assert manifest.count() == 0 and out.count() == 0
    assert warc.find_captures(spark.createDataFrame([("http://a/",)], "url string"), manifest).count() == 0


@pytest.mark.parametrize(("url", "key"), [("http://www.A.b.com/x?y#z", "com,b,a)/x?y"), ("https://a.b:8080", "b,a:8080)/"), (None, ""), ("odd", "odd"), ("http://[bad", "http://[bad")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


CALLS = "conv_id long, call_id string, seq long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, seq long, content string"
TOOLS = {
    "search": {"properties": {"query": "string", "limit": "integer"}, "required": ["limit", "query"]},
    "translate": {"properties": {"text": ["string", "null"], "a.b": "number", "it's": "boolean"}, "required": ["text", "a.b"]},
    "odd": {"properties": {"gone": "null"}, "required": ["x"]},
}


def linked(spark, calls, results, tools=TOOLS):
    return toolcalls.link_calls(spark.createDataFrame(calls, CALLS).withColumn("key", F.lit("clash")).withColumn("level", F.lit(1)), spark.createDataFrame(results, RESULTS).withColumn("n", F.lit(0)), tools).collect()


def test_calls(spark):
    calls = [
        (1, "a", 0, "search", '{"query": "x", "limit": 2}', None), (1, "b", 1, "search", '{"query": 5}', ["a", "gone"]), (1, "c", 2, "run", "{}", ["a", "b", "b"]),
        (1, "d", 3, "translate", "{broken", []), (1, "d", 4, "search", None, []), (1, "e", 5, "translate", '{"text": null, "z": {"b": 1, "a": [2]}}', ["f"]),
        (1, "f", 6, "search", "[]", ["e"]), (1, "g", 7, "search", None, ["f", "a"]), (1, None, 8, "search", "{}", []), (1, None, 8, "search", "{}", ["a"]), (2, "é\"\n", 0, None, "{}", None),
        (3, "a", 0, "run", "{}", ["b"]), (None, "a", 0, "run", "{}", []), (None, "b", 0, "run", "{}", ["a"]),
    ]
    results = [(1, "a", 2, "late"), (1, "a", 1, "first"), (1, "b", 1, None), (1, "zz", 4, "none"), (1, "zz", 3, "none"), (1, None, 1, "x"), (3, "b", 5, "of another"), (None, "a", 9, "of null")]
    rows = linked(spark, calls, results)
    out = {(r["conv_id"], r["call_id"]): r for r in rows if "no id" not in r["errors"] and "no call" not in r["errors"]}
    assert {k: r["level"] for k, r in out.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "e"): None, (1, "f"): None, (1, "g"): None, (2, "é\"\n"): 0, (3, "a"): 0, (None, "a"): 0, (None, "b"): 1}
    assert out[1, "a"]["errors"] == [] and out[1, "a"]["n_results"] == 2
    assert out[1, "a"]["canonical"] == '{"arguments":{"limit":2,"query":"x"},"errors":[],"id":"a","level":0,"name":"search","result":"first"}'
    assert out[1, "b"]["errors"] == ["missing: limit", "not string: query", "unknown need"]
    assert out[1, "c"]["errors"] == ["no result", "unknown tool: run"]
    assert out[1, "d"]["errors"] == ["duplicate id", "no result", "not JSON"]
    assert out[1, "e"]["errors"] == ["cycle", "missing: a.b", "no result"] and '"z":{"a":[2],"b":1}' in out[1, "e"]["canonical"]
    assert out[1, "f"]["errors"] == ["cycle", "no result", "not object"]
    assert out[3, "a"]["n_results"] == 0 and "unknown need" in out[3, "a"]["errors"] and json.loads(out[None, "a"]["canonical"])["result"] == "of null"
    lost = sorted((str(r["conv_id"]), str(r["call_id"]), r["seq"], r["level"], r["name"], r["n_results"], r["errors"]) for r in rows if "no call" in r["errors"])
    assert lost == [("1", "None", 1, None, None, 1, ["no call", "no id"]), ("1", "zz", 3, None, None, 2, ["no call"]), ("3", "b", 5, None, None, 1, ["no call"])]
    nameless = [r for r in rows if "no id" in r["errors"] and "no call" not in r["errors"]]
    assert [(r["conv_id"], r["level"], r["errors"]) for r in nameless] == 2 * [(1, None, ["missing: limit", "missing: query", "no id", "no result"])]
    assert len(rows) == len(out) + 3 + 2
    for r in rows:
        again = json.loads(r["canonical"])
        assert list(again) == sorted(again) and again["id"] == r["call_id"]


def test_identifiers_that_come_again(spark):
    """Two conversations with the same ids are kept apart."""
    calls = [(k, f"call_{i}", i, "run", "{}", [f"call_{i - 1}"] if i else []) for k in range(5) for i in range(3 + k)]
    results = [(k, f"call_{i}", i, f"{k}-{i}") for k in range(5) for i in range(3 + k)]
    rows = linked(spark, calls, results)
    assert sorted((r["conv_id"], r["call_id"], r["level"], json.loads(r["canonical"])["result"]) for r in rows) == sorted((k, f"call_{i}", i, f"{k}-{i}") for k in range(5) for i in range(3 + k))


def test_schema_paths_and_null_type(spark):
    said = {
        1: ('{"text": "x", "a.b": 1}', []), 2: ('{"text": null, "a.b": 1.5, "it\'s": true}', []), 3: ('{"text": "x", "a": {"b": 1}}', ["missing: a.b"]),
        4: ('{"text": 3, "a.b": "1", "it\'s": "no"}', ["not boolean: it's", "not number: a.b", "not string or null: text"]),
    }
    rows = linked(spark, [(k, "a", 0, "translate", t, []) for k, (t, _) in said.items()] + [(9, "a", 0, "odd", '{"gone": 1}', [])], [(k, "a", 0, "r") for k in (*said, 9)])
    got = {r["conv_id"]: r["errors"] for r in rows}
    assert got == {k: e for k, (_, e) in said.items()} | {9: ["missing: x", "not null: gone"]}
    with pytest.raises(ValueError):
        linked(spark, [], [], {"t": {"properties": {"x": "date"}}})


NUMBERS = {
    "1": ["1", "1.0", "1.00", "1e0", "10e-1", "0.1E+1"], "100": ["100", "1e2", "100.000", "1.0E2"], "-0.5": ["-0.5", "-5e-1", "-0.50"], "0": ["0", "-0", "0.0", "0e5", "-0.0"],
    "12345678901234567890": ["12345678901234567890", "12345678901234567890.0"], "0.000001": ["0.000001", "1e-6"], "1e60": ["1e60", "10.0e59"], "25e-70": ["2.5e-69"],
}


def test_numbers_have_one_form(spark):
    forms = [(want, f'{{"b": [{t}, "{t}"], "a": {t}}}', t) for want, many in NUMBERS.items() for t in many]
    df = spark.createDataFrame(forms, "want string, text string, said string")
    for r in df.withColumn("out", toolcalls.canonical_json(F.try_parse_json("text"))).collect():
        assert r["out"] == f'{{"a":{r["want"]},"b":[{r["want"]},"{r["said"]}"]}}', r
    body = 'a \\" \\n1.0 ' * 100_000
    long = spark.createDataFrame([(f'{{"n": 1.50, "t": "{body}"}}',)], "text string")
    assert long.select(toolcalls.canonical_json(F.try_parse_json("text"))).first()[0] == f'{{"n":1.5,"t":"{body}"}}'
    whole = linked(spark, [(i, "a", 0, "search", f'{{"query": "q", "limit": {t}}}', []) for i, t in enumerate(("1.0", "1e2", "1.5", "7"))], [])
    assert {r["conv_id"]: "not integer: limit" in r["errors"] for r in whole} == {0: False, 1: False, 2: True, 3: False}


@pytest.mark.parametrize("several", [97, 5])
def test_long_chain_and_levels(spark, several):
    import random

    pick = random.Random(2)
    n = 300 if several > 90 else 40
    needs = {i: ([i - 1] if i % several else pick.sample(range(i), 3) if i > 3 else []) for i in range(1, n)} | {0: []}
    level: dict[int, int] = {}
    for i in range(n):
        level[i] = max((level[k] + 1 for k in needs[i]), default=0)
    rows = [(1, str(i), i, "run", "{}", [str(k) for k in needs[i]]) for i in range(n)]
    rows += [(1, "x", 0, "run", "{}", ["y", "0"]), (1, "y", 0, "run", "{}", ["x"]), (1, "z", 0, "run", "{}", ["y", "1"])]
    out = toolcalls.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {})
    got = {r["call_id"]: r["level"] for r in out.collect()}
    assert [got.pop(c) for c in "xyz"] == [None] * 3
    assert {int(k): v for k, v in got.items()} == level


def test_needs_that_others_imply(spark):
    """Needs of two and four calls before are a chain; on and after cycles there is no level."""
    rows = [(1, str(i), i, "run", "{}", [str(i - k) for k in (1, 2, 3) if i >= k]) for i in range(200)]
    rows += [(2, "a", 0, "run", "{}", ["b"]), (2, "b", 0, "run", "{}", ["d"]), (2, "d", 0, "run", "{}", ["a"]), (2, "f", 0, "run", "{}", []), (2, "c", 0, "run", "{}", ["a", "b", "d", "f"]), (2, "e", 0, "run", "{}", ["c"])]
    rows += [(3, "x", 0, "run", "{}", ["x", "y"]), (3, "y", 0, "run", "{}", []), (3, "z", 0, "run", "{}", ["y"])]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in toolcalls.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {}).collect()}
    assert {i: got[1, str(i)] for i in range(200)} == {i: i for i in range(200)}
    assert [got[2, c] for c in "abdcef"] == [None] * 5 + [0] and [got[3, c] for c in "xyz"] == [None, 0, 1]


def test_one_long_conversation(spark):
    """All rows of one conversation, all of which need its first call."""
    rows = [(1, f"c{i}", i, "run", "{}", ["c0", f"c{i // 2}"] if i > 1 else [])for i in range(3000)]
    out = toolcalls.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([(1, f"c{i}", i, "r" * 5000 if i == 7 else "r") for i in range(3000)], RESULTS), {})
    got = {int(r["call_id"][1:]): r["level"] for r in out.collect()}
    assert got == {i: 0 if i < 2 else i.bit_length() - 1 if i else 0 for i in range(3000)} | {i: got[i] for i in range(4)} and [got[i] for i in range(4)] == [0, 0, 1, 1]


def test_no_calls(spark):
    assert toolcalls.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), registry.TOOLS).count() == 0
    assert [r["errors"] for r in linked(spark, [], [(1, "a", 0, "x")])] == [["no call"]]


def test_pipeline(spark):
    import corpus_pipeline

    docs = runtime.documents(spark, "/root/testdata/sf0.001")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = runtime.cut(stage(spark, docs, "/root/testdata/sf0.001"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert 0 < docs.count() < before.count()
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
