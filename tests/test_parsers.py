from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewright.functions import parsers as P
from lorewright.functions import service

PAGE = "---\ntype: lesson\ntitle: \"A: b\"\ntags: [x, \"y, z\"]\nrelated:\n  - one\n  - \"two\"\n---\n# A\n\nbody"


def test_front_matter():
    meta, body = P.front_matter(PAGE)
    assert meta["title"] == "A: b" and meta["tags"] == ["x", "y, z"] and body == "# A\n\nbody"
    assert P.front_matter("no header") == ({}, "no header")
    assert P.front_matter("---\na: [\n---\nx") == ({}, "---\na: [\n---\nx")
    assert P.front_matter("---\n- a\n---\nx")[0] == {}
    assert P.light_front_matter(PAGE)["related"] == ["one", "two"]


def test_arrays():
    assert P.read_array(PAGE, "tags") == ["x", "y, z"]
    assert P.read_array(PAGE, "related") == ["one", "two"]
    assert P.read_array(PAGE, "sources") == []
    assert P.inline_items(r'"a\"b", c, ""') == ['a"b', "c"]
    new = P.write_array(PAGE, "related", ["q"])
    assert P.read_array(new, "related") == ["q"] and P.read_array(new, "tags") == ["x", "y, z"] and new.endswith("body")
    assert P.read_array(P.write_array(PAGE, "sources", ["s"]), "sources") == ["s"]
    assert P.write_array("plain", "tags", ["a"]) == "plain"
    assert P.read_array(P.fold_arrays(PAGE, PAGE.replace("[x,", "[X, w,")), "tags") == ["X", "w", "y, z"]
    assert P.write_scalar(PAGE, "type", "query").count("type: query") == 1
    assert P.write_scalar(PAGE, "tags", "q") == PAGE


def test_sanitize():
    assert P.sanitize("```markdown\n---\ntitle: a\n---\nb\n```\n") == "---\ntitle: a\n---\nb"
    assert P.sanitize("frontmatter:\n---\ntitle: a\n---\nb") == "---\ntitle: a\n---\nb"
    assert P.sanitize("title: a\n---\nb") == "---\ntitle: a\n---\nb"
    assert P.sanitize("---\nrelated: [[a]], [[b]]\n---\nx") == '---\nrelated: ["[[a]]", "[[b]]"]\n---\nx'
    assert P.sanitize("```\n---\nt: a\n---\n```\nbody ```x```") == "---\nt: a\n---\nbody ```x```"
    assert P.sanitize("text\n```\ncode\n```\nmore") == "text\n```\ncode\n```\nmore"


def test_file_blocks():
    text = "x\r\n---FILE: knowledge/a\\b.md---\r\n```\r\n---END FILE---\r\n````\r\nin\r\n---END FILE---\r\n---FILE: knowledge/../c.md---\nq\n---END FILE---\n---FILE: knowledge/d.md---\nopen"
    found = P.file_blocks(text)
    assert found["blocks"] == [{"path": "knowledge/a/b.md", "content": "```\n---END FILE---\n````\nin"}]
    assert found["truncated"] == ["knowledge/d.md"] and len(found["warnings"]) == 2
    assert P.file_blocks("") == {"blocks": [], "warnings": [], "truncated": []}
    for path, ok in {"knowledge/a.md": True, "knowledge/COM1.md": False, "/knowledge/a": False, "knowledge/a/..": False, "knowledge/a. ": False, "other/a.md": False, "C:/knowledge/a": False}.items():
        assert P.safe_path(path) is ok, path


def test_review_blocks():
    text = "---REVIEW: Duplicate | Two pages---\nwhy\nOPTIONS: Merge | Keep\nPAGES: a, b\nSEARCH: q | r\n---END REVIEW---\n---REVIEW: odd | t---\n---END REVIEW---"
    a, b = P.review_blocks(text)
    assert a == {"type": "duplicate", "title": "Two pages", "detail": "why", "options": ["Merge", "Keep"], "pages": ["a", "b"], "search": ["q", "r"]}
    assert b["type"] == "confirm" and b["options"] == ["Approve", "Skip"]


def test_json_answers():
    assert P.first_object('say {"a": "}", "b": {"c": 1}} end') == '{"a": "}", "b": {"c": 1}}'
    assert P.first_object("none") is None and P.first_object("{open") is None
    assert P.duplicate_groups('ok {"groups": [{"slugs": ["a", "b"], "confidence": "high"}, {"slugs": ["c"]}, 3]}') == [{"slugs": ["a", "b"], "reason": "", "confidence": "high"}]
    assert P.duplicate_groups("{bad") == []
    assert P.proposed_links('{"links": [{"term": "t", "target": "x"}, {"term": "t"}]}') == [{"term": "t", "target": "x"}]


def test_stream_lines(spark):
    lines = {
        'data: {"choices": [{"delta": {"content": [{"text": "a"}, {"text": "b"}]}}]}': ("ab", False, "", None, None),
        ' data:{"choices": [{"delta": {"content": "[x] "}, "finish_reason": "stop"}], "usage": {"total_tokens": 7}}': ("[x] ", False, "", "stop", 7),
        "data: [DONE]": ("", True, "", None, None),
        'data: {"error": {"message": "m"}}': ("", False, "m", None, None),
        'data: {"error": "e", "choices": [{"delta": {"content": "no"}}]}': ("", False, "e", None, None),
        "junk": ("", False, "", None, None), "data: {bad": ("", False, "", None, None), "data: 3": ("", False, "", None, None), 'data: {"choices": []}': ("", False, "", None, None),
    }
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", P.stream_line_of(F.col("t")).alias("s")).collect()
    assert {r["t"]: tuple(r["s"]) for r in got} == lines


def test_provider_reads_a_stream():
    said = ["", ": ping", 'data: {"choices": [{"delta": {"content": "a"}}]}', "data: {bad", 'data: {"choices": [{"delta": {"content": [{"text": "b"}]}}]}', 'data: {"choices": [{"delta": {}}]}', "data: [DONE]", 'data: {"error": "after"}']
    assert service.Provider("http://x", "m", lambda url, body: said)("q") == "ab"
    for line, why in (('data: {"error": {"message": "429"}}', "429"), ('data: {"error": "quota"}', "quota")):
        with pytest.raises(RuntimeError, match=why):
            service.Provider("http://x", "m", lambda url, body, line=line: [line])("q")


def test_long_blocks():
    """What is left of a sentence that is cut by length stands alone."""
    assert [len(x) for x in P.split_long("x" * 250 + ". aa. bb.", 100)] == [100, 100, 51, 7]
    assert P.split_long("aa. " + "x" * 150 + ". bb. cc.", 100) == ["aa.", " ".join(["", "x" * 99]).strip(), "x" * 51 + ".", "bb. cc."]
    assert P.split_long("short", 100) == ["short"]


def test_inline_items():
    cases = {"a, b": ["a", "b"], "'a, b', c": ["a, b", "c"], r'"a \"q\", "x, c': ['a "q", x', "c"], '"open, a': ["open, a"], ", ,": [], "it's, b": ["its, b"], '"a\\': ["a"], '""': [], 'a"b,c"d, e': ["ab,cd", "e"]}
    assert {body: P.inline_items(body) for body in cases} == cases


def test_links():
    assert P.rewrite_target("[[Knowledge/A.md|x]] [[b]]", "a", "c") == "[[c|x]] [[b]]"
    assert P.append_link("t", "a") == "t\n\n## Related\n- [[a]]\n"
    assert P.append_link("t\n## related\n- [[b]]", "a") == "t\n## related\n- [[a]]\n- [[b]]"
    assert P.append_link("see [[A]]", "a") == "see [[A]]"
    assert P.linkify("[[x|term]] term Term", [("term", "x"), ("Term", "X"), ("none", "y")]) == ("[[x|term]] [[x|term]] Term", ["x"])
    assert P.linkify("an idea", [("idea", "Idea")]) == ("an [[idea]]", ["Idea"])
    assert P.markdown_links("`[[a]]` [[a b|c]] ```\n[[d]]\n```") == "`[[a]]` [c](#a%20b) ```\n[[d]]\n```"
    assert P.unwrap_link("[[a|b]]") == ("a", "b") and P.unwrap_link("a") == ("a", "a")


def test_decode():
    assert P.decode("é".encode()) == "é" and P.decode("中文".encode("gbk")) == "中文" and P.decode(b"\xff\xfe\xff") == "\xff\xfe\xff"


@given(st.text(alphabet="ab .#\n。", max_size=4000))
def test_chunks_cover_text(text):
    made = P.chunks(text, 1000, 50)
    letters = lambda t: "".join(t.split())
    assert letters("".join(c["main"] for c in made)) == letters(text) or "#" in text
    assert [c["index"] for c in made] == list(range(1, len(made) + 1))
    assert all(len(c["overlap_before"]) <= 50 for c in made)


def test_heading_paths():
    made = P.semantic_blocks("# A\n\none\n\n## B\n\ntwo\n\n# C\n\nthree", 1000)
    assert [h for h, _ in made] == ["A", "A", "A > B", "A > B", "C", "C"]
