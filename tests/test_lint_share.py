"""A check of a tree asks for like pages where it shows them, and finds what it found for all."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.functions import text as X
from lorewright.operators import links, procedures


def test_only_lone_and_mute_pages_ask(spark, monkeypatch):
    rows = [(n, f"{w}-{n}", f"c{n % 3}/{w}-{n}", f"{w} {v}", f"[[{'red' if (n + 1) % 2 else 'blue'}-{n + 1}]]" if n % 10 else "") for n in range(40) for w, v in [("blue" if n % 2 == 0 else "red", ("ring", "bolt", "gear")[n % 3])]]
    pages = spark.createDataFrame(rows, "idx long, slug string, name string, title string, body string")
    tokens = pages.select("idx", F.explode(X.tokens(F.concat_ws(" ", "title", "slug"))).alias("token")).distinct()
    every = {r["idx"]: r["suggestion"] for r in links.suggest_related(pages, tokens).collect()}
    asked, held = [], links.top_overlaps
    monkeypatch.setattr(links, "top_overlaps", lambda left, *a, **b: asked.append(left) or held(left, *a, **b))
    got = procedures.lint(pages, tokens).collect()
    mute, lone = {n for n in range(40) if n % 10 == 0}, {0, *(n + 1 for n in range(0, 40, 10))}
    assert {r["id"] for r in asked[-1].select("id").collect()} == mute | lone
    name = {r[0]: r[2] for r in rows}
    for kind, some in (("no-outlinks", mute), ("orphan", lone)):
        assert {(r["file"], r["suggestion"]) for r in got if r["kind"] == kind} == {(name[n], every.get(n)) for n in some}
    assert any(r["suggestion"] for r in got if r["kind"] == "orphan")
