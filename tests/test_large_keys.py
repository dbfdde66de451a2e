"""Queries at keys and texts that the small tables do not have, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from lorewright.operators import procedures
from lorewright.plans import catalog


@pytest.fixture
def parts(spark, tmp_path):
    keys = "select cast(id as bigint) as p_partkey, 'large ring' as p_name, concat('Brand#', id % 3) as p_brand from {r}"
    few = spark.range(0, 40).unionByName(spark.range(349_520, 349_540)).unionByName(spark.range(999_990, 1_000_020))
    spark.sql(keys, r=few).write.parquet(f"{tmp_path}/part.parquet")
    return tmp_path


def same(spark, name, folder, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_entries_of_a_million_parts(spark, parts):
    same(spark, "entry_by_slug", parts, "part")


def test_entry_map_is_by_category_and_name(spark):
    rows = spark.createDataFrame([("a", "knowledge/queries/a.md"), ("a", "knowledge/concepts/z.md"), ("b", "knowledge/lessons/b.md"), ("b", "knowledge/lessons/c.md")], "slug string, path string")
    assert {tuple(r) for r in procedures.entry_map(rows).collect()} == {("a", "knowledge/queries/a.md"), ("b", "knowledge/lessons/c.md")}


def test_sizes_beyond_a_megabyte(spark, parts):
    same(spark, "layout_tiers", parts, "part")


def test_stub_pages_of_odd_texts(spark, tmp_path):
    """Quotes, backslashes, other white space, marks, fences and reserved names at the start of a text."""
    odd = ["it's \"both\" a", "back\\slash \\n", "a\xa0b c", "全角　x", "a\x1fb", "a\x85b", "a b c", "\x00nul a", "a\x0bb\x0cc d", "　", "​z", "con", "COM1"]
    odd += ["---END FILE---\nmore", "~~~\n---END FILE---\nq", "```\nx", "'\"'", "﻿bom", "\U0001f600 x", "", " \n", "a: b # c", "[x] y", "plain words"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, "compile_stub", tmp_path, "documents")
