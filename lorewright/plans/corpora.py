"""Test corpora derived from the given tables by fixed rules.

``WIKI`` is SQL that both engines read; ``{part}`` stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: A page of every part: slugs from names, some repeated; links by arithmetic.
WIKI = """
with p as (select p_partkey as k, p_name as title, lower(replace(p_name, ' ', '-')) || '-' || cast(p_partkey as string) as own from {part}),
pc as (select max(p_partkey) + 1 as n from {part}),
w as (select p.k as idx, coalesce(q.own, p.own) as slug, p.title,
    element_at(array({categories}), cast(p.k % 5 as int) + 1) || '/' || coalesce(q.own, p.own) as name, p.own
  from p left join p q on p.k % 17 = 0 and q.k = p.k - 1)
"""
CATEGORY_SQL = "'decisions', 'lessons', 'concepts', 'connections', 'queries'"
LINKS = """, lk as (select w.idx, (w.idx * 7 + 1) % pc.n as a, (w.idx * 3 + 5) % pc.n as b, (w.idx * 5 + 2) % pc.n as z from w cross join pc where w.idx % 13 <> 0),
l as (
  select lk.idx as src, 0 as pos, t.own as target from lk join w t on t.idx = lk.a
  union all select lk.idx, 1, t.own from lk join w t on t.idx = lk.b
  union all select lk.idx, 2, replace(t.own, 'r', 'rr') || 'x' from lk join w t on t.idx = lk.z where lk.idx % 11 = 0)
"""


def wiki(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (idx, slug, title, name) and links (src, pos, target)."""
    part = table(spark, sf_dir, "part")
    head = WIKI.replace("{categories}", CATEGORY_SQL)
    pages = spark.sql(head + "select idx, slug, title, name from w", part=part)
    found = spark.sql(head + LINKS + "select src, pos, target from l", part=part)
    return pages, found


def wiki_sql(rest: str) -> str:
    """DuckDB SQL over the same corpus: ``w`` has the pages, ``l`` the links."""
    head = WIKI.replace("element_at(array({categories}), cast(p.k % 5 as int) + 1)", f"([{CATEGORY_SQL}])[cast(p.k % 5 as int) + 1]").replace("{part}", "part")
    return head + LINKS + rest
