"""Queries of links, checks, duplicates and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import entities, links, merge
from ..session import table
from .corpora import wiki, wiki_sql
from .registry import query

_KEYS = """, k as (select key, max(idx) as dst from (select slug as key, idx from w union all select string_split(name, '/')[-1], idx from w) group by key),
r as (select l.src, l.pos, l.target, k.dst from l left join k on k.key = l.target)
"""
#: Similarity of SQL texts a and b that are normalised and have no slash.
_SIM = "case when {a} = '' or {b} = '' then 0.0 when {a} = {b} then 1.0 when {fa} = {fb} then 0.96 when contains({a}, {b}) or contains({b}, {a}) then 0.82 when length({fa}) < 5 or length({fb}) < 5 then 0.0 else 1 - levenshtein({fa}, {fb})::double / greatest(length({fa}), length({fb})) end"


def _sim(a: str, b: str) -> str:
    return _SIM.format(a=a, b=b, fa=f"string_split({a}, '/')[-1]", fb=f"string_split({b}, '/')[-1]")


def _pairs(text: str) -> str:
    return f"list_distinct(list_transform(range(1, length({text})), lambda i: substr({text}, i, 2)))"


@query(wiki_sql(_KEYS + "select src, pos, target, dst from r"))
def link_resolution(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    return links.resolve_links(found, pages)


@query(wiki_sql(_KEYS + "select src, pos, target from r where dst is null"))
def broken_links(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    return links.broken_links(found, pages)


@query(wiki_sql(_KEYS + "select idx, slug from w where idx not in (select dst from r where dst is not null)"))
def orphans(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    return links.orphans(found, pages).select("idx", "slug")


@query(wiki_sql("select idx, slug from w where idx not in (select src from l)"))
def no_outlinks(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    return links.without_links(found, pages).select("idx", "slug")


@query(wiki_sql(_KEYS + "select idx, count(dst) as inbound from w left join r on r.dst = w.idx group by idx"))
def inbound_degree(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    return links.inbound_degree(found, pages)


@query(wiki_sql("""select 'slug' as kind, idx, f as first_idx from (select idx, min(idx) over (partition by string_split(name, '/')[-1]) as f from w) where idx > f
union all select 'title', idx, f from (select idx, min(idx) over (partition by lower(title)) as f from w) where idx > f"""))
def duplicate_names(spark, sf_dir):
    return links.duplicate_names(wiki(spark, sf_dir)[0])


@query(wiki_sql(_KEYS + f""", b as (select distinct target from r where dst is null),
bg as (select target, unnest({_pairs('target')}) as g from b),
pn as (select idx, unnest([slug, name, lower(title)]) as n from w), pg as (select idx, unnest({_pairs('n')}) as g from pn),
c as (select target, idx, count(*) as n from bg join pg using (g) group by all),
t as (select *, row_number() over (partition by target order by n desc, idx) as rank from c qualify rank <= 64),
s as (select target, name, rank, greatest({_sim('target', 'slug')}, {_sim('target', 'name')}, {_sim('target', 'lower(title)')}) as score from t join w using (idx))
select target, name as suggestion, round(score, 6) as score from (select *, row_number() over (partition by target order by score desc, rank) as k from s) where k = 1 and score >= 0.74"""))
def broken_link_suggest(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    out = links.suggest_for_broken(links.broken_links(found, pages), pages)
    return out.withColumn("score", F.round("score", 6))


@query(wiki_sql("""select idx, name as suggestion, score from (
with tk as (select distinct idx, unnest(list_filter(regexp_extract_all(lower(title || ' ' || slug), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) as token from w),
cap as (select greatest(20, ceil(count(*) * 0.25)) as most from w), rare as (select token from tk group by token having count(*) <= (select most from cap)),
sz as (select idx, count(*) as n from tk group by idx), p as (select a.idx, b.idx as other, count(*)::double as o from tk a join tk b using (token) where a.idx <> b.idx and token in (select token from rare) group by all),
t as (select *, row_number() over (partition by idx order by o desc, other) as rank from p qualify rank <= 64),
s as (select t.idx, y.name, t.rank, round(t.o / sqrt(a.n * b.n::double) + case when string_split(x.name, '/')[1] = string_split(y.name, '/')[1] then 0.08 else 0 end, 6) as score
  from t join w x on x.idx = t.idx join w y on y.idx = t.other join sz a on a.idx = t.idx join sz b on b.idx = t.other)
select *, row_number() over (partition by idx order by score desc, rank) as k from s) where k = 1 and score >= 0.08"""))
def related_suggest(spark, sf_dir):
    pages, _ = wiki(spark, sf_dir)
    tokens = pages.select("idx", F.explode(X.tokens(F.concat_ws(" ", "title", "slug"))).alias("token")).distinct()
    return links.suggest_related(pages, tokens).withColumn("score", F.round("score", 6))


_MENTIONS = """, m0 as (select src as c, target as label from l union all select idx, own from w), k0 as (select c, label, regexp_replace(regexp_replace(lower(regexp_extract(label, '[^/]*$')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as id from m0),
m as (select c, id, min(label) as label from k0 where id <> '' group by all)"""


@query(wiki_sql(_MENTIONS + """, nl as (select id, label, count(*) as n from m group by all),
e as (select a.id as source, b.id as target, count(*) as weight from m a join m b on a.c = b.c and a.id < b.id group by all),
d as (select id, count(*) as degree, cast(sum(weight) as bigint) as weight from (select source as id, weight from e union all select target, weight from e) group by id)
select x.id, x.label, cast(x.total as bigint) as n, coalesce(degree, 0) as degree, coalesce(weight, 0) as weight
from (select id, label, sum(n) over (partition by id) as total, row_number() over (partition by id order by n desc, label) as r from nl) x left join d using (id) where r = 1"""))
def entity_graph(spark, sf_dir):
    """Entities of the wiki's pages by links and own names, with their edges' number and weight."""
    pages, found = wiki(spark, sf_dir)
    linked = found.groupBy("src").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("[["), F.col("target"), F.lit("]]")))).alias("content"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), F.col("p_partkey").cast("string")).alias("own_name"))
    chunks = pages.select("idx").join(own, "idx").join(linked, F.col("idx") == F.col("src"), "left").select(F.col("idx").cast("string").alias("chunk_id"), F.col("own_name").alias("rel_path"), "content")
    nodes, edges = entities.entity_graph(chunks)
    ends = edges.select(F.col("source").alias("id"), "weight").unionByName(edges.select(F.col("target").alias("id"), "weight")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    return nodes.join(ends, "id", "left").select("id", "label", "n", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


_TITLES = "(select distinct p_name as title from part)"


@query(f"""with q as (select distinct lower(replace(p_name, ' ', '')) as query from part), t as {_TITLES},
s as (select query, title, {_sim('query', 'lower(title)')} as score from q, t)
select query, title, round(score, 6) as score, row_number() over (partition by query order by score desc, title) as rank from s where score >= 0.74 qualify rank <= 64""")
def title_similarity_topk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("query")).distinct()
    return links.similar_titles(queries, part.select(F.col("p_name").alias("title"))).withColumn("score", F.round("score", 6))


@query(f"select a.p_partkey, round({_sim('lower(a.p_name)', 'lower(b.p_name)')}, 6) as score from part a join part b on b.p_partkey = a.p_partkey + 1")
def string_similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", F.round(X.similarity(F.col("p_name"), F.col("other")), 6).alias("score"))


@query("""with part as (select p_partkey, p_size, replace(p_brand, '#', '-') as p_brand from main.part), s as (select case when p_size % 2 = 0 and contains(p_brand, '1') then lower(p_brand) else p_brand end as slug from part where p_size % 5 <> 0 union select 'Solo'),
k as (select lower(slug) as key, min(slug) as slug from s group by 1 having count(distinct slug) = 1),
p as (select p_partkey as seq, 'x/' || upper(p_brand) || '.md#part|alias' as target, lower(p_brand) as key from part union all select 0, 'solo', 'solo')
select seq, target, k.slug as canonical from p join k using (key)""")
def canonical_link_targets(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("-")))
    slugs = part.where("p_size % 5 <> 0").select(F.when((F.col("p_size") % 2 == 0) & F.contains("p_brand", F.lit("1")), F.lower("p_brand")).otherwise(F.col("p_brand")).alias("slug")).union(spark.createDataFrame([("Solo",)], "slug string")).distinct()
    proposals = part.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("x/"), F.upper("p_brand"), F.lit(".md#part|alias")).alias("target"))
    proposals = proposals.unionByName(spark.createDataFrame([(0, "solo")], "seq long, target string"))
    return links.valid_proposals(proposals, slugs)


@query(wiki_sql("""select src, pos, target, min_by(w.name, w.idx) as path from (select src, pos, case when pos = 0 then 'Lessons/' || target || '.MD' else target end as target, case when pos = 0 then 'lessons/' || target else target end as key from l) x
left join w on case when contains(x.key, '/') then w.name = x.key else w.slug = x.key end group by all"""))
def wiki_target_path(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    asked = found.withColumn("target", F.when(F.col("pos") == 0, F.concat(F.lit("Lessons/"), F.col("target"), F.lit(".MD"))).otherwise(F.col("target")))
    return links.wiki_paths(asked, pages)


# --- duplicates and merging


@query("""with d as (select doc_id, source, row_number() over (order by source, doc_id) - 1 as p, count(*) over () as n from documents)
select doc_id, p, batch from (select doc_id, p, n, unnest(range(greatest(0, cast(floor((p - 80) / 72) as bigint) + 1), cast(floor(p / 72) as bigint) + 1)) as batch from d) where n - batch * 72 >= 2""")
def overlap_batches(spark, sf_dir):
    return merge.overlapping_batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "p", "batch")


_SLUGS = "[case when o_orderkey % 2 = 0 then upper(o_orderpriority) else o_orderpriority end, 'c' || o_custkey % 20]"


@query(f"""select group_key, min(o_orderkey) as seq from (select o_orderkey, array_to_string(list_sort(list_transform({_SLUGS}, lambda x: lower(x))), ',') as group_key from orders) group by 1""")
def group_key_unique(spark, sf_dir):
    return merge.first_per_key(_groups(spark, sf_dir)).select("group_key", "seq")


def _groups(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.array(first, F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string"))).alias("slugs"))


@query(f"""with g as (select o_orderkey as seq, array_to_string(list_sort(list_transform({_SLUGS}, lambda x: lower(x))), ',') as group_key from orders)
select seq, group_key from g where group_key not in (select group_key from g where seq < 40)""")
def whitelist_antijoin(spark, sf_dir):
    rows = _groups(spark, sf_dir)
    return merge.not_whitelisted(rows, rows.where("seq < 40").select(F.reverse("slugs").alias("slugs"))).select("seq", "group_key")


@query("""with v as (select c_nationkey as g, c_custkey as o, 1 as pos, case when c_custkey % 2 = 0 then c_mktsegment else lower(c_mktsegment) end as v from customer),
f as (select g, lower(v) as low, min_by(v, o) as v, min(o) as o from v group by all)
select cast(g as bigint) as g, string_agg(v, ',' order by o) as tags from f group by g""")
def ci_array_union(spark, sf_dir):
    tag = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("g"), F.col("c_custkey").alias("o"), F.array(tag).alias("tags"))
    return merge.merged_values(rows, "g", "tags", "o").select("g", F.array_join("tags", ",").alias("tags"))


@query(wiki_sql("""select src, pos, coalesce(d.to_, l.target) as target from l left join (select slug, 'merged-' || min(idx) as to_ from w where idx % 10 = 0 group by slug) d on d.slug = l.target"""))
def redirect_rewrite(spark, sf_dir):
    pages, found = wiki(spark, sf_dir)
    redirects = pages.where("idx % 10 = 0").groupBy("slug").agg(F.concat(F.lit("merged-"), F.min("idx").cast("string")).alias("canonical"))
    return merge.redirect_links(found, redirects).select("src", "pos", "target")


@query("""select o_orderkey, array_to_string(case when o_orderkey % 3 = 0 then ['B', 'x', 'c'] when o_orderkey % 3 = 1 then ['x', 'y'] else ['y'] end, ',') as related from orders""")
def redirect_related(spark, sf_dir):
    given = F.when(F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, ("B", "a", "b", "c")))).when(F.col("o_orderkey") % 3 == 1, F.array(*map(F.lit, ("a", "X", "y")))).otherwise(F.array(*map(F.lit, ("y", "Y"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(merge.redirected(given, {"a": "x"}), ",").alias("related"))


@query("""with n as (select o_orderkey as seq, lower(o_orderpriority) as stem from orders),
r as (select *, row_number() over (partition by stem order by seq) as r from n), free as (select stem, k, row_number() over (partition by stem order by k) as r from (select stem, count(*) + 3 as most from n group by stem), lateral (select unnest(range(1, most + 1)) as k) where k not in (1, 3, 4))
select r.seq, r.stem, r.stem || '-' || k as name from r join free using (stem, r)""")
def conflict_suffix(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lower("o_orderpriority").alias("stem"))
    taken = names.select("stem", F.explode(F.array(F.lit(1), F.lit(3), F.lit(4)).cast("array<long>")).alias("n")).distinct()
    return merge.conflict_names(names, taken)
