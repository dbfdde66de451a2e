"""Queries of the parsers of marked-up text.

Each builds texts from the rows of a table, so that the equivalent can say what
must come out without parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers
from ..functions import text as X
from ..session import table
from ..sources import readers
from .registry import query

_NL = "chr(10)"


def _parts(spark, sf_dir, text: str):
    """(p_partkey, t): a text made by SQL of every part."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(text).alias("t"))


_LINKED = "'see [[' || p_name || '|alias]] and [[ Knowledge/' || p_brand || '.md ]] or [[' || chr(10) || ']'"


@query("select p_partkey, p_name || ',Knowledge/' || p_brand || '.md' as links from part")
def wikilinks_extract(spark, sf_dir):
    return _parts(spark, sf_dir, _LINKED).select("p_partkey", F.array_join(X.wikilinks(F.col("t")), ",").alias("links"))


@query("""select p_partkey, 'see [[' || case when p_name = 'red ring' then 'new/place' else p_name end || '|alias]] and [[ Knowledge/' || p_brand || '.md ]] or [[' || chr(10) || ']' as t from part""")
def wikilink_rewrite(spark, sf_dir):
    """Links to one page point to another, aliases and all else stay."""
    return _parts(spark, sf_dir, _LINKED).select("p_partkey", parsers.rewritten("Knowledge/RED ring.md", "new/place")(F.col("t")).alias("t"))


_RELATED = "case when p_partkey % 3 = 0 then 'x [[Red Ring]]' when p_partkey % 3 = 1 then 'x' || chr(10) || '## related' || chr(10) || '- [[' || p_brand || ']]' else p_name || '  ' end"


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'x [[Red Ring]]' when p_partkey % 3 = 1 then 'x' || chr(10) || '## related' || chr(10) || '- [[red ring]]' || chr(10) || '- [[' || p_brand || ']]'
else p_name || chr(10) || chr(10) || '## Related' || chr(10) || '- [[red ring]]' || chr(10) end as t from part""")
def wikilink_append(spark, sf_dir):
    return _parts(spark, sf_dir, _RELATED).select("p_partkey", parsers.appended("knowledge/red ring.md")(F.col("t")).alias("t"))


@query("""select p_partkey, '---' || chr(10) || 'title: red ring' || chr(10) || '---' || chr(10) || '[[red ring]] x ' || case when contains(p_name, 'red') then replace(p_name, 'red', '[[colour|red]]') else p_name end || ' red' as t,
case when contains(p_name, 'red') then 'colour' else 'colour' end as done from part where contains(p_name, 'red')
union all select p_partkey, '---' || chr(10) || 'title: red ring' || chr(10) || '---' || chr(10) || '[[red ring]] x ' || p_name || ' [[colour|red]]', 'colour' from part where not contains(p_name, 'red')""")
def linkify_terms(spark, sf_dir):
    """The first free mention of a term becomes a link; header and links stay."""
    rows = _parts(spark, sf_dir, "'---' || chr(10) || 'title: red ring' || chr(10) || '---' || chr(10) || '[[red ring]] x ' || p_name || ' red'")
    out = parsers.linkified([("red", "colour"), ("ring]", "none"), ("red", "Colour")])(F.col("t"))
    return rows.select("p_partkey", out["text"].alias("t"), F.array_join(out["done"], ",").alias("done"))


@query("""select p_partkey, '`[[' || p_name || ']]` [' || p_brand || '](#' || replace(p_name, ' ', '%20') || ') [' || p_type || '](#' || p_type || ')' as t from part""")
def markdown_link_texts(spark, sf_dir):
    return _parts(spark, sf_dir, "'`[[' || p_name || ']]` [[' || p_name || '|' || p_brand || ']] [[' || p_type || ']]'").select("p_partkey", parsers.as_markdown(F.col("t")).alias("t"))


_DIRTY = """case p_partkey % 5 when 0 then '```markdown' || chr(10) || '---' || chr(10) || 'title: ' || p_name || chr(10) || '---' || chr(10) || 'b' || chr(10) || '```' || chr(10)
when 1 then 'frontmatter:' || chr(10) || '---' || chr(10) || 'title: ' || p_name || chr(10) || '---' || chr(10) || 'b'
when 2 then 'title: ' || p_name || chr(10) || '---' || chr(10) || 'b'
when 3 then '---' || chr(10) || 'title: ' || p_name || chr(10) || 'related: [[a]], [[b c]]' || chr(10) || '---' || chr(10) || 'b'
else p_name || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' end"""


@query("""select p_partkey, case when p_partkey % 5 < 3 then '---' || chr(10) || 'title: ' || p_name || chr(10) || '---' || chr(10) || 'b'
when p_partkey % 5 = 3 then '---' || chr(10) || 'title: ' || p_name || chr(10) || 'related: ["[[a]]", "[[b c]]"]' || chr(10) || '---' || chr(10) || 'b'
else p_name || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' end as t from part""")
def sanitize_pages(spark, sf_dir):
    return _parts(spark, sf_dir, _DIRTY).select("p_partkey", parsers.sanitized(F.col("t")).alias("t"))


_FILES = """'x' || chr(10) || '---FILE: knowledge/a\\\\b' || p_partkey || '.md---' || chr(10) || p_name || chr(10) || '```' || chr(10) || '---END FILE---' || chr(10) || '```' || chr(10) || '---END FILE---' || chr(10)
|| case when p_partkey % 2 = 0 then '---FILE: knowledge/../c.md---' || chr(10) || 'q' || chr(10) || '---END FILE---' || chr(10) else '' end
|| case when p_partkey % 3 = 0 then '---FILE: knowledge/d' || p_partkey || '.md---' || chr(10) || 'open' else '' end"""


@query("""select p_partkey, 'knowledge/a/b' || p_partkey || '.md' as path, p_name || chr(10) || '```' || chr(10) || '---END FILE---' || chr(10) || '```' as content, cast(1 as bigint) as n,
case when p_partkey % 3 = 0 then 'knowledge/d' || p_partkey || '.md' else '' end as truncated, case when p_partkey % 2 = 0 then 1 else 0 end + cast(case when p_partkey % 3 = 0 then 1 else 0 end as bigint) as warnings from part""")
def file_block_texts(spark, sf_dir):
    """Blocks, truncated paths and the number of warnings of each answer."""
    found = _parts(spark, sf_dir, _FILES).select("p_partkey", parsers.answer_blocks(F.col("t")).alias("a"))
    first = F.get("a.blocks", 0)
    return found.select("p_partkey", first["path"].alias("path"), first["content"].alias("content"), F.size("a.blocks").cast("long").alias("n"), F.array_join("a.truncated", ",").alias("truncated"), F.size("a.warnings").cast("long").alias("warnings"))


_REVIEW = """'---REVIEW: ' || case when p_partkey % 2 = 0 then 'Duplicate' else 'odd' end || ' | ' || p_name || '---' || chr(10) || 'why' || chr(10) || 'OPTIONS: Merge | Keep' || chr(10) || 'PAGES: a, ' || p_brand || chr(10) || '---END REVIEW---' || chr(10) || '---REVIEW: gone | x---' || chr(10)"""


@query("select p_partkey, case when p_partkey % 2 = 0 then 'duplicate' else 'confirm' end as type, p_name as title, 'why' as detail, 'Merge,Keep' as options, 'a,' || p_brand as pages, '' as search from part")
def review_block_texts(spark, sf_dir):
    found = _parts(spark, sf_dir, _REVIEW).select("p_partkey", F.explode(parsers.review_blocks_of(F.col("t"))).alias("r"))
    return found.select("p_partkey", "r.type", "r.title", "r.detail", *(F.array_join(f"r.{c}", ",").alias(c) for c in ("options", "pages", "search")))


_PAGE = "'---' || chr(10) || 'type: lesson' || chr(10) || 'tags: [' || p_brand || ', \"y, z\"]' || chr(10) || 'related:' || chr(10) || '  - ' || p_name || chr(10) || '  - \"two\"' || chr(10) || '---' || chr(10) || 'body'"


@query("""select p_partkey, p_brand || ';y, z' as tags, p_name || ';two' as related, '' as sources, 'lesson' as type,
'---' || chr(10) || 'type: lesson' || chr(10) || 'tags: [' || p_brand || ', "y, z"]' || chr(10) || 'related: ["q"]' || chr(10) || '---' || chr(10) || 'body' as written,
'---' || chr(10) || 'type: query' || chr(10) || 'tags: [' || p_brand || ', "y, z"]' || chr(10) || 'related:' || chr(10) || '  - ' || p_name || chr(10) || '  - "two"' || chr(10) || '---' || chr(10) || 'body' as typed from part""")
def header_fields(spark, sf_dir):
    """Header lists read and written, a plain field set, the header as YAML."""
    rows = _parts(spark, sf_dir, _PAGE)
    lists = [F.array_join(parsers.header_list(c)(F.col("t")), ";").alias(c) for c in ("tags", "related", "sources")]
    kind = F.try_element_at(parsers.header_map(F.col("t")), F.lit("type"))
    return rows.select("p_partkey", *lists, kind.alias("type"), parsers.with_list("related", ["q"])(F.col("t")).alias("written"), parsers.with_scalar("type", "query")(F.col("t")).alias("typed"))


@query("""select p_partkey, '---' || chr(10) || 'tags: ["' || upper(p_brand) || '", "old", "New"]' || chr(10) || 'type: a' || chr(10) || '---' || chr(10) || 'b' as t from part""")
def header_fold(spark, sf_dir):
    """The old page's lists go before the new one's, case apart once."""
    old = _parts(spark, sf_dir, "'---' || chr(10) || 'tags: [' || upper(p_brand) || ', old]' || chr(10) || '---' || chr(10) || 'x'").withColumnRenamed("t", "o")
    new = _parts(spark, sf_dir, "'---' || chr(10) || 'tags: [New, ' || p_brand || ']' || chr(10) || 'type: a' || chr(10) || '---' || chr(10) || 'b'")
    return old.join(new, "p_partkey").select("p_partkey", parsers.folded(F.col("t"), F.col("o")).alias("t"))


_ANSWER = """'say {"a": "}' || p_name || '", "groups": [{"slugs": ["' || p_brand || '", "b"], "confidence": "' || case when p_partkey % 2 = 0 then 'high' else 'odd' end || '"}, {"slugs": ["c"]}], "links": [{"term": "' || p_type || '", "target": "x"}, {"term": "t"}]} end {"b": 1}'"""


@query(f"select p_partkey, substr({_ANSWER}, 5, length({_ANSWER}) - 17) as object, p_brand || '+b' as slugs, case when p_partkey % 2 = 0 then 'high' else 'low' end as confidence, p_type || '>x' as links from part")
def answer_objects(spark, sf_dir):
    """The first object of an answer, its groups and its links."""
    rows = _parts(spark, sf_dir, _ANSWER)
    group, link = F.get(parsers.groups_of(F.col("t")), 0), F.get(parsers.links_of(F.col("t")), 0)
    return rows.select("p_partkey", parsers.object_of(F.col("t")).alias("object"), F.array_join(group["slugs"], "+").alias("slugs"), group["confidence"].alias("confidence"), F.concat(link["term"], F.lit(">"), link["target"]).alias("links"))


_STREAM = """case p_partkey % 4 when 0 then 'data: {"choices": [{"delta": {"content": "' || p_name || '"}, "finish_reason": "stop"}], "usage": {"total_tokens": ' || p_size || '}}' when 1 then 'data: [DONE]' when 2 then 'data: {"error": {"message": "' || p_brand || '"}}' else ': ping' end"""


@query("select p_partkey, case when p_partkey % 4 = 0 then p_name else '' end as delta, p_partkey % 4 = 1 as done, case when p_partkey % 4 = 2 then p_brand else '' end as error, case when p_partkey % 4 = 0 then 'stop' end as finish, case when p_partkey % 4 = 0 then cast(p_size as bigint) end as tokens from part")
def stream_line_texts(spark, sf_dir):
    return _parts(spark, sf_dir, _STREAM).select("p_partkey", parsers.stream_line_of(F.col("t")).alias("s")).select("p_partkey", "s.delta", "s.done", "s.error", "s.finish", "s.tokens")


@query("""select p_partkey, case when p_partkey % 2 = 0 then cast(40 as bigint) when p_partkey % 3 = 0 then 4 else 1 end as n, case when p_partkey % 2 = 0 then repeat('x', 24) || '. ' || p_name || '.' when p_partkey % 3 = 0 then repeat('y', 44) else p_name end as first,
cast(case when p_partkey % 2 = 0 then 40 * (length(p_name) + 28) - 40 when p_partkey % 3 = 0 then 101 + length(p_name) + 4 else length(p_name) end as bigint) as letters from part""")
def split_sentences(spark, sf_dir):
    """Long blocks by sentences: two to a piece here; a longer sentence by length, its rest alone."""
    rows = _parts(spark, sf_dir, "case when p_partkey % 2 <> 0 and p_partkey % 3 = 0 then repeat('y', 100) || '. ' || p_name || '. z.' when p_partkey % 2 = 0 then repeat(repeat('x', 24) || '. ' || p_name || '. ', 40) else p_name end")
    pieces = parsers.pieces_of(44)(F.col("t"))
    return rows.select("p_partkey", F.size(pieces).cast("long").alias("n"), F.get(pieces, 0).alias("first"), F.aggregate(pieces, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("letters"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_name || ' é' else p_name || ' é' end as t from part")
def decoded_bytes(spark, sf_dir):
    """Bytes in UTF-8, or else in Latin-1."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" é")).alias("t"), F.encode(F.concat("p_name", F.lit(" ")), "UTF-8").alias("b"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.encode("t", "UTF-8")).otherwise(F.concat("b", F.unhex(F.lit("E9"))))
    return rows.select("p_partkey", parsers.decoded(raw).alias("t"))


@query("select p_partkey, p_partkey % 3 = 0 as compiled, p_partkey % 4 < 2 as safe, '---' || chr(10) || 'id: ' || p_brand || chr(10) || 'compiled: true' || chr(10) || '---' || chr(10) || 'compiled: false' as marked from part")
def material_headers(spark, sf_dir):
    """Flag of the header alone, the header marked, and safe paths of materials."""
    flag = "'---' || chr(10) || 'id: ' || p_brand || chr(10) || 'compiled: ' || case when p_partkey % 3 = 0 then 'True ' else 'no' end || chr(10) || '---' || chr(10) || 'compiled: false'"
    path = "case p_partkey % 4 when 0 then 'web/a' || p_partkey || '.md' when 1 then 'a.md' when 2 then '../a.md' else 'web/a.txt' end"
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(flag).alias("t"), F.expr(path).alias("path"))
    return rows.select("p_partkey", X.compiled_flag(F.col("t")).alias("compiled"), X.safe_relative(F.col("path")).alias("safe"), X.marked_compiled(F.col("t")).alias("marked"))


_MATERIAL = """case p_partkey % 3 when 0 then '---' || chr(10) || 'id: m' || p_partkey || chr(10) || 'source: web' || chr(10) || 'title: >-' || chr(10) || '  ' || p_name || chr(10) || '  on two lines' || chr(10) || 'tags:' || chr(10) || '- a' || chr(10) || '- "b: c"' || chr(10) || 'more: {x: 01, y: [z]}' || chr(10) || '---' || chr(10) || p_brand
when 1 then '---' || chr(10) || 'id: [' || chr(10) || '---' || chr(10) || p_name || ' ' || p_partkey else p_name || ' ' || p_partkey end"""


@query("""select p_partkey, case p_partkey % 3 when 0 then 'web' else 'file' end as source, case p_partkey % 3 when 0 then 'm' || p_partkey else left(sha1(p_name || ' ' || p_partkey), 12) end as id,
case p_partkey % 3 when 0 then p_name || ' on two lines' end as title, case p_partkey % 3 when 0 then 'a,b: c' end as tags, case p_partkey % 3 when 0 then '{"x": "01", "y": ["z"]}' end as more,
case p_partkey % 3 when 0 then p_brand else p_name || ' ' || p_partkey end as body from part""")
def material_read(spark, sf_dir):
    """Materials read: fields of headers in full YAML, none of bad ones, bodies and ids."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("file").alias("source"), F.expr(_MATERIAL).alias("text"))
    field = lambda name: F.try_element_at("meta", F.lit(name)).alias(name)
    return readers.read_materials(rows).select("p_partkey", "source", "id", field("title"), field("tags"), field("more"), "body")


@query("""select p_partkey, p_name || 'fi12' as folded, 'link ' || lower(replace(p_brand, '#', '-')) as key from part""")
def compatible_forms(spark, sf_dir):
    """Wide and joined letters count as plain ones in keys."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("ﬁ１２")).alias("a"), F.concat(F.lit("x/Ｌｉｎｋ "), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".md|alias")).alias("b"))
    return rows.select("p_partkey", parsers.nfkc_of(F.col("a")).alias("folded"), X.link_key(F.col("b")).alias("key"))

