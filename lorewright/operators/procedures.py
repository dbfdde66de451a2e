"""What a user does with a corpus as a whole: compile, enrich, merge, check.

Each is one plan of columns and joins around calls of a pluggable generator; a
generator's failure is a row's error.  Nothing is written here: results are
tables for ``sources.sinks`` and ``Engine``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import budget, chunking, pages, parsers
from ..functions import text as X
from ..plans.lineage import cut, cut_loop
from ..schema import CATEGORIES
from ..sources import sinks
from . import compiling, links, merge, state

Generate = Callable[[str], str]
# The lists of a page that merging joins.
LISTS = ("sources", "tags", "related")
#: Proposals or pages that a task of ``enrich`` takes, or entries that one of ``compile_materials`` names.
ROWS = 16_384


@dataclass(frozen=True)
class Compiled:
    """What compiling materials gives.

    ``entries``: ``source_path``, ``path``, ``content``; ``rejected``: ``source_path``,
    ``path``, ``reason``; ``reviews``, ``truncated`` paths, ``cache`` rows, ``log``
    lines and the new ``index``.
    """

    entries: DataFrame
    rejected: DataFrame
    reviews: DataFrame
    truncated: DataFrame
    cache: DataFrame
    log: DataFrame
    index: DataFrame


def _stamped(today: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.StringType())
    def stamp(content: pd.Series, source: pd.Series) -> pd.Series:
        out = []
        for text, name in zip(content, source, strict=True):
            if text is not None:
                text = pages.write_scalar(pages.write_scalar(text, "created", today), "updated", today)
                known = [s.strip() for s in pages.read_array(text, "sources") if s.strip()]
                text = pages.write_array(text, "sources", known if name in known else [*known, name])
            out.append(text)
        return pd.Series(out, dtype=object)

    return stamp


def _field(content: Column, name: str) -> Column:
    return F.try_element_at(parsers.header_map(content), F.lit(name))


def compile_materials(materials: DataFrame, existing: DataFrame, cache: DataFrame, today: str, generate: Generate = compiling.stub, repair: Generate | None = None, script: str | None = None, max_ctx: int = 0, step: Callable[[str, str], str] | None = None) -> Compiled:
    """New entries of the materials (``source_path``, ``content``).

    ``existing`` are the pages there are (``path``, ``slug``, ``title``, ``category``),
    ``cache`` the rows (``source_path``, ``hash``, ``files_written``) of what was
    compiled before: a material whose hash and files are still there is left out,
    as is one that is null or blank.  A material beyond the budget of ``max_ctx``
    is read in chunks, each folded into a digest by ``step``; the digest is what
    the generator gets.  Blocks whose end is missing are asked for once more from
    ``repair``; of its answer only those count.

    An entry is cleaned, stamped with the day and its source, and refused if its
    path is unsafe or does not fit its type, if it is the index, or if its body is
    not in ``script``.  One whose name is taken gets the next free number, in the
    order of source, place and path.

    Joins are by merging: names are small as they are shuffled, but not as a
    broadcast side, which passes the driver.  Many entries are named in as many
    tasks as they need.
    """
    body = materials.select("source_path", "content").where(X.nonempty(F.col("content")).isNotNull()).withColumn("hash", X.content_hash(F.col("content")))
    hits = state.cache_hits(body.select("source_path", "hash"), cache, existing.select("path"))
    todo = body.join(hits.hint("merge"), ["source_path", "hash"], "left_anti")
    asked = todo.select("source_path", "content")
    if step is not None:
        room = budget.source_budget(F.lit(max_ctx).cast("long"), F.lit(0))
        folded = fold_digests(asked.where(F.length("content") > room), step).groupBy("source_path").agg(F.max_by("digest", "index").alias("content"))
        asked = asked.where(F.length("content") <= room).unionByName(folded)
    answers = cut(compiling.generated(asked, generate).select("source_path", "error", "output", parsers.answer_blocks("output").alias("a")))
    blocks = answers.select("source_path", F.posexplode("a.blocks").alias("seq", "b")).select("source_path", "seq", "b.path", "b.content")
    truncated = answers.select("source_path", F.explode("a.truncated").alias("path"))
    if repair is not None:
        again = compiling.generated(truncated.select(F.struct("source_path", "path").alias("k"), F.col("path").alias("content"), F.to_json(F.struct("source_path", "path")).alias("source_path")).drop("k"), repair)
        more = again.select(F.from_json("source_path", "source_path string, path string").alias("k"), F.posexplode(parsers.file_blocks_of("output")).alias("seq", "b"))
        found = more.where("b.path = k.path").groupBy("k").agg(F.min_by("b.content", "seq").alias("content")).select("k.source_path", F.lit(1 << 20).alias("seq"), "k.path", "content")
        found = cut(found)
        blocks = blocks.unionByName(found)
        truncated = truncated.join(found.hint("merge"), ["source_path", "path"], "left_anti")
    clean = blocks.withColumn("content", parsers.sanitized(F.col("content")))
    stamped = clean.withColumn("content", _stamped(today)(F.col("content"), F.col("source_path")))
    kind = _field(F.col("content"), "type")
    body_of = F.regexp_replace("content", r"\A---\s*\n[\s\S]*?\n---[^\n]*\n?", "")
    reason = (
        F.when(F.col("path").endswith("/index.md") | (F.col("path") == "knowledge/index.md"), F.lit("index"))
        .when(~X.safe_path(F.col("path")), F.lit("unsafe"))
        .otherwise(X.routing_issue(F.col("path"), kind))
    )
    if script is not None:
        reason = F.coalesce(reason, F.when(~X.matches_language(body_of, script), F.lit("language")))
    judged = cut(stamped.withColumn("reason", reason))
    refused = judged.where("reason is not null").select("source_path", "path", "reason")
    failed = answers.where("error is not null").select("source_path", F.lit(None).cast("string").alias("path"), F.concat(F.lit("error: "), F.col("error")).alias("reason"))
    taken = existing.select(_stem(F.col("path")).alias("stem")).select(F.regexp_replace("stem", r"-(\d+)$", "").alias("stem"), F.coalesce(F.nullif(F.regexp_extract("stem", r"-(\d+)$", 1), F.lit("")).cast("long"), F.lit(1)).alias("n"))
    accepted = judged.where("reason is null").withColumn("key", F.struct("source_path", "seq", "path"))
    tasks = -(-accepted.count() // ROWS)
    dealt = lambda rows, by: rows.repartition(tasks, by) if tasks > 1 else rows
    named = merge.conflict_names(dealt(accepted.select("key", _stem(F.col("path")).alias("stem")), "stem"), taken, key="key").select("key", "name")
    entries = cut(dealt(accepted, "key").join(dealt(named, "key").hint("merge"), "key").select("source_path", F.concat("name", F.lit(".md")).alias("path"), "content"))
    reviews = state.review_of(answers.select("source_path", F.explode(parsers.review_blocks_of("output")).alias("r")).select("source_path", "r.*"), today)
    written = entries.groupBy("source_path").agg(F.array_sort(F.collect_list("path")).alias("files_written"))
    new_cache = todo.select("source_path", "hash").join(written.hint("merge"), "source_path")
    log = entries.select("source_path").distinct().select(F.concat(F.lit(f"## [{today}] ingest | "), F.col("source_path")).alias("line"))
    summary = existing.select("category", "slug", "title").unionByName(summaries(entries).select("category", "slug", "title"))
    return Compiled(entries, refused.unionByName(failed), reviews, truncated, new_cache, log, sinks.index_text(summary))


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def summaries(entries: DataFrame) -> DataFrame:
    """(``path``, ``category``, ``slug``, ``type``, ``title``, ``description``) of pages (``path``, ``content``) with a header."""
    meta = parsers.header_map(F.col("content"))
    met = entries.withColumn("meta", meta).where(F.size("meta") > 0)
    slug = X.base_name(_stem(F.col("path")))
    body = F.regexp_replace("content", r"\A---\s*\n[\s\S]*?\n---[^\n]*\n?", "")
    field = lambda name: X.nonempty(F.try_element_at("meta", F.lit(name)))
    return met.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("category"), slug.alias("slug"), F.coalesce(field("type"), F.lit("unknown")).alias("type"), F.coalesce(field("title"), slug).alias("title"),
        X.truncated(F.coalesce(field("description"), X.first_body_line(body)), 200).alias("description"),
    )


def fold_digests(materials: DataFrame, step: Callable[[str, str], str], target: int = 1200, overlap_chars: int = 100, checkpoints: DataFrame | None = None) -> DataFrame:
    """Long texts read chunk by chunk: (``source_path``, ``hash``, ``target``, ``overlap``, ``total``, ``index``, ``digest``).

    ``step(digest, chunk)`` gives the next digest, from "" on.  Every step is a
    row, so a run that ended early goes on from ``checkpoints``: rows of an earlier
    one, of which those count whose text, sizes and number of chunks are the same.
    A text's chunks follow one another; texts do not wait for each other.
    """
    rows = materials.select("source_path", "content", X.content_hash(F.col("content")).alias("hash"), F.lit(target).alias("target"), F.lit(overlap_chars).alias("overlap"))
    if checkpoints is not None:
        last = checkpoints.groupBy("source_path", "hash", "target", "overlap", "total").agg(F.max(F.struct("index", "digest")).alias("at"))
        rows = rows.join(last.groupBy("source_path", "hash", "target", "overlap").agg(F.max(F.struct("at", "total")).alias("last")), ["source_path", "hash", "target", "overlap"], "left")
        rows = rows.select(*rows.columns[:-1], "last.total", F.col("last.at.index").alias("index"), F.col("last.at.digest").alias("digest"))
    else:
        rows = rows.select("*", F.lit(None).cast("int").alias("total"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("digest"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                made = chunking.chunks(row.content or "", target, overlap_chars)
                resumed = isinstance(row.digest, str) and row.total == len(made)
                at, digest, out = (int(row.index), row.digest, []) if resumed else (0, "", [])
                for chunk in made[at:]:
                    digest = step(digest, chunk["main"])
                    out.append((row.source_path, row.hash, target, overlap_chars, len(made), chunk["index"], digest))
                if resumed and not out:
                    out.append((row.source_path, row.hash, target, overlap_chars, len(made), at, digest))
                yield pd.DataFrame(out, columns=["source_path", "hash", "target", "overlap", "total", "index", "digest"])

    return rows.mapInPandas(fold, "source_path string, hash string, target int, overlap int, total int, index int, digest string")


def enrich(entries: DataFrame, generate: Generate) -> DataFrame:
    """(``path``, ``content``, ``added``) of pages (``path``, ``slug``, ``content``) that get links.

    The generator proposes terms and targets for a page.  A proposal counts if
    its target is a known page other than this one and not linked yet; the first
    free mention of its term becomes the link.  Proposals are written first, so the
    generator is asked once; tasks are as many as proposals or pages need.
    """
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // ROWS))
    asked = compiling.generated(entries.select(F.col("path").alias("source_path"), "content").repartition(tasks, "source_path"), generate)
    said = asked.select(F.col("source_path").alias("path"), F.posexplode(parsers.links_of("output")).alias("pos", "l")).select("path", "pos", F.col("l.term").alias("term"), F.col("l.target").alias("target"))
    said = cut(said)
    tasks = max(tasks, -(-said.count() // ROWS))
    valid = links.valid_proposals(said, entries.select("slug"), tasks)
    per_page = valid.repartition(tasks, "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "canonical"))).alias("todo"))
    met = entries.select("path", "slug", "content").repartition(tasks, "path").join(per_page.hint("merge"), "path").withColumn("have", F.transform(X.wikilinks(F.col("content")), X.normal_target))
    fresh = met.withColumn("todo", F.filter("todo", lambda x: (x["canonical"] != F.col("slug")) & ~F.array_contains("have", F.lower(x["canonical"])))).where(F.size("todo") > 0)

    @F.pandas_udf(parsers.LINKED)
    def link(content: pd.Series, todo: pd.Series) -> pd.DataFrame:
        made = [parsers.linkify(c, [(x["term"], x["canonical"]) for x in t]) for c, t in zip(content, todo, strict=True)]
        return pd.DataFrame({"text": pd.Series([a for a, _ in made], dtype=object), "done": pd.Series([b for _, b in made], dtype=object)})

    met = fresh.select("path", link("content", "todo").alias("r")).select("path", F.col("r.text").alias("content"), F.col("r.done").alias("added"))
    return met.where(F.size("added") > 0)


def merge_pages(entries: DataFrame, groups: DataFrame, whitelist: DataFrame, combine: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (``path``, ``slug``, ``content``) after duplicates became one, and the redirects.

    ``groups`` (``seq``, ``slugs``) name duplicates; those on the whitelist or seen
    before do not count, nor do slugs of no page.  A group becomes its first
    page: its lists take in the others', its body is ``combine`` of the bodies one
    after the other (by default the first stays).  A slug of several groups goes
    with the first.  Links and ``related`` of all pages follow the redirects
    (``slug``, ``canonical``).
    """
    fresh = merge.first_per_key(merge.not_whitelisted(groups, whitelist)).select("seq", F.posexplode("slugs").alias("pos", "slug"))
    there = fresh.join(entries.select("slug").distinct(), "slug")
    once = there.groupBy("slug").agg(F.min(F.struct("seq", "pos")).alias("at")).select("slug", F.col("at.seq").alias("seq"), F.col("at.pos").alias("pos"))
    first = once.groupBy("seq").agg(F.min(F.struct("pos", "slug")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("seq", F.col("f.slug").alias("canonical"))
    member = cut(once.join(first, "seq"))
    redirects = member.where("slug <> canonical").select("slug", "canonical")
    of_group = entries.join(member.select("slug", "canonical", "pos"), "slug").groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("all"))

    @F.pandas_udf(T.StringType())
    def join(group: pd.Series) -> pd.Series:
        out = []
        for rows in group:
            text = rows[0]["content"]
            for other in rows[1:]:
                for name in LISTS:
                    mine = pages.read_array(text, name)
                    both = pages.ci_union(mine, pages.read_array(other["content"], name))
                    text = pages.write_array(text, name, both) if both != mine else text
                if combine is not None:
                    cut_at = len(text) - len(pages.header_and_body(text)[1])
                    text = text[:cut_at] + combine(text[cut_at:], pages.header_and_body(other["content"])[1])
            out.append(text)
        return pd.Series(out, dtype=object)

    merged = of_group.select(F.col("canonical").alias("slug"), join("all").alias("merged"))
    kept = entries.join(redirects.select("slug"), "slug", "left_anti").join(merged, "slug", "left").withColumn("content", F.coalesce("merged", "content")).drop("merged")
    named = F.concat(X.wikilinks(F.col("content")), F.transform(parsers.header_list("related")(F.col("content")), lambda x: F.regexp_replace(x, r"^\[\[|\]\]$", "")))
    keyed = kept.select("path", F.explode(F.array_distinct(F.transform(named, X.normal_target))).alias("key")).join(redirects.select(F.lower("slug").alias("key"), "canonical"), "key")
    per_page = keyed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "canonical"))).alias("todo"))

    @F.pandas_udf(T.StringType())
    def redirect(content: pd.Series, todo: pd.Series) -> pd.Series:
        out = []
        for text, pairs in zip(content, todo, strict=True):
            for x in pairs if pairs is not None else ():
                text = parsers.rewrite_target(text, x["key"], x["canonical"])
            to = {x["key"]: x["canonical"] for x in pairs} if pairs is not None else {}
            related = pages.read_array(text, "related")
            moved = pages.ci_union([to.get(parsers.clean_target(r).lower(), r) for r in related])
            out.append(pages.write_array(text, "related", moved) if moved != related else text)
        return pd.Series(out, dtype=object)

    out = kept.join(per_page, "path", "left").withColumn("content", F.when(F.col("todo").isNull(), F.col("content")).otherwise(redirect("content", "todo"))).drop("todo")
    return out.select("path", "slug", "content"), redirects


def lint(pages_: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(``kind``, ``file``, ``detail``, ``suggestion``) of all that is amiss with pages (``idx``, ``slug``, ``name``, ``title``, ``body``).

    With ``tokens`` (``idx``, ``token``) also, for pages that nothing links or that
    link nothing, the page most like them; no others are asked for.  Pages and links
    are written once, as each check reads them.
    """
    found = cut_loop(links.links_of(pages_))
    pages_ = cut_loop(pages_.select("idx", "slug", "name", "title"))
    names = pages_.select(F.col("idx").alias("src"), "name")
    broken = cut_loop(links.broken_links(found, pages_))
    hints = links.suggest_for_broken(broken, pages_)
    bad = broken.join(hints.hint("merge"), "target", "left").join(names.hint("merge"), "src").select(F.lit("broken-link").alias("kind"), F.col("name").alias("file"), F.col("target").alias("detail"), "suggestion")
    lone, mute = (cut_loop(x.select("idx", "name")) for x in (links.orphans(found, pages_), links.without_links(found, pages_)))
    empty = F.lit(None).cast("string")
    if tokens is None:
        like = lone.select("idx", empty.alias("suggestion")).limit(0)
    else:
        like = cut_loop(links.suggest_related(pages_, tokens, asks=lone.unionAll(mute)).select("idx", "suggestion"))
    alone = lone.join(like.hint("merge"), "idx", "left").select(F.lit("orphan"), "name", empty, "suggestion")
    silent = mute.join(like.hint("merge"), "idx", "left").select(F.lit("no-outlinks"), "name", empty, "suggestion")
    twice = links.duplicate_names(pages_).join(names.withColumnRenamed("src", "idx").hint("merge"), "idx").select(F.concat(F.lit("duplicate-"), F.col("kind")), "name", F.col("first_idx").cast("string"), empty)
    return bad.unionAll(alone).unionAll(silent).unionAll(twice)


def page_rows(files: DataFrame) -> DataFrame:
    """(``idx``, ``slug``, ``name``, ``title``, ``body``, ``tokens``) of a tree's pages (``name``, ``raw``).

    ``name`` is the path below the root.  The index and the log are no pages.
    ``idx`` is the place in the order of names, by ranges and their counts.
    """
    kept = files.where(~X.base_name(F.col("name")).isin("index.md", "log.md")).withColumn("stem", _stem(F.col("name")))
    slug = X.base_name(F.col("stem"))
    body = F.regexp_replace("raw", r"\A---\s*\n[\s\S]*?\n---[^\n]*\n?", "")
    title = X.title_of(_field(F.col("raw"), "title"), body, slug)
    rows = kept.select(F.col("stem").alias("name"), slug.alias("slug"), title.alias("title"), F.col("raw").alias("body"))
    placed = merge.positions(rows, ["name"])
    return placed.withColumn("tokens", X.tokens(F.concat_ws(" ", "title", "slug", F.left("body", F.lit(4000))))).withColumnRenamed("p", "idx")


def entry_map(entries: DataFrame, order: Column | None = None) -> DataFrame:
    """(``slug``, ``path``): of pages that share a slug the last in ``order``, by default by category and name."""
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.element_at(F.split("path", "/"), -2))
    return entries.groupBy("slug").agg(F.max_by("path", F.struct(at, "path") if order is None else order).alias("path"))
