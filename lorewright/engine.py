"""One object for what a user of the corpus does: ingest, index, check, search."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import parsers
from .functions import text as X
from .functions.windows import token_windows
from .operators import communities, compiling, graph, merge, procedures, retrieval, state
from .operators.entities import entity_graph
from .plans.lineage import cut
from .sources import readers, settled, sinks
from .streaming import jobs

#: Buckets of the index.
BUCKETS = 64
_QUEUE = "source_path string, seq long, event string, at timestamp"
_ENTRY = "path string, content string"
_CHUNK = "chunk_id string, rel_path string, sha256 string, content string, embedding array<double>"
_CACHE = "source_path string, hash string, files_written array<string>"


class Config:
    """A tree of settings with dotted paths; given values are merged over defaults."""

    def __init__(self, defaults: dict, given: dict | None = None):
        self.tree = self.merged(defaults, given or {})

    @classmethod
    def merged(cls, base: dict, over: dict) -> dict:
        return base | {k: cls.merged(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in over.items()}

    def get(self, path: str, default=None):
        at = self.tree
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value) -> None:
        *parts, last = path.split(".")
        at = self.tree
        for part in parts:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value


class Engine:
    """Tables below ``root``; streams by name; a model and an embedding of text columns that can be plugged in."""

    def __init__(self, spark: SparkSession, root: str, generate: Callable[[str], str] = compiling.stub, embed: Callable[[Column], Column] = retrieval.embed):
        self.spark, self.root, self.generate, self.embed = spark, root.rstrip("/"), generate, embed
        self.streams: dict[str, StreamingQuery] = {}

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    # materials
    def ingest(self, rows: DataFrame) -> DataFrame:
        return sinks.append_materials(rows, self._at("materials"))

    def ingest_pages(self, pages: DataFrame) -> DataFrame:
        texts = readers.page_texts(pages).where("error is null")
        return self.ingest(texts.select(F.lit("web").alias("source"), F.col("page_id").alias("seq"), F.col("text").alias("content")))

    def materials(self) -> DataFrame:
        return sinks.read_state(self.spark, self._at("materials"), "hash string, id string, source string, seq long, content string")

    def import_bytes(self, name: str, data: bytes, seq: int) -> DataFrame:
        """Ingest a file's bytes, in UTF-8, GBK or Latin-1, under its name."""
        row = self.spark.createDataFrame([("file", seq, parsers.decode(data))], "source string, seq long, content string")
        return self.ingest(row.withColumn("name", F.lit(name)).select("source", "seq", "content"))

    def mark_compiled(self, ids: DataFrame) -> None:
        """Note that the materials (``id``) are compiled."""
        new = cut(ids.select("id"))
        sinks.update_state(self.spark, self._at("compiled"), "id string", lambda known: known.unionByName(new).distinct())

    def uncompiled(self) -> DataFrame:
        return self.materials().join(sinks.read_state(self.spark, self._at("compiled"), "id string"), "id", "left_anti")

    # streams
    def start(self, name: str, stream: DataFrame, sink: Callable[[DataFrame, int], None], interval: str = "5 seconds") -> StreamingQuery:
        """Start a stream whose batches are taken once each; one that fails does not touch the others."""
        once = jobs.once(sink, self._at(f"streams/{name}-batches"))
        self.streams[name] = stream.writeStream.queryName(name).option("checkpointLocation", self._at(f"streams/{name}")).trigger(processingTime=interval).foreachBatch(once).start()
        return self.streams[name]

    def watch(self, name: str, folder: str, **options) -> StreamingQuery:
        """Take the texts that settle in a folder, each path once; see ``settled.watched``."""
        files = settled.watched(self.spark, folder, **options)
        texts = files.select(F.lit("file").alias("source"), F.unix_micros("modified").alias("seq"), parsers.decoded(F.col("content")).alias("content"))
        return self.start(name, texts, lambda batch, number: self.ingest(batch))

    def stop(self, name: str | None = None) -> None:
        for key in [name] if name else list(self.streams):
            self.streams.pop(key).stop()

    def status(self) -> dict[str, str]:
        return {k: "error" if q.exception() else "running" if q.isActive else "stopped" for k, q in self.streams.items()}

    # queue
    def enqueue(self, events: DataFrame) -> None:
        """Add events (``source_path``, ``seq``, ``event``, and ``at`` if known) to the queue's log."""
        at = (F.col("at") if "at" in events.columns else F.lit(None)).cast("timestamp").alias("at")
        events.select("source_path", F.col("seq").cast("long").alias("seq"), "event", at).write.mode("append").parquet(self._at("queue"))

    def trigger(self, path: str, seq: int) -> None:
        """Put one material back into the queue."""
        self.enqueue(self.spark.createDataFrame([(path.replace("\\", "/"), seq, "enqueue")], "source_path string, seq long, event string"))

    def tasks(self) -> DataFrame:
        return state.task_states(sinks.read_state(self.spark, self._at("queue"), _QUEUE))

    def manager_status(self) -> DataFrame:
        """One row: counts of the queue, uncompiled materials, open reviews."""
        compiled = sinks.read_state(self.spark, self._at("compiled"), "id string").withColumn("compiled", F.lit(True))
        materials = self.materials().join(compiled, "id", "left").select(F.coalesce("compiled", F.lit(False)).alias("compiled"))
        return state.status(self.tasks(), materials, self.reviews())

    # compiling
    def entries(self) -> DataFrame:
        """All pages: ``path`` (below the root) and ``content``."""
        return sinks.read_state(self.spark, self._at("entries"), _ENTRY)

    def work(self, today: str, now: datetime, limit: int = 100, **options) -> dict[str, int]:
        """Take the oldest pending tasks from the queue, compile their materials, and tell the queue what became of each.

        Tasks are materials by ``id``.  One that gave a page is complete, others
        failed; an error that speaks of a usage limit is one, and for 15 minutes of
        ``now`` after it nothing is taken.  What an earlier run that did not end has
        taken is taken back first.  Gives how many tasks had which event.
        """
        log = sinks.read_state(self.spark, self._at("queue"), _QUEUE)
        limits = log.where("event = 'limit' and at is not null").select("at")
        if not state.pauses(limits).where((F.lit(now) >= F.col("start")) & (F.lit(now) < F.col("end"))).isEmpty():
            return {"paused": 1}
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1

        def tell(tasks: DataFrame, step: int) -> None:
            self.enqueue(tasks.withColumn("seq", F.lit(seq + step)).withColumn("at", F.lit(now)))

        tasks = self.tasks()
        tell(cut(tasks.where("status = 'processing'").select("source_path", F.lit("recover").alias("event"))), 0)
        first = log.where("event = 'enqueue'").groupBy(F.col("source_path").alias("id")).agg(F.min("seq").alias("added_at"))
        waiting = self.tasks().join(first, F.col("source_path") == F.col("id"))
        # As many as one run takes, at most.
        taken = cut(state.next_tasks(waiting, self.tasks().where("status = 'processing'"), limit).select("source_path"))
        tell(taken.withColumn("event", F.lit("take")), 1)
        todo = self.materials().join(taken.select(F.col("source_path").alias("id")), "id", "left_semi")
        out = self._compiled(todo, today, **options)
        wrote = out.entries.select("source_path", F.lit(True).alias("wrote")).distinct()
        errors = out.rejected.where(F.col("path").isNull()).groupBy("source_path").agg(F.max(X.usage_limited(F.col("reason"))).alias("limited"))
        cached = sinks.read_state(self.spark, self._at("cache"), _CACHE).select("source_path", F.lit(True).alias("known")).distinct()
        met = taken.join(wrote, "source_path", "left").join(errors, "source_path", "left").join(cached, "source_path", "left")
        ended = cut(met.select("source_path", F.when(F.coalesce("wrote", "known", F.lit(False)), F.lit("complete")).when(F.col("limited"), F.lit("limit")).otherwise(F.lit("fail")).alias("event")))
        tell(ended, 2)
        return {r["event"]: r["count"] for r in ended.groupBy("event").count().collect()}

    def compile(self, today: str, repair: Callable[[str], str] | None = None, **options) -> procedures.Compiled:
        """Compile what is not compiled yet, and keep pages, reviews, cache, log and flags."""
        return self._compiled(self.uncompiled(), today, repair, **options)

    def _compiled(self, todo: DataFrame, today: str, repair: Callable[[str], str] | None = None, **options) -> procedures.Compiled:
        known = procedures.summaries(self.entries()).select("path", "slug", "title", "category")
        cache = sinks.read_state(self.spark, self._at("cache"), _CACHE)
        out = procedures.compile_materials(todo.select(F.col("id").alias("source_path"), "content"), known, cache, today, self.generate, repair, **options)
        sinks.update_state(self.spark, self._at("entries"), _ENTRY, lambda old: state.without(old, out.entries, "path").unionByName(out.entries.select("path", "content")))
        sinks.update_state(self.spark, self._at("cache"), _CACHE, lambda old: state.cache_put(old, out.cache.select("source_path", "hash", "files_written")))
        kept = self.reviews()
        new = out.reviews.withColumn("resolved_note", F.lit(None).cast("string")).select(*kept.columns).join(kept.select("id"), "id", "left_anti").dropDuplicates(["id"])
        sinks.replace_state(kept.unionByName(new.select(*kept.columns)), self._at("reviews"))
        sinks.append_lines(out.log, self._at("log"))
        self.mark_compiled(out.entries.select(F.col("source_path").alias("id")).distinct())
        return out

    def reviews(self) -> DataFrame:
        return sinks.read_state(self.spark, self._at("reviews"), "id string, source_path string, type string, title string, detail string, status string, created string, resolved_note string")

    def resolve(self, answers: DataFrame) -> DataFrame:
        """Resolve reviews (``id``, ``note``); which of them there were."""
        after, hit = state.resolved(self.reviews(), answers)
        hit = cut(hit)
        sinks.replace_state(after.select(*self.reviews().columns), self._at("reviews"))
        return hit

    # pages
    def read(self, path: str) -> DataFrame:
        return self.entries().where(F.col("path") == path)

    def save(self, pages: DataFrame) -> None:
        """Add or replace pages (``path``, ``content``); a path that is not safe is an error."""
        safe = F.when(X.safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no safe path: "), "path")))
        new = pages.select(safe.alias("path"), "content")
        sinks.update_state(self.spark, self._at("entries"), _ENTRY, lambda old: state.without(old, new, "path").unionByName(new))

    def delete(self, paths: DataFrame) -> None:
        """Drop pages (``path``) and what the index has of them."""
        sinks.update_state(self.spark, self._at("entries"), _ENTRY, lambda old: state.without(old, paths, "path"))
        self.remove(paths.select(F.col("path").alias("rel_path")))

    def forget(self, ids: DataFrame) -> DataFrame:
        """Delete the pages that come from any of the materials (``id``); their paths."""
        sourced = self.entries().select("path", parsers.header_list("sources")(F.col("content")).alias("sources"))
        gone = cut(state.entries_of(sourced, ids.select(F.col("id").alias("source"))).select("path"))
        self.delete(gone)
        return gone

    def _with_slugs(self) -> DataFrame:
        return self.entries().select("path", X.base_name(X.strip_suffix(F.col("path"))).alias("slug"), "content")

    def enrich(self) -> DataFrame:
        """Put valid proposed links into the pages; (``path``, ``added``) of those that changed."""
        out = cut(procedures.enrich(self._with_slugs(), self.generate))
        self.save(out)
        return out.select("path", "added")

    def merge(self, groups: DataFrame, whitelist: DataFrame, combine: Callable[[str, str], str] | None = None) -> DataFrame:
        """Make one page of each group (``seq``, ``slugs``); the redirects.  The pages before are kept as backup."""
        pages, redirects = procedures.merge_pages(self._with_slugs(), groups, whitelist, combine)
        redirects = cut(redirects)
        sinks.replace_state(pages.select("path", "content"), self._at("entries"))
        return redirects

    # checks
    def lint(self, pages: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
        """(``kind``, ``file``, ``detail``, ``suggestion``) of all that is amiss."""
        return procedures.lint(pages, tokens)

    # index and search
    def index(self, entries: DataFrame, rebuild: bool = False) -> DataFrame:
        """Cut what is new or changed into windows of tokens and embed them; returns (scanned, inserted, skipped).

        Each chunk has the digest of its entry's text, so the chunks are the ledger
        too, and a run that did not end is made good by the next.  Only buckets of
        paths that changed are written.
        """
        current = entries.select("rel_path", X.content_hash(F.col("raw")).alias("sha256"))
        ledger = self._chunks().select("rel_path", "sha256").distinct()
        delta = cut(state.ledger_delta(current, ledger.where(F.lit(not rebuild))))
        todo = delta.where("change <> 'same'").select("rel_path", "sha256")
        pieces = entries.join(todo, "rel_path").select("rel_path", "sha256", F.explode_outer(token_windows(F.col("raw"))).alias("c"))
        rows = pieces.select(F.concat("rel_path", F.lit("-chunk-"), F.col("c.index").cast("string")).alias("chunk_id"), "rel_path", "sha256", F.col("c.main").alias("content"), self.embed(F.coalesce("c.main", F.lit(""))).alias("embedding"))
        sinks.replace_rows(rows, todo, self._at("chunks"), "rel_path", _CHUNK, BUCKETS)
        return self.spark.createDataFrame(state.index_stats(delta).collect(), "scanned long, inserted long, skipped long")

    def _chunks(self) -> DataFrame:
        return sinks.read_rows(self.spark, self._at("chunks"), "rel_path", _CHUNK)

    def remove(self, paths: DataFrame) -> None:
        """Drop documents from the index."""
        sinks.replace_rows(self._chunks().drop("bucket").limit(0), cut(paths.select("rel_path")), self._at("chunks"), "rel_path", _CHUNK, BUCKETS)

    def build_graph(self) -> None:
        """Entities, edges and communities of all chunks, as tables that the search modes use."""
        nodes, edges = entity_graph(self._chunks())
        nodes, edges = cut(nodes), cut(edges)
        for name, rows in (("graph-entities", nodes), ("graph-edges", edges), ("graph-communities", communities.louvain(edges, nodes))):
            sinks.replace_state(rows, self._at(name))

    def entity_graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What ``build_graph`` made last."""
        kinds = {"entities": "id string, label string, n long, sources array<string>", "edges": "source string, target string, relation string, weight long, sources array<string>", "communities": "id string, community string"}
        return tuple(sinks.read_state(self.spark, self._at(f"graph-{name}"), kind) for name, kind in kinds.items())

    def search(self, text: str, k: int = 10, mode: str = "naive", entities: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        """The k best chunks in a mode.

        All but ``naive`` use entities (``id``, ``label``, ``sources``) and edges:
        those that are given, or else the graph that ``build_graph`` made.
        """
        if mode not in retrieval.MODES:
            raise ValueError(f"no such mode: {mode}")
        chunks = self._chunks().where("chunk_id is not null")
        query = self.spark.range(1).select(self.embed(F.lit(text)).alias("v")).first()["v"]
        if mode == "naive":
            hits = retrieval.search(chunks, list(query), k, key="chunk_id")
        else:
            groups = None
            if entities is None or edges is None:
                entities, edges, groups = self.entity_graph()
            near = retrieval.search(chunks, list(query), max(k, 60), key="chunk_id").select(F.col("chunk_id").alias("chunk"), "rank")
            best = retrieval.by_mode(mode, near, entities, edges, text.split(), k, groups)
            ranked = retrieval.ranked(best).withColumnRenamed("chunk", "chunk_id")
            hits = chunks.join(ranked, "chunk_id").join(best.withColumnRenamed("chunk", "chunk_id"), "chunk_id")
        return hits.select("rank", F.left("content", F.lit(retrieval.SNIPPET)).alias("content"), F.col("rel_path").alias("file_path"), "score").orderBy("rank")

    def ask(self, text: str, k: int = 6, mode: str = "naive", entities: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        return retrieval.answer(self.search(text, k, mode, entities, edges), mode)

    def graph(self, nodes: DataFrame, edges: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
        """The part of a graph that is shown: exported nodes and edges, simple and capped."""
        kept, first = graph.export(nodes, edges)
        return graph.view(kept, first, most=most)

    def deduplicate(self, pages: DataFrame, groups: DataFrame, whitelist: DataFrame) -> DataFrame:
        """Redirects (``slug``, ``canonical``) of the groups that are left to merge."""
        fresh = merge.first_per_key(merge.not_whitelisted(groups, whitelist))
        flat = fresh.select(F.element_at("slugs", 1).alias("canonical"), F.explode("slugs").alias("slug")).where("slug <> canonical")
        return flat.join(pages.select("slug"), "slug", "left_semi")
