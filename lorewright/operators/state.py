"""Keyed state as tables: tasks, reviews, caches, ledgers, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import merge

MAX_RETRIES = 3
#: How long nothing is taken after a usage limit.
PAUSE_MINUTES = 15


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key, by pre-aggregated maximum."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def changes(rows: DataFrame, key: str | None, order: str, value: str, cut: int = 50_000) -> DataFrame:
    """Rows whose value differs from the one before; the first is the baseline.

    With a key, rows are compared within it.  Without one all rows are one series:
    they are numbered over ordered ranges, and each is joined with the one before it,
    so no task holds them all.
    """
    if key:
        met = rows.withColumn("__before", F.lag(value).over(W.partitionBy(key).orderBy(order)))
    else:
        placed = merge.positions(rows, [order])
        met = placed.join(placed.select((F.col("p") + 1).alias("p"), F.col(value).alias("__before")), "p").drop("p")
    return met.where(F.col("__before").isNotNull() & (F.col(value) != F.col("__before"))).withColumn(value, F.left(F.col(value).cast("string"), F.lit(cut))).drop("__before")


STATUSES = ("none", "pending", "processing", "done", "failed", "cancelled")
EVENTS = ("enqueue", "take", "complete", "fail", "limit", "cancel", "retry", "remove", "recover")
#: All states: a status and how often it was tried.
STATES = tuple((s, r) for s in STATUSES for r in range(MAX_RETRIES + 1))


def next_state(status: str, retry: int, event: str) -> tuple[str, int]:
    """The state machine of a task.

    Enqueue revives what is not pending or in work; take needs pending; complete
    and fail need work.  A failure goes back to pending until the third, which
    fails; one by a usage limit goes back and does not count.  Cancel ends what
    has not ended, retry revives what failed or was cancelled, remove forgets a
    task that is not in work, and recover, after a crash, puts work back.
    """
    waiting, working = status == "pending", status == "processing"
    if event == "enqueue" and not waiting and not working or event == "retry" and status in ("failed", "cancelled"):
        return "pending", 0
    if event == "take" and waiting:
        return "processing", retry
    if event == "complete" and working:
        return "done", retry
    if event == "fail" and working:
        return ("failed" if retry + 1 >= MAX_RETRIES else "pending"), min(retry + 1, MAX_RETRIES)
    if event in ("limit", "recover") and working:
        return "pending", retry
    if event == "cancel" and (waiting or working):
        return "cancelled", retry
    if event == "remove" and not working:
        return "none", 0
    return status, retry


def task_states(events: DataFrame, key: str = "source_path", order: str = "seq", parts: int = 64) -> DataFrame:
    """(``key``, ``status``, ``retry_count``, ``n_events``) after all events; see ``next_state``.

    States are few, so a stretch of a log is a function on them, and functions
    can be put one after the other.  A key's log is cut into ``parts`` ranges of
    ``order``; each becomes a function, and a key's are then composed.  So no task
    holds a whole log, however many events a key has.
    """
    known = F.array(*(F.array(*(F.lit(STATES.index(next_state(*s, e))) for s in STATES)) for e in EVENTS))
    number = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event")).cast("int")
    same = F.array(*(F.lit(i) for i in range(len(STATES))))
    span = events.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    at = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.width_bucket(F.col(order), F.col("lo"), F.col("hi"), F.lit(parts)))
    cut = events.crossJoin(F.broadcast(span)).select(key, at.alias("part"), F.struct(F.col(order).alias("o"), number.alias("e")).alias("x"))
    # An event that is none of these changes nothing, but counts.
    apply = lambda f, x: F.when(x["e"] > 0, F.transform(f, lambda s: F.element_at(F.element_at(known, x["e"]), s + 1))).otherwise(f)
    pieces = cut.groupBy(key, "part").agg(F.array_sort(F.collect_list("x")).alias("log"))
    pieces = pieces.select(key, F.size("log").cast("long").alias("n"), F.struct("part", F.aggregate("log", same, apply).alias("f")).alias("p"))
    whole = pieces.groupBy(key).agg(F.sum("n").alias("n_events"), F.array_sort(F.collect_list("p")).alias("ps"))
    end = F.aggregate("ps", F.lit(STATES.index(("none", 0))), lambda s, p: F.element_at(p["f"], s + 1))
    status, retry = F.array(*(F.lit(s) for s, _ in STATES)), F.array(*(F.lit(r) for _, r in STATES))
    return whole.select(key, F.element_at(status, end + 1).alias("status"), F.element_at(retry, end + 1).cast("long").alias("retry_count"), "n_events")


def pauses(limits: DataFrame, at: str = "at", minutes: int = PAUSE_MINUTES) -> DataFrame:
    """(``start``, ``end``) of the times in which nothing is taken: after each usage limit, joined.

    Limits are reduced to one row per window of that length before they are put
    in order, so what one task orders is the time that is covered, not the limits.
    """
    width = F.expr(f"interval {minutes} minutes")
    few = limits.groupBy(F.window(at, f"{minutes} minutes").alias("w")).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    w = W.orderBy("a")
    new = F.coalesce(F.col("a") > F.lag("b").over(w) + width, F.lit(True)).cast("long")
    islands = few.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("island").agg(F.min("a").alias("start"), (F.max("b") + width).alias("end")).drop("island")


def queue_summary(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "failed", "cancelled")], F.count(F.lit(1)).alias("total"))


def next_tasks(tasks: DataFrame, running: DataFrame, limit: int) -> DataFrame:
    """The oldest pending tasks whose path is not being worked on."""
    return tasks.where("status = 'pending'").join(running.select("source_path"), "source_path", "left_anti").orderBy("added_at", "id").limit(limit)


def recovered(tasks: DataFrame) -> DataFrame:
    """After a crash: what was in work is pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "processing", F.lit("pending")).otherwise(F.col("status")))


def fold_reviews(items: DataFrame, order: str = "seq") -> DataFrame:
    """One row per review: resolved stays, the first non-empty detail, the
    earliest time, and pages in the order they came."""
    keyed = items.withColumn("id", X.review_id(F.col("type"), F.col("title")))
    filled = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col(order)))
    out = keyed.groupBy("id").agg(
        F.when(F.bool_or(F.col("status") == "resolved"), F.lit("resolved")).otherwise(F.lit("open")).alias("status"), F.coalesce(filled("detail"), F.lit("")).alias("detail"),
        F.min(F.nullif("created", F.lit(""))).alias("created"), F.count(F.lit(1)).alias("n_items"),
    )
    flat = keyed.select("id", order, F.posexplode("pages").alias("pos", "page")).groupBy("id", "page").agg(F.min(F.struct(order, "pos")).alias("at"))
    pages = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "page"))), lambda x: x["page"]).alias("pages"))
    return out.join(pages, "id", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<string>")))


def cache_hits(sources: DataFrame, cache: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources with an entry of the same hash, all of whose files exist; no side of a join passes the driver."""
    met = sources.join(cache.hint("merge"), ["source_path", "hash"])
    missing = met.select("source_path", F.explode("files_written").alias("path")).join(existing.hint("merge"), "path", "left_anti").select("source_path").distinct()
    return met.join(missing.hint("merge"), "source_path", "left_anti").select("source_path", "hash")


def ledger_delta(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """(``rel_path``, ``sha256``, ``change``): new, changed and same rows of now."""
    known = ledger.select("rel_path", F.col("sha256").alias("__old"))
    met = current.join(known, "rel_path", "left")
    return met.select("rel_path", "sha256", F.when(F.col("__old").isNull(), F.lit("new")).when(F.col("__old") == F.col("sha256"), F.lit("same")).otherwise(F.lit("changed")).alias("change"))


def next_ledger(ledger: DataFrame, inserted: DataFrame) -> DataFrame:
    """The ledger after an insert that succeeded; rows not inserted stay."""
    return ledger.join(inserted.select("rel_path"), "rel_path", "left_anti").unionByName(inserted.select("rel_path", "sha256"))


def index_stats(delta: DataFrame) -> DataFrame:
    return delta.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("change") != "same").alias("inserted"), F.count_if(F.col("change") == "same").alias("skipped"))


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")


def entries_of(entries: DataFrame, materials: DataFrame) -> DataFrame:
    """Entries with any source among the materials."""
    flat = entries.select("path", F.explode("sources").alias("source"))
    return entries.join(flat.join(materials.select("source"), "source", "left_semi").select("path").distinct(), "path", "left_semi")


def repair_blocks(blocks: DataFrame, asked: DataFrame, order: str = "seq") -> DataFrame:
    """Blocks with ``verdict``: kept (first of an asked path), duplicate or dropped."""
    met = blocks.join(asked.select("path", F.lit(True).alias("__asked")).distinct(), "path", "left")
    first = F.row_number().over(W.partitionBy("path").orderBy(order)) == 1
    return met.withColumn("verdict", F.when(F.col("__asked").isNull(), F.lit("dropped")).when(first, F.lit("kept")).otherwise(F.lit("duplicate"))).drop("__asked")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the rows of ``new`` in place of those of their sources."""
    return without(cache, new, "source_path").unionByName(new)


def review_of(blocks: DataFrame, created: str) -> DataFrame:
    """Review items of parsed blocks (``source_path``, ``type``, ``title``, ...), open, known by type and title."""
    return blocks.withColumn("id", X.review_id(F.col("type"), F.col("title"))).withColumn("status", F.lit("open")).withColumn("created", F.lit(created))


def resolved(reviews: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews with those that ``answers`` (``id``, ``note``) name resolved, and the answers with ``hit``."""
    one = answers.groupBy("id").agg(F.min("note").alias("note"))
    met = reviews.join(one.withColumn("named", F.lit(True)), "id", "left")
    out = met.withColumn("status", F.when(F.col("named"), F.lit("resolved")).otherwise(F.col("status"))).withColumn("resolved_note", F.when(F.col("named"), F.col("note")))
    hit = one.join(reviews.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return out.drop("named", "note"), hit.select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


def status(tasks: DataFrame, materials: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: the queue's counts, materials that are not compiled, open reviews."""
    waiting = materials.agg(F.count_if(~F.col("compiled")).alias("uncompiled"))
    asked = reviews.agg(F.count_if(F.col("status") != "resolved").alias("open_reviews"))
    return queue_summary(tasks).crossJoin(waiting).crossJoin(asked)


def checkpoints_that_fit(checkpoints: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Checkpoints whose parameters are all those wanted now; nulls are equal."""
    on = None
    for k in keys:
        same = checkpoints[k].eqNullSafe(wanted[k])
        on = same if on is None else on & same
    return checkpoints.join(wanted, on, "left_semi")
