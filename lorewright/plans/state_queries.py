"""Queries of keyed state, deltas and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folding, retrieval, state
from ..session import table
from ..streaming import bounded, jobs, queue
from .registry import ORACLES, query

# Which queue event an event type of the table stands for.
_EVENT = "case event_type when 'click' then 'enqueue' when 'view' then 'take' when 'purchase' then 'complete' when 'error' then case when event_id % 4 = 0 then 'limit' else 'fail' end else case when event_id % 3 = 0 then 'cancel' when event_id % 20 = 7 then 'retry' when event_id % 20 = 13 then 'remove' when event_id % 20 = 17 then 'recover' else 'enqueue' end end"


def task_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("source_path"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"))


#: The state machine as a recursive query: one step per event of a task.
_FOLD = f"""with recursive e as (select 'doc-' || user_id as source_path, {_EVENT} as event, row_number() over (partition by user_id order by event_id) as n from events),
s as (select distinct source_path, 'none' as status, cast(0 as bigint) as retry_count, cast(0 as bigint) as n from e
  union all
  select s.source_path,
    case when event = 'enqueue' and status not in ('pending', 'processing') then 'pending' when event = 'take' and status = 'pending' then 'processing'
      when event = 'complete' and status = 'processing' then 'done' when event = 'fail' and status = 'processing' then case when retry_count + 1 >= 3 then 'failed' else 'pending' end
      when event = 'cancel' and status in ('pending', 'processing') then 'cancelled' when event = 'retry' and status in ('failed', 'cancelled') then 'pending'
      when event = 'remove' and status <> 'processing' then 'none' when event in ('limit', 'recover') and status = 'processing' then 'pending' else status end,
    case when event = 'enqueue' and status not in ('pending', 'processing') or event = 'retry' and status in ('failed', 'cancelled') or event = 'remove' and status <> 'processing' then 0 when event = 'fail' and status = 'processing' then retry_count + 1 else retry_count end, e.n
  from s join e on e.source_path = s.source_path and e.n = s.n + 1),
t as (select source_path, status, retry_count, n as n_events from s qualify n = max(n) over (partition by source_path))
"""


#: Queues of five tasks each, all states in two lists; a usage limit puts all work back and nothing is taken for 15 minutes.
_QUEUE = f"""with recursive e as (select 'q' || user_id as queue, 1 + json_extract_string(props, '$.k')::int % 5 as p, {_EVENT} as event, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n from events),
s as (select distinct queue, ['none', 'none', 'none', 'none', 'none'] as st, [0, 0, 0, 0, 0] as rt, [false, false, false, false, false] as seen, cast(null as bigint) as until, cast(0 as bigint) as n from e
  union all
  select queue,
    case when event = 'take' and paused then st when event = 'limit' and st[p] = 'processing' then list_transform(st, lambda x: case when x = 'processing' then 'pending' else x end)
      else list_transform(st, lambda x, i: case when i <> p then x
        when event = 'enqueue' and x not in ('pending', 'processing') then 'pending' when event = 'take' and x = 'pending' then 'processing' when event = 'complete' and x = 'processing' then 'done'
        when event = 'fail' and x = 'processing' then case when rt[p] + 1 >= 3 then 'failed' else 'pending' end when event = 'cancel' and x in ('pending', 'processing') then 'cancelled'
        when event = 'retry' and x in ('failed', 'cancelled') then 'pending' when event = 'remove' and x <> 'processing' then 'none' when event = 'recover' and x = 'processing' then 'pending' else x end) end,
    list_transform(rt, lambda x, i: case when i <> p then x when event = 'enqueue' and st[p] not in ('pending', 'processing') or event = 'retry' and st[p] in ('failed', 'cancelled') or event = 'remove' and st[p] <> 'processing' then 0 when event = 'fail' and st[p] = 'processing' then x + 1 else x end),
    list_transform(seen, lambda x, i: x or i = p and not (event = 'take' and paused)),
    case when event = 'limit' and st[p] = 'processing' then ms + 900000 when paused then until end, m
  from (select s.queue, s.st, s.rt, s.seen, s.until, e.p, e.event, e.ms, e.n as m, coalesce(e.ms < s.until, false) as paused from s join e on e.queue = s.queue and e.n = s.n + 1)),
z as (select * from s qualify n = max(n) over (partition by queue))
select queue, 'doc-' || i as source_path, st[i] as status, cast(rt[i] as bigint) as retry_count from (select queue, st, rt, seen, unnest([1, 2, 3, 4, 5]) as i from z) where seen[i]
"""


@query(_QUEUE)
def stream_queue_runner(spark, sf_dir):
    """Final states of tasks in queues that usage limits pause and timers resume."""
    events = jobs.event_stream(spark, f"{sf_dir}/events.parquet*")
    rows = events.select(
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("queue"), F.col("event_id").alias("seq"), "at",
        F.concat(F.lit("doc-"), (F.get_json_object("props", "$.k").cast("int") % 5 + 1).cast("string")).alias("source_path"), F.expr(_EVENT).alias("event"),
    )
    with queue.rocksdb_state(spark):
        return queue.final_states(jobs.run_to_end(queue.run(rows), "update"))


@query(_FOLD + "select * from t")
def task_latest_state(spark, sf_dir):
    return state.task_states(task_events(spark, sf_dir))


@query(_FOLD + "select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'processing') as processing, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'cancelled') as cancelled, count(*) as total from t")
def queue_summary(spark, sf_dir):
    return state.queue_summary(state.task_states(task_events(spark, sf_dir)))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def flag_update_latest(spark, sf_dir):
    """The newest version of each key."""
    return state.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""select status, path from (select case when event_id % 5 = 0 then 'processing' else 'pending' end as status, 'p' || user_id as path, event_id from events)
where status = 'pending' and path not in (select 'p' || user_id from events where event_id % 50 = 0) order by event_id limit 20""")
def queue_take(spark, sf_dir):
    """The oldest pending tasks of paths that no one works on."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.lit("processing")).otherwise(F.lit("pending")).alias("status"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("source_path"), F.col("event_id").alias("added_at"), F.col("event_id").alias("id"))
    return state.next_tasks(rows, rows.where("id % 50 = 0"), 20).select("status", F.col("source_path").alias("path"))


@query("""select 'x' || json_extract_string(props, '$.k') as title, event_type || '::x' || json_extract_string(props, '$.k') as id, case when bool_or(value > 200) then 'resolved' else 'open' end as status,
coalesce(min_by('d' || event_id, event_id) filter (event_id % 3 = 0), '') as detail, count(*) as n_items, string_agg(distinct 'p' || event_id % 4, ',' order by 'p' || event_id % 4) as pages from events group by all""")
def review_fold(spark, sf_dir):
    out = state.fold_reviews(_review_items(spark, sf_dir))
    return out.select(F.substring_index("id", "::", -1).alias("title"), "id", "status", "detail", "n_items", F.array_join(F.array_sort("pages"), ",").alias("pages"))


def _review_items(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.concat(F.lit(" X"), k).alias("title"), F.when(F.col("value") > 200, F.lit("resolved")).otherwise(F.lit("open")).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("detail"), F.lit("").alias("created"), F.array(F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).alias("pages"),
    )


@query(ORACLES["review_fold"])
def review_fold_function(spark, sf_dir):
    """The same fold by an aggregate function of its own."""
    out = folding.fold_reviews(_review_items(spark, sf_dir))
    return out.select(F.substring_index("id", "::", -1).alias("title"), "id", "status", "detail", "n_items", F.array_join(F.array_sort("pages"), ",").alias("pages"))


@query("""with recursive e as (select 'u' || user_id as channel, event_id, json_extract_string(props, '$.k') as m, row_number() over (partition by user_id order by event_id) as n from events),
s as (select distinct channel, cast([] as varchar[]) as ids, cast(null as bigint) as event_id, false as fresh, cast(0 as bigint) as n from e
  union all select s.channel, case when list_contains(ids, m) then ids when len(ids) >= 8 then list_append(ids[2:], m) else list_append(ids, m) end, e.event_id, not list_contains(ids, m), e.n from s join e on e.channel = s.channel and e.n = s.n + 1)
select channel, event_id from s where fresh""")
def stream_bounded_dedup(spark, sf_dir):
    """Messages of each channel that are none of its last eight ids."""
    events = jobs.event_stream(spark, f"{sf_dir}/events.parquet*")
    rows = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("channel"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("message_id"))
    with queue.rocksdb_state(spark):
        return jobs.run_to_end(bounded.first_of_ids(rows, 8)).select("channel", F.col("seq").alias("event_id"))


@query("""select doc_id from documents where doc_id % 4 <> 0 and doc_id % 9 <> 0 and doc_id % 6 <> 0""")
def cache_hit(spark, sf_dir):
    """Sources whose cache entry has their hash and whose files are all there."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.sha2("text", 256).alias("hash"), "doc_id")
    files = F.array(F.concat(F.lit("a"), F.col("source_path")), F.concat(F.lit("b"), F.col("source_path")))
    cache = docs.where("doc_id % 4 <> 0").select("source_path", F.when(F.col("doc_id") % 9 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"), files.alias("files_written"))
    there = docs.select(F.concat(F.lit("a"), F.col("source_path")).alias("path")).unionAll(docs.where("doc_id % 6 <> 0").select(F.concat(F.lit("b"), F.col("source_path"))))
    return state.cache_hits(docs.select("source_path", "hash"), cache, there).select(F.col("source_path").cast("long").alias("doc_id"))


def _delta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rel_path"), "text", "doc_id")
    ledger = docs.where("doc_id % 17 <> 0").select("rel_path", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.select("rel_path", F.sha2(changed, 256).alias("sha256")), ledger


@query("select 'd' || doc_id as rel_path, sha256(case when doc_id % 10 = 0 then text || '!' else text end) as sha256, case when doc_id % 17 = 0 then 'new' when doc_id % 10 = 0 then 'changed' else 'same' end as change from documents")
def incremental_delta(spark, sf_dir):
    return state.ledger_delta(*_delta(spark, sf_dir))


@query("select count(*) as scanned, count(*) filter (doc_id % 17 = 0 or doc_id % 10 = 0) as inserted, count(*) filter (doc_id % 17 <> 0 and doc_id % 10 <> 0) as skipped from documents")
def index_stats(spark, sf_dir):
    return state.index_stats(state.ledger_delta(*_delta(spark, sf_dir)))


@query("select doc_id, source from documents where doc_id % 13 <> 0")
def remove_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return state.without(docs, docs.where("doc_id % 13 = 0"), "doc_id")


@query("select distinct o_orderkey as path from orders join lineitem on l_orderkey = o_orderkey where l_suppkey % 10 = 3")
def lineage_semijoin(spark, sf_dir):
    """Orders with any supplier of a set: a semi join through an array."""
    entries = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("sources")).withColumnRenamed("l_orderkey", "path")
    chosen = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("source"))
    return state.entries_of(entries, chosen).select("path")


@query("select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is not null and p <> event_type")
def change_detection(spark, sf_dir):
    return state.changes(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("select o_orderkey as seq, 'p' || o_custkey % 50 as path, case when o_custkey % 50 >= 30 then 'dropped' when row_number() over (partition by o_custkey % 50 order by o_orderkey) = 1 then 'kept' else 'duplicate' end as verdict from orders")
def repair_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("path"))
    return state.repair_blocks(blocks, spark.range(30).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path")))


@query("select distinct o_custkey as path from orders where o_orderstatus = 'F' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'O')")
def truncation_recovery(spark, sf_dir):
    """What was asked for and is not there."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderstatus")
    return orders.where("o_orderstatus = 'F'").select("path").distinct().join(orders.where("o_orderstatus = 'O'"), "path", "left_anti")


@query("select user_id, bool_or(event_type = 'purchase') as any_purchase, count(distinct event_type) as kinds from events group by user_id")
def any_running(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.count_distinct("event_type").alias("kinds"))


@query("""select lang, round(avg(n_chars), 6) as mean_chars, count(*) as n from documents where doc_id % 7 <> 0 group by lang""")
def experiment_means(spark, sf_dir):
    """Means by group without the rows that a cache answered."""
    return table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count(F.lit(1)).alias("n"))


@query("select p_brand as type, md5(string_agg(p_partkey || ' ' || p_name, chr(10) order by p_partkey)) as digest from part group by 1")
def grouped_index_context(spark, sf_dir):
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name")
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("type")).agg(F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("digest"))


@query("""select 'union' as op, count(*) as n from (select o_custkey from orders union select c_custkey from customer)
union all select 'intersect', count(*) from (select o_custkey from orders intersect select c_custkey from customer)
union all select 'except', count(*) from (select c_custkey from customer except select o_custkey from orders)
union all select 'union_all', count(*) from (select o_custkey from orders union all select c_custkey from customer)""")
def set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    out = None
    for name, rows in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", b.exceptAll(a.distinct()).distinct()), ("union_all", a.unionAll(b))):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("select o_orderkey, array_to_string(list_sort(list_filter(['a', case when o_orderkey % 2 = 0 then 'b' else 'c' end], lambda x: x <> 'a' or o_orderkey % 3 <> 0)), ',') as added from orders")
def added_difference(spark, sf_dir):
    both = F.array(F.lit("a"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("b")).otherwise(F.lit("c")))
    have = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_except(both, have)), ",").alias("added"))


@query("select event_id, case when event_id % 3 = 0 then 'doc/' || user_id when event_id % 3 = 1 then 'rel/' || event_type || '.md' else 'file' end as path from events")
def hit_source_path(spark, sf_dir):
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("doc/"), F.col("user_id").cast("string")))
    chunk = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("rel/"), F.col("event_type"), F.lit(".md-chunk-"), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    return table(spark, sf_dir, "events").select("event_id", retrieval.source_path(doc, chunk, F.lit("file")).alias("path"))


@query("""with e as (select ts as t0 from events where event_type = 'error'), g as (select t0, t0 > lag(t0) over (order by t0) + interval 15 minutes as new from e),
i as (select t0, sum(case when coalesce(new, true) then 1 else 0 end) over (order by t0 rows unbounded preceding) as island from g)
select epoch_us(min(t0)) as start, epoch_us(max(t0) + interval 15 minutes) as end_ from i group by island""")
def queue_pauses(spark, sf_dir):
    """When nothing was taken, after usage limits."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("at"))
    return state.pauses(rows).select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_"))


@query("""select doc_id, case when doc_id % 4 = 0 then 'new' else sha256(text) end as hash from documents where doc_id % 3 = 0 or doc_id % 4 = 0""")
def cache_upsert(spark, sf_dir):
    """New entries take the place of old ones of their source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_path"), F.sha2("text", 256).alias("hash"))
    out = state.cache_put(docs.where("source_path % 3 = 0"), docs.where("source_path % 4 = 0").withColumn("hash", F.lit("new")))
    return out.select(F.col("source_path").alias("doc_id"), "hash")


@query("""select event_type || '::t' || event_id as id, case when event_id % 3 = 0 then 'resolved' else 'open' end as status, case when event_id % 3 = 0 then 'n' end as resolved_note from events""")
def review_resolve(spark, sf_dir):
    items = state.review_of(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.concat(F.lit(" Missing page: T"), F.col("event_id").cast("string")).alias("title")), "2030-01-02")
    answers = items.where("event_id % 3 = 0").select("id", F.lit("n").alias("note")).unionAll(spark.createDataFrame([("gone", "x")], "id string, note string"))
    return state.resolved(items, answers)[0].select("id", "status", "resolved_note")


@query(_FOLD + """select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'processing') as processing, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed,
count(*) filter (status = 'cancelled') as cancelled, count(*) as total, (select count(*) from documents where doc_id not in (select doc_id from labels)) as uncompiled, (select count(*) from events where event_id % 3 <> 0) as open_reviews from t""")
def manager_status(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l"))
    materials = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select(F.coalesce("l", F.lit(False)).alias("compiled"))
    reviews = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.lit("resolved")).otherwise(F.lit("open")).alias("status"))
    return state.status(state.task_states(task_events(spark, sf_dir)), materials, reviews)


@query("select doc_id from documents where doc_id % 2 = 0 and doc_id % 5 <> 0")
def checkpoint_match(spark, sf_dir):
    """Checkpoints count only with the parameters that are wanted now."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    kept = docs.where("doc_id % 2 = 0").select("doc_id", "hash", F.when(F.col("doc_id") % 5 == 0, F.lit(900)).otherwise(F.lit(1200)).alias("target"), F.lit(None).cast("int").alias("total"))
    wanted = docs.select("doc_id", "hash", F.lit(1200).alias("target"), F.lit(None).cast("int").alias("total"))
    return state.checkpoints_that_fit(kept, wanted, ["doc_id", "hash", "target", "total"]).select("doc_id")
