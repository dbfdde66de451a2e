"""Queries of this subpackage, and DuckDB equivalents where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, decontaminate, packing, quality, ranked, runtime, sharding, simhash, sstable, substring, toolcalls, warc

END_ID, PACK_END_ID = 2, 1
SHARDS = 40
WINDOW = 13


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written, and found again through the index by the pages' URLs."""
    pages = runtime.documents(spark, sf_dir, "pages")
    manifest = warc.write_archives(pages, runtime.fresh_dir(spark, "warc"))
    out = warc.read_captures(pages, manifest, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near it is to that and to the next text."""
    out = chunks.edited_and_next(runtime.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


TOOLS = {
    "search": {"properties": {"query": "string", "limit": "integer"}, "required": ["limit", "query"]},
    "translate": {"properties": {"text": "string", "to.lang": "string"}, "required": ["text", "to.lang"]},
}


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as a call, every other turn as a result of the turn before.

    The table has no calls, so tool and arguments follow from conversation and
    turn: every third call names a tool without a schema, some lack an argument,
    give it another type or have no identifier.  A call needs those of two and
    four turns before; identifiers repeat in all conversations.
    """
    turns = runtime.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    kind, case = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    body = toolcalls.json_string(F.col("text"))
    limit = F.when(case == 0, F.lit('"9"')).when(case == 3, F.concat(F.col("turn").cast("string"), F.lit(".50e1"))).otherwise(F.concat(F.col("turn").cast("string"), F.lit(".0")))
    arguments = (
        F.when((kind == 0) & (case == 1), F.concat(F.lit('{"query": '), body, F.lit("}")))
        .when(kind == 0, F.concat(F.lit('{"query": '), body, F.lit(', "limit": '), limit, F.lit("}")))
        .when((kind == 1) & (case == 2), F.lit("{broken"))
        .otherwise(F.concat(F.lit('{"to.lang": "en", "text": '), body, F.lit("}")))
    )
    name = F.when(kind == 0, F.lit("search")).when(kind == 1, F.lit("translate")).otherwise(F.lit("run"))
    own = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) != 5, call_id(F.col("turn")))
    needs = F.filter(F.array(*(F.when(F.col("turn") >= k, call_id(F.col("turn") - k)) for k in (2, 4))), lambda x: x.isNotNull())
    calls = turns.where("role = 'assistant'").select("conv_id", own.alias("call_id"), F.col("turn").alias("seq"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = turns.where("role <> 'assistant' and turn > 0").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    out = toolcalls.link_calls(calls, results, TOOLS)
    return out.select("conv_id", "call_id", "seq", "level", "name", "n_results", F.array_join("errors", ",").alias("errors"), F.sha2("canonical", 256).alias("canonical_sha256"))


OP3_SQL = """
with recursive calls as (
  select conv_id, turn, case when (conv_id + turn) % 11 <> 5 then 'call_' || turn end as call_id, text, (conv_id + turn) % 3 as kind, (conv_id + turn) % 5 as kase,
    row_number() over (order by conv_id, turn) as n
  from conversations where role = 'assistant'
), needs as (
  select c.conv_id, c.turn, c.turn - k as need, p.conv_id is not null as known
  from calls c, (select unnest([2, 4]) as k) left join calls p on p.conv_id = c.conv_id and p.turn = c.turn - k and p.call_id is not null
  where c.turn >= k and c.call_id is not null
), paths as (
  select conv_id, turn, cast(0 as bigint) as level from calls where call_id is not null
  union
  select n.conv_id, n.turn, p.level + 1 from paths p join needs n on n.conv_id = p.conv_id and n.need = p.turn and n.known
), lev as (select conv_id, turn, max(level) as level from paths group by all),
lost as (select distinct conv_id, turn from needs where not known),
res as (
  select conv_id, 'call_' || turn - 1 as call_id, count(*) as n_results, min(turn) as turn, min(text) as result from conversations
  where role <> 'assistant' and turn > 0 group by conv_id, turn - 1
), met as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as seq, c.n is not null as is_call, c.turn, c.text, kind, kase, l.level,
    coalesce(r.n_results, 0) as n_results, r.result, lost.turn is not null as is_lost
  from calls c full join res r on r.conv_id = c.conv_id and r.call_id = c.call_id
  left join lev l on l.conv_id = c.conv_id and l.turn = c.turn and c.call_id is not null left join lost on lost.conv_id = c.conv_id and lost.turn = c.turn
), said as (
  select *, case kind when 0 then 'search' when 1 then 'translate' when 2 then 'run' end as name,
    case when not is_call or kind = 1 and kase = 2 then null
      when kind = 0 and kase = 1 then '{"query":' || coalesce(cast(to_json(text) as varchar), 'null') || '}'
      when kind = 0 then '{"limit":' || case kase when 0 then '"9"' when 3 then cast(10 * turn + 5 as varchar) else cast(turn as varchar) end || ',"query":' || coalesce(cast(to_json(text) as varchar), 'null') || '}'
      else '{"text":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"to.lang":"en"}' end as args,
    list_sort(list_filter([
      case when kind = 2 then 'unknown tool: run' end,
      case when kind = 0 and kase = 1 then 'missing: limit' end,
      case when kind = 0 and text is null then 'missing: query' end,
      case when kind = 0 and kase = 0 then 'not integer: limit' end,
      case when kind = 1 and kase = 2 then 'not JSON' when kind = 1 and text is null then 'missing: text' end,
      case when not is_call then 'no call' when n_results = 0 then 'no result' end,
      case when call_id is null then 'no id' end,
      case when is_lost then 'unknown need' end], lambda x: x is not null)) as errors
  from met
)
select conv_id, call_id, seq, level, name, n_results, array_to_string(errors, ',') as errors,
  sha256('{"arguments":' || coalesce(args, 'null') || ',"errors":' || cast(to_json(errors) as varchar) || ',"id":' || coalesce('"' || call_id || '"', 'null')
    || ',"level":' || coalesce(cast(level as varchar), 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(cast(to_json(result) as varchar), 'null') || '}') as canonical_sha256
from said
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of 13-word windows that a smaller doc_id has."""
    out = substring.remove_repeats(runtime.documents(spark, sf_dir).select("doc_id", "text"), WINDOW)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark that each text shares in windows of 13 words."""
    docs = runtime.documents(spark, sf_dir).select("doc_id", "text")
    out = decontaminate.find_contamination(docs, runtime.documents(spark, sf_dir, "benchmark"), WINDOW)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written as tables and read back."""
    docs = runtime.documents(spark, sf_dir).select("doc_id", "text")
    folder = runtime.fresh_dir(spark, "tables")
    manifest = sstable.write_tables(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, folder)
    out = sstable.read_tables(manifest)
    return out.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text that they decode to."""
    out = bpe.encode_texts(runtime.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, rates of host (``source``) and path (``lang``) and the verdict on every document."""
    out = quality.classify(runtime.documents(spark, sf_dir), runtime.documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "evidence", "host_rate", "site_rate", "p_bad", "keep")


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard if there were one more."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = runtime.documents(spark, sf_dir).select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    out = sharding.assign_shards(rows, "doc_id", SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(runtime.documents(spark, sf_dir), words_each=3, bits=3)


def op11_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with the highest scores for every benchmark item."""
    index = ranked.build_index(runtime.documents(spark, sf_dir).select("doc_id", "text"))
    return ranked.search(index, runtime.documents(spark, sf_dir, "benchmark"), k=20)


def op12_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every text lie in sequences of 2048."""
    out = packing.pack(runtime.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), PACK_END_ID, packing.SEQUENCE)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP4_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from w, unnest(range(1, len(ws) - 11)) as t(i)),
f as (select k, min(doc_id) as first from win group by k),
cov as (select distinct doc_id, unnest(range(i, i + 13)) as pos from win join f using (k) where first < doc_id),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as pos, unnest(ws) as word from w)
select w.doc_id, count(words.pos) as n_words, count(cov.pos) as n_removed, sha256(coalesce(string_agg(word, ' ' order by words.pos) filter (where cov.pos is null), '')) as kept_sha256
from w left join words on words.doc_id = w.doc_id left join cov on cov.doc_id = words.doc_id and cov.pos = words.pos group by w.doc_id
"""

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
with b as (select item_id, {_WORDS_SQL} as ws from benchmark), d as (select doc_id, {_WORDS_SQL} as ws from documents),
pat as (select distinct item_id, least(13, len(ws)) as n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as k from b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as t(i) where len(ws) > 0),
win as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as k from d, (select distinct n from pat), unnest(range(1, len(ws) - n + 2)) as t(i)),
occ as (select doc_id, i, n, item_id from win join pat using (n, k)),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as pos from occ) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from occ group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""

_TERMS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ranked.TERM_PATTERN}')"
OP11_SQL = f"""
with d as (select doc_id, {_TERMS_SQL} as ts from documents),
s as (select cast(count(*) as bigint) as docs, cast(sum(len(ts)) as bigint) as terms from d where len(ts) > 0),
i as (select item_id, term, count(*) as repeats from (select item_id, unnest({_TERMS_SQL}) as term from benchmark) group by all),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as term from d) where term in (select term from i) group by all),
w as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from p group by term), s),
r as (
  select item_id, doc_id, cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) as bigint) as score
  from p join w using (term) join i using (term), s group by item_id, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 20
"""

QUERIES = {f.__name__: f for f in (op1_warc_capture_index, op2_content_chunks, op3_tool_call_linking, op4_substring_dedup, op5_benchmark_decontamination, op6_sorted_string_tables, op7_prefix_bpe, op8_hierarchical_quality, op9_jump_sharding, op10_simhash_pigeonring, op11_max_tree_search, op12_cutting_stock)}
ORACLES: dict[str, str] = {op3_tool_call_linking.__name__: OP3_SQL, op4_substring_dedup.__name__: OP4_SQL, op5_benchmark_decontamination.__name__: OP5_SQL, op11_max_tree_search.__name__: OP11_SQL}
