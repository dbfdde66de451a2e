"""The jobs as queries: each runs twice into a folder of its own, and gives what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import index_documents, ingest_materials
from lorewright.functions.windows import windows_sql
from lorewright.plans.lineage import shared_dir
from lorewright.plans.text_queries import _strip


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_ingest_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken into materials by a stream, and once more, which takes nothing."""
    folder = _folder(spark, "job1")
    for _ in range(2):
        # A pattern: a stream takes a folder or one, and the table may be a single file.
        ingest_materials.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/materials", f"{folder}/checkpoint")
    return ingest_materials.output(spark, f"{folder}/materials")


_TITLE = "list_filter(list_transform(string_split(content, chr(10)), lambda x: " + _strip("x") + "), lambda x: x <> '' and not regexp_matches(x, '^[#|]'))[1]"
JOB1_SQL = f"""
with b as (select doc_id, source, coalesce({_strip('text')}, '') as content from documents),
h as (select *, sha256(content) as hash, case when not coalesce(regexp_full_match(source, 'src[0-9]+'), false) then 'unknown source' when content = '' then 'empty' end as why from b),
f as (select *, min(doc_id) over (partition by hash, why) as first, coalesce({_TITLE}, '') as t from h)
select doc_id, source, hash, case when ok then left(sha1(content), 12) end as id, case when ok then case when length(t) > 80 then left(t, 79) || '…' else t end end as title, case when ok then content end as content,
  case when why is null and not ok then first end as of, 0 as batch, coalesce(why, case when ok then 'accepted' else 'duplicate' end) as fate
from (select *, why is null and doc_id = first as ok from f)
"""


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk index of the documents, brought up to date twice."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index")
    return index_documents.output(spark, f"{folder}/index")


_PIECES, _WINDOWS = windows_sql("text", index_documents.OPTIONS["size"], index_documents.OPTIONS["overlap"])
JOB2_SQL = f"""
with d as (select doc_id, sha256(coalesce(text, '')) as sha256, {_PIECES} as p from documents),
w as (select doc_id, sha256, len(ws) as n_chunks, case when len(ws) > 0 then ws else [null] end as ws from (select doc_id, sha256, {_WINDOWS} as ws from d)),
x as (select doc_id, sha256, n_chunks, unnest(ws) as w from w)
select doc_id, sha256, cast(n_chunks as integer) as n_chunks, cast(w['index'] as integer) as chunk, cast(w.tokens as integer) as tokens, w.main as content,
  cast(cast('0x' || left(md5(cast(doc_id as varchar)), 8) as bigint) % {index_documents.OPTIONS["buckets"]} as integer) as bucket
from x
"""

QUERIES = {f.__name__: f for f in (job1_ingest_materials, job2_index_documents)}
ORACLES = {"job1_ingest_materials": JOB1_SQL, "job2_index_documents": JOB2_SQL}
