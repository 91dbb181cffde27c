"""Index maintenance queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.catalog import views as V
from lorewell.operators import indexing as I

QUERIES = {}
SQL = {}
AS_OF = "2026-01-01 00:00:00"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def chunk_key(spark, d):
    return V.lines(spark, d).select(
        "doc_id", "pos", I.chunk_key(F.col("content"), F.col("doc_id").cast("string"), F.col("pos")).alias("chunk_key")
    )


SQL["chunk_key"] = V.with_views(
    "v_lines", "SELECT doc_id, pos, sha256(content || chr(31) || doc_id || chr(31) || pos) AS chunk_key FROM v_lines"
)


@query
def incremental_index(spark, d):
    return I.index_diff(V.index_incoming(spark, d), V.index_current(spark, d))


_DIFF = """diff AS (SELECT coalesce(n.chunk_key, o.chunk_key) AS chunk_key, coalesce(n.source, o.source) AS source,
  CASE WHEN n.chunk_key IS NOT NULL AND o.chunk_key IS NOT NULL THEN 'skipped' WHEN n.chunk_key IS NOT NULL THEN 'added'
    WHEN o.source IN (SELECT source FROM v_index_incoming) THEN 'deleted' ELSE 'untouched' END AS op
  FROM (SELECT DISTINCT chunk_key, source FROM v_index_incoming) n FULL JOIN v_index_current o ON n.chunk_key = o.chunk_key)"""
SQL["incremental_index"] = V.with_views("v_index_incoming v_index_current", f"WITH {_DIFF} SELECT * FROM diff")


@query
def incremental_index_counts(spark, d):
    return I.diff_counts(I.index_diff(V.index_incoming(spark, d), V.index_current(spark, d)))


SQL["incremental_index_counts"] = V.with_views(
    "v_index_incoming v_index_current",
    f"""WITH {_DIFF} SELECT count(*) FILTER (WHERE op = 'added') AS num_added,
  count(*) FILTER (WHERE op = 'skipped') AS num_skipped, count(*) FILTER (WHERE op = 'deleted') AS num_deleted FROM diff""",
)


@query
def incremental_index_result(spark, d):
    """The index after the batch; its chunk keys and contents."""
    incoming, current = V.index_incoming(spark, d), V.index_current(spark, d)
    return I.apply_diff(incoming, current, I.index_diff(incoming, current))


SQL["incremental_index_result"] = V.with_views(
    "v_index_incoming v_index_current",
    """SELECT source, chunk_index, content, chunk_key FROM v_index_incoming
UNION ALL SELECT source, chunk_index, content, chunk_key FROM v_index_current
WHERE source NOT IN (SELECT source FROM v_index_incoming)""",
)


def _updates(spark, d):
    """One batch of parallel lists per incoming source; every fifth batch names no groups."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("bigint")
    grouped = V.index_incoming(spark, d).groupBy("source").agg(
        F.array_sort(F.collect_list("chunk_key")).alias("keys")
    )
    batches = grouped.select(
        F.lit("main").alias("namespace"), "keys",
        F.when(number % 5 != 0, F.transform("keys", lambda k: F.col("source"))).alias("group_ids"),
        F.lit(100.0).alias("now"),
        F.when(number % 3 == 0, F.lit(250.0)).when(number % 3 == 1, F.lit(50.0)).alias("time_at_least"),
    )
    return I.record_rows(batches)


@query
def upsert_records(spark, d):
    return I.upsert_records(V.records(spark, d), _updates(spark, d))


SQL["upsert_records"] = V.with_views(
    "v_records v_index_incoming",
    """WITH u AS (SELECT chunk_key AS key, source, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS n FROM v_index_incoming),
updates AS (SELECT key, 'main' AS namespace, CASE WHEN n % 5 <> 0 THEN source END AS group_id,
  CASE WHEN n % 3 = 0 THEN 250.0::DOUBLE ELSE 100.0::DOUBLE END AS updated_at FROM u)
SELECT * FROM updates UNION ALL SELECT * FROM v_records WHERE key NOT IN (SELECT key FROM updates)""",
)


@query
def keys_by_group(spark, d):
    groups = V.table(spark, d, "conversations").filter(F.col("role") == "system").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("group_id")
    )
    return I.keys_by_group(V.records(spark, d), groups)


SQL["keys_by_group"] = V.with_views(
    "v_records",
    "SELECT key FROM v_records WHERE group_id IN (SELECT 'c' || conv_id FROM conversations WHERE role = 'system')",
)


def _doomed(spark, d):
    """Documents to delete: the threads with a system row, and labelled documents that were never indexed."""
    conv = V.table(spark, d, "conversations").filter(F.col("role") == "system")
    return conv.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id")).unionByName(
        V.table(spark, d, "labels").select(F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("doc_id"))
    )


_DOOMED = """doomed AS (SELECT 'c' || conv_id AS doc_id FROM conversations WHERE role = 'system'
  UNION SELECT 'l' || doc_id FROM labels)"""


def _rows(deletion):
    """The three tables of a deletion in one result."""
    none = F.lit(None).cast("string")
    return (
        deletion.chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_key").alias("id"), none.alias("status"))
        .unionByName(deletion.records.select(F.lit("record").alias("kind"), F.col("key").alias("id"), none.alias("status")))
        .unionByName(deletion.events.select(F.lit("event").alias("kind"), F.col("doc_id").alias("id"), "status"))
    )


@query
def delete_documents(spark, d):
    as_of = F.lit(AS_OF).cast("timestamp")
    return _rows(I.delete_documents(_doomed(spark, d), V.index_current(spark, d), V.records(spark, d), as_of))


_DELETED = """SELECT 'chunk' AS kind, chunk_key AS id, CAST(NULL AS VARCHAR) AS status FROM v_index_current WHERE source NOT IN (SELECT doc_id FROM {ids})
UNION ALL SELECT 'record', key, NULL FROM v_records WHERE group_id NOT IN (SELECT doc_id FROM {ids})
UNION ALL SELECT 'event', doc_id, unnest(['deleting', 'deleted']) FROM {ids}"""
SQL["delete_documents"] = V.with_views(
    "v_index_current v_records", f"WITH {_DOOMED} " + _DELETED.format(ids="doomed")
)


@query
def wipe_documents(spark, d):
    """Ids ending in 7 are protected here."""
    as_of = F.lit(AS_OF).cast("timestamp")
    return _rows(I.wipe_documents(_doomed(spark, d), V.index_current(spark, d), V.records(spark, d), as_of, "7"))


SQL["wipe_documents"] = V.with_views(
    "v_index_current v_records",
    f"WITH {_DOOMED}, open_ids AS (SELECT doc_id FROM doomed WHERE NOT contains(doc_id, '7')) "
    + _DELETED.format(ids="open_ids"),
)


@query
def list_document_chunks(spark, d):
    return I.list_document_chunks(V.index_current(spark, d), V.records(spark, d), _doomed(spark, d)).select(
        "doc_id", "chunk_index", "chunk_key", "content", "total_chunks"
    )


SQL["list_document_chunks"] = V.with_views(
    "v_index_current",
    f"""WITH {_DOOMED} SELECT source AS doc_id, chunk_index, chunk_key, content, count(*) OVER (PARTITION BY source) AS total_chunks
FROM v_index_current WHERE source IN (SELECT doc_id FROM doomed) ORDER BY 1, 2""",
)


@query
def embed_chunks(spark, d):
    """Every document embedded with hashed tf-idf."""
    docs = V.documents(spark, d).select("doc_id", F.col("text").alias("content"))
    return I.embed(docs, I.fit_embedder(docs)).select("doc_id", "embedding")


CACHE_NOW = 1_000_000.5


@query
def cache_lookup(spark, d):
    """Documents ask for the cached value of their text; labels wrote it at various times."""
    as_of = F.lit(CACHE_NOW)
    written = V.table(spark, d, "labels").select(
        F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("cache_key"),
        F.concat(F.lit("v"), F.col("quality").cast("string")).alias("value"),
        (as_of - 3600 + F.col("doc_id") % 3 - 1).alias("put_at"),
    )
    cache = I.cache_put(written, F.col("put_at"))
    asked = V.table(spark, d, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("cache_key"))
    return I.cache_lookup(asked, cache, as_of).select("cache_key", "hit", "value")


SQL["cache_lookup"] = f"""WITH cache AS (SELECT 'k' || doc_id AS cache_key, 'v' || quality AS value,
  CAST(floor({CACHE_NOW} - 3600 + doc_id % 3 - 1) AS BIGINT) + 3600 AS expires_at FROM labels)
SELECT 'k' || d.doc_id AS cache_key, c.cache_key IS NOT NULL AS hit, c.value FROM documents d
LEFT JOIN cache c ON c.cache_key = 'k' || d.doc_id AND expires_at >= floor({CACHE_NOW})"""
