"""Admission and job queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.catalog import views as V
from lorewell.operators import admission as A

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


SIZE_LIMIT = 4096


@query
def validate_files(spark, d):
    return A.validate_files(V.uploads(spark, d), max_bytes=SIZE_LIMIT).select(
        "arrival", "filename", "extension", "error"
    )


_BASE = r"regexp_extract(filename, '([^/]*)\z', 1)"
_RAW_EXT = rf"regexp_extract({_BASE}, '(?s)\A\.*[^.].*(\.[^.]*)\z', 1)"
_LISTED = str(K.ALLOWED_EXTENSIONS).replace("'", "''")
SQL["validate_files"] = V.with_views(
    "v_uploads",
    rf"""SELECT arrival, filename, lower({_RAW_EXT}) AS extension,
  CASE WHEN lower({_RAW_EXT}) NOT IN ('.pdf','.docx','.txt','.md','.json','.csv')
       THEN 'Extensión no permitida: ' || {_RAW_EXT} || '. Permitidas: {_LISTED}'
       WHEN length > {SIZE_LIMIT} THEN 'El archivo excede el tamaño máximo de {SIZE_LIMIT / 1048576}MB' END AS error
FROM v_uploads""",
)


@query
def content_hash(spark, d):
    docs = V.table(spark, d, "documents")
    empty = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text"))
    return docs.select("doc_id", A.content_hash(empty).alias("file_hash"))


SQL["content_hash"] = """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND length(text) > 0 THEN sha256(text) END AS file_hash
FROM documents"""


@query
def dedup_decision(spark, d):
    return A.dedup_decision(V.uploads(spark, d), V.jobs(spark, d)).select(
        "arrival", "user_id", "file_hash", "decision", "doc_id"
    )


_DEDUP_SQL = """
best AS (SELECT * FROM (
  SELECT file_hash, user_id, doc_id AS old_id,
    CASE WHEN status IN ('queued','processing','succeeded') THEN 0
         WHEN status IN ('failed','dead','deleted') THEN 1 ELSE 2 END AS p,
    row_number() OVER (PARTITION BY file_hash, user_id ORDER BY
      CASE WHEN status IN ('queued','processing','succeeded') THEN 0
           WHEN status IN ('failed','dead','deleted') THEN 1 ELSE 2 END, created_at, doc_id) AS rn
  FROM v_jobs WHERE file_hash IS NOT NULL) WHERE rn = 1),
firsts AS (SELECT file_hash, user_id, min(arrival) AS arrival, arg_min(new_doc_id, arrival) AS first_id
  FROM v_uploads WHERE file_hash IS NOT NULL GROUP BY file_hash, user_id),
decided AS (SELECT u.*,
  CASE WHEN b.p = 0 THEN 'already_exists' WHEN f.arrival IS NULL OR f.arrival = u.arrival THEN 'queued'
       ELSE 'already_exists' END AS decision,
  CASE WHEN b.p < 2 THEN b.old_id WHEN f.arrival IS NULL OR f.arrival = u.arrival THEN u.new_doc_id
       ELSE f.first_id END AS doc_id
  FROM v_uploads u
  LEFT JOIN firsts f ON u.file_hash = f.file_hash AND u.user_id IS NOT DISTINCT FROM f.user_id
  LEFT JOIN best b ON u.file_hash = b.file_hash AND u.user_id IS NOT DISTINCT FROM b.user_id)
"""
SQL["dedup_decision"] = V.with_views(
    "v_jobs v_uploads", f"WITH {_DEDUP_SQL} SELECT arrival, user_id, file_hash, decision, doc_id FROM decided"
)


def _with_metadata(jobs):
    return jobs.withColumn("metadata", F.create_map(F.lit("filename"), F.col("source_path")))


@query
def register_jobs(spark, d):
    stored = _with_metadata(V.jobs(spark, d)).drop("length")
    decided = A.dedup_decision(V.uploads(spark, d), V.jobs(spark, d)).filter(F.col("decision") == "queued")
    caller = F.create_map(F.lit("content_type"), F.lit("text/plain"), F.lit("filename"), F.upper("filename"))
    new = decided.select(
        "doc_id", "user_id", "batch_id", F.col("filename").alias("source_path"), "file_hash",
        V.micros(F.lit(V.EPOCH_2024) + F.col("arrival") * V.HOUR).alias("uploaded_at"),
        F.when(F.col("arrival") % 2 == 0, caller).alias("metadata"),
    )
    return A.register_jobs(stored, new).select(
        "doc_id", "user_id", "batch_id", "source_path", "status", "attempts", "error_msg", "created_at", "file_hash",
        *[F.col("metadata")[k].alias(f"meta_{k}") for k in ("filename", "user_id", "uploaded_at", "content_type")],
    )


SQL["register_jobs"] = V.with_views(
    "v_jobs v_uploads",
    f"""WITH {_DEDUP_SQL},
fresh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY arrival) AS rn,
    make_timestamp({V.EPOCH_2024} + arrival * {V.HOUR}) AS uploaded_at
  FROM decided WHERE decision = 'queued' AND doc_id NOT IN (SELECT doc_id FROM v_jobs))
SELECT doc_id, user_id, batch_id, source_path, status, CAST(attempts AS BIGINT) AS attempts, error_msg, created_at, file_hash,
  source_path AS meta_filename, CAST(NULL AS VARCHAR) AS meta_user_id, CAST(NULL AS VARCHAR) AS meta_uploaded_at,
  CAST(NULL AS VARCHAR) AS meta_content_type FROM v_jobs
UNION ALL
SELECT doc_id, user_id, batch_id, filename, 'received', 0, NULL, uploaded_at, file_hash,
  CASE WHEN arrival % 2 = 0 THEN upper(filename) ELSE filename END, user_id,
  strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S'), CASE WHEN arrival % 2 = 0 THEN 'text/plain' END
FROM fresh WHERE rn = 1""",
)


@query
def fold_status(spark, d):
    known = V.table(spark, d, "labels").select("doc_id")
    return A.fold_status(V.job_events(spark, d), known)


SQL["fold_status"] = V.with_views(
    "v_job_events",
    """SELECT e.doc_id, arg_max(status, (ts, seq)) AS status,
  arg_max(struct_pack(m := error_msg), (ts, seq)).m AS error_msg,
  count(*) FILTER (WHERE status = 'failed') AS attempts, max(ts) AS updated_at
FROM v_job_events e WHERE e.doc_id IN (SELECT doc_id FROM labels) GROUP BY e.doc_id""",
)


def _requested(spark, d):
    """Ids asked for: known ones (plain, upper case, undashed), unknown ones and broken ones."""
    n = F.col("doc_id")
    known = V.uuid_text(n.cast("string"))
    asked = (
        F.when(n % 5 == 0, F.upper(known))
        .when(n % 5 == 1, F.regexp_replace(known, "-", ""))
        .when(n % 5 == 2, V.uuid_text(F.concat(F.lit("x"), n.cast("string"))))
        .when(n % 5 == 3, n.cast("string"))
        .otherwise(known)
    )
    return V.table(spark, d, "documents").select(asked.alias("doc_id"))


@query
def job_lookup(spark, d):
    return A.job_lookup(_requested(spark, d), V.jobs(spark, d))


_UUID_RE = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
SQL["job_lookup"] = V.with_views(
    "v_jobs",
    f"""WITH asked AS (SELECT CASE doc_id % 5 WHEN 0 THEN upper({V.sql_uuid("CAST(doc_id AS VARCHAR)")})
    WHEN 1 THEN replace({V.sql_uuid("CAST(doc_id AS VARCHAR)")}, '-', '')
    WHEN 2 THEN {V.sql_uuid("'x' || doc_id")} WHEN 3 THEN CAST(doc_id AS VARCHAR)
    ELSE {V.sql_uuid("CAST(doc_id AS VARCHAR)")} END AS requested_id FROM documents),
parsed AS (SELECT requested_id, CASE WHEN regexp_matches(requested_id, '{_UUID_RE}')
    THEN CAST(CAST(requested_id AS UUID) AS VARCHAR) END AS doc_id FROM asked)
SELECT p.requested_id, CASE WHEN p.doc_id IS NULL THEN 'invalid' WHEN j.doc_id IS NULL THEN 'not found' ELSE 'ok' END AS answer,
  p.doc_id, j.user_id, j.batch_id, j.status, j.attempts, j.error_msg, j.created_at
FROM parsed p LEFT JOIN v_jobs j ON p.doc_id = j.doc_id""",
)


@query
def list_user_documents(spark, d):
    return A.list_user_documents(V.jobs(spark, d))


SQL["list_user_documents"] = V.with_views(
    "v_jobs",
    """SELECT user_id, doc_id, source_path, status, created_at, file_hash, count(*) OVER (PARTITION BY user_id) AS total
FROM v_jobs WHERE user_id IS NOT NULL ORDER BY user_id, created_at DESC, doc_id""",
)


@query
def batch_outcome(spark, d):
    return A.batch_outcome(A.validate_files(V.uploads(spark, d), max_bytes=SIZE_LIMIT))


SQL["batch_outcome"] = V.with_views(
    "v_uploads",
    rf"""WITH checked AS (SELECT batch_id, lower({_RAW_EXT}) NOT IN ('.pdf','.docx','.txt','.md','.json','.csv')
   OR length > {SIZE_LIMIT} AS bad FROM v_uploads),
n AS (SELECT batch_id, count(*) FILTER (WHERE NOT bad) AS processed, count(*) FILTER (WHERE bad) AS errors
  FROM checked GROUP BY batch_id)
SELECT *, CASE WHEN errors > 0 AND processed > 0 THEN 'partial_success' WHEN errors = 0 THEN 'success' ELSE 'failed' END AS status
FROM n""",
)


@query
def batch_progress(spark, d):
    return A.batch_progress(V.jobs(spark, d))


SQL["batch_progress"] = V.with_views(
    "v_jobs",
    """SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status IN ('indexed','succeeded')) AS done,
  count(*) FILTER (WHERE status IN ('failed','dead')) AS failed FROM v_jobs GROUP BY batch_id""",
)


@query
def classify_failures(spark, d):
    kinds = ["ConnectionError", "TimeoutError", "transient", "FileNotFound", "ValueError", "permanent", "KeyError"]
    k = V.prop_k()
    failures = V.table(spark, d, "events").select(
        "event_id", V.pick(kinds, k % 7).alias("error_type"),
        F.concat(F.lit("failed "), "event_type").alias("error_msg"), (k % 7).alias("retries"),
    ).withColumn("retries", (F.col("event_id") % 8))
    return A.classify_failures(failures)


SQL["classify_failures"] = f"""WITH f AS (SELECT event_id,
  ['ConnectionError','TimeoutError','transient','FileNotFound','ValueError','permanent','KeyError'][({V.SQL_K} % 7) + 1] AS error_type,
  'failed ' || event_type AS error_msg, event_id % 8 AS retries FROM events),
g AS (SELECT *, error_type IN ('ConnectionError','TimeoutError','transient') AS t,
   error_type IN ('FileNotFound','ValueError','permanent') AS p FROM f)
SELECT event_id, error_type, error_msg, retries, CASE WHEN t THEN 'failed' ELSE 'dead' END AS next_status,
  CASE WHEN t THEN error_msg WHEN p THEN 'PERMANENT_ERROR: ' || error_msg ELSE 'UNEXPECTED_ERROR: ' || error_msg END AS message,
  t AND retries < 5 AS will_retry, CASE WHEN t AND retries < 5 THEN 60 * CAST(pow(2, retries) AS BIGINT) END AS delay_seconds
FROM g"""


@query
def dead_letter_health(spark, d):
    return A.dead_letter_health(V.jobs(spark, d).filter(F.col("status") == "dead"))


SQL["dead_letter_health"] = V.with_views(
    "v_jobs",
    """SELECT 'ingest_dlq' AS dlq_name, count(*) AS message_count, CASE WHEN count(*) > 10 THEN 'warning' ELSE 'ok' END AS status
FROM v_jobs WHERE status = 'dead'""",
)


@query
def object_path(spark, d):
    j = V.jobs(spark, d)
    explicit = F.when(F.col("attempts") == 2, F.col("source_path"))
    return j.select(
        "doc_id",
        A.object_path(F.col("user_id"), F.col("doc_id"), explicit).alias("path"),
        A.download_path(
            F.when(F.col("attempts") == 1, F.concat(F.lit("a/"), "source_path")).otherwise(F.col("source_path")),
            F.col("user_id"),
        ).alias("download"),
    )


SQL["object_path"] = V.with_views(
    "v_jobs",
    """SELECT doc_id, CASE WHEN attempts = 2 THEN source_path WHEN coalesce(user_id, '') <> '' THEN user_id || '/' || doc_id ELSE doc_id END AS path,
  CASE WHEN attempts = 1 THEN 'a/' || source_path WHEN coalesce(user_id, '') <> '' THEN user_id || '/' || source_path ELSE source_path END AS download
FROM v_jobs""",
)
