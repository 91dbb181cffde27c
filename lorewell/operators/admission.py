"""Admission of files, duplicate decisions and the life of an ingestion job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions import text as T
from lorewell.operators.skew import lookup

UUID_PATTERN = r"\A[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\z"


def validate_files(
    files: DataFrame,
    name: str = "filename",
    size: str = "length",
    allowed: list[str] = K.ALLOWED_EXTENSIONS,
    max_bytes: int = K.MAX_FILE_BYTES,
) -> DataFrame:
    """Add `extension` and `error` (NULL when the file is admitted). One pass, no shuffle.

    A file without a name has no extension and is refused.
    """
    ext, named = F.col("extension"), F.coalesce(F.col(name), F.lit(""))
    listed = "[" + ", ".join(f"'{e}'" for e in allowed) + "]"
    limit_mb = max_bytes / (1024 * 1024)
    error = (
        F.when(
            ~ext.isin(allowed),
            F.concat(F.lit("Extensión no permitida: "), T.raw_extension(named), F.lit(f". Permitidas: {listed}")),
        )
        .when(F.col(size) > max_bytes, F.lit(f"El archivo excede el tamaño máximo de {limit_mb}MB"))
    )
    return files.withColumn("extension", T.file_extension(named)).withColumn("error", error)


def content_hash(content: Column) -> Column:
    """SHA-256 hex of the bytes; NULL for absent or empty content."""
    raw = content.cast("binary")
    return F.when(F.octet_length(raw) > 0, F.sha2(raw, 256))


def dedup_decision(
    uploads: DataFrame,
    jobs: DataFrame,
    skip_statuses: list[str] = K.SKIP_STATUSES,
    retry_statuses: list[str] = K.RETRY_STATUSES,
) -> DataFrame:
    """Decide for every upload (arrival, user_id, file_hash, new_doc_id) whether it is work or a repeat.

    Adds `decision` (`queued` / `already_exists`) and the effective `doc_id`. Both the stored job that
    answers a (hash, user) and the first upload of that pair come from aggregates, so a content that makes up
    a third of the batch never gathers in one task.
    """
    pair = ["file_hash", "user_id"]
    priority = (
        F.when(F.col("status").isin(skip_statuses), 0).when(F.col("status").isin(retry_statuses), 1).otherwise(2)
    )
    stored = (
        jobs.filter(F.col("file_hash").isNotNull())
        .select(*pair, priority.alias("priority"), "created_at", F.col("doc_id").alias("old_doc_id"))
        .groupBy(*pair)
        .agg(F.min(F.struct("priority", "created_at", "old_doc_id")).alias("old"))
    )
    first = (
        uploads.filter(F.col("file_hash").isNotNull())
        .groupBy(*pair)
        .agg(F.min(F.struct("arrival", "new_doc_id")).alias("first"))
    )
    facts = lookup(first, stored, pair)
    known = lookup(uploads, facts, pair)

    leads = F.col("first").isNull() | (F.col("first.arrival") == F.col("arrival"))
    old_rank = F.col("old.priority")
    decision = (
        F.when(old_rank == 0, "already_exists").when(leads, "queued").otherwise("already_exists")
    )
    doc_id = (
        F.when(old_rank < 2, F.col("old.old_doc_id"))
        .when(leads, F.col("new_doc_id"))
        .otherwise(F.col("first.new_doc_id"))
    )
    return known.withColumn("decision", decision).withColumn("doc_id", doc_id).drop("first", "old")


def register_jobs(jobs: DataFrame, new_jobs: DataFrame) -> DataFrame:
    """Append jobs whose doc_id is not there yet, with status `received`.

    `new_jobs`: doc_id, user_id, batch_id, source_path, file_hash, uploaded_at, metadata. The caller's
    metadata wins over the standard keys. Of several new rows with one doc_id the earliest is kept.
    """
    columns = [c for c in new_jobs.columns if c != "doc_id"]
    firsts = new_jobs.groupBy("doc_id").agg(
        F.min_by(F.struct(*columns), F.struct("uploaded_at", "source_path")).alias("n")
    )
    base = F.map_filter(
        F.create_map(
            F.lit("filename"), F.col("n.source_path"),
            F.lit("user_id"), F.col("n.user_id"),
            F.lit("uploaded_at"), F.date_format("n.uploaded_at", "yyyy-MM-dd'T'HH:mm:ss"),
        ),
        lambda k, v: v.isNotNull(),
    )
    caller = F.coalesce(F.col("n.metadata"), F.create_map().cast("map<string,string>"))
    rows = firsts.join(jobs.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id",
        F.col("n.user_id").alias("user_id"),
        F.col("n.batch_id").alias("batch_id"),
        F.col("n.source_path").alias("source_path"),
        F.lit("received").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("error_msg"),
        F.map_concat(base, caller).alias("metadata"),
        F.col("n.uploaded_at").alias("created_at"),
        F.col("n.uploaded_at").alias("updated_at"),
        F.col("n.file_hash").alias("file_hash"),
    )
    return jobs.unionByName(rows)


def fold_status(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Current status per known job from its append-only events (doc_id, status, error_msg, ts, seq).

    The latest event sets status and error (a NULL error clears the old one); every `failed` adds an attempt.
    """
    order = F.struct("ts", "seq")
    folded = events.groupBy("doc_id").agg(
        F.max_by(F.struct("status", "error_msg"), order).alias("last"),
        F.count_if(F.col("status") == "failed").alias("attempts"),
        F.max("ts").alias("updated_at"),
    )
    return folded.join(jobs.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "last.status", "last.error_msg", "attempts", "updated_at"
    )


def job_lookup(requested: DataFrame, jobs: DataFrame) -> DataFrame:
    """Answer a table of requested ids with seven job fields and an `answer` of ok / not found / invalid."""
    fields = ["user_id", "batch_id", "status", "attempts", "error_msg", "created_at"]
    # an id is compared in its canonical lower-case dashed form
    raw = F.lower(F.regexp_replace("doc_id", "-", ""))
    canonical = F.concat_ws(
        "-", *[F.substring(raw, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    valid = F.coalesce(F.rlike("doc_id", F.lit(UUID_PATTERN)), F.lit(False))
    asked = requested.select(F.col("doc_id").alias("requested_id"), F.when(valid, canonical).alias("doc_id"))
    known = jobs.select("doc_id", *fields, F.lit(True).alias("known"))
    joined = asked.join(known, "doc_id", "left")
    answer = (
        F.when(F.col("doc_id").isNull(), "invalid").when(F.col("known").isNull(), "not found").otherwise("ok")
    )
    return joined.select("requested_id", answer.alias("answer"), "doc_id", *fields)


def list_user_documents(jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Five job columns, newest first, with the user's total.

    With a `user_id` the filter reaches the scan; without one, the listing of every user comes back at once.
    """
    rows = jobs.filter(F.col("user_id").isNotNull()) if user_id is None else jobs.filter(F.col("user_id") == user_id)
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    listed = lookup(rows, totals, ["user_id"], "inner")
    return listed.select(
        "user_id", "doc_id", "source_path", "status", "created_at", "file_hash", "total"
    ).orderBy("user_id", F.col("created_at").desc(), "doc_id")


def batch_outcome(results: DataFrame) -> DataFrame:
    """Per batch: `success`, `partial_success` or `failed` from rows carrying an `error` or NULL."""
    counted = results.groupBy("batch_id").agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    status = (
        F.when((F.col("errors") > 0) & (F.col("processed") > 0), "partial_success")
        .when(F.col("errors") == 0, "success")
        .otherwise("failed")
    )
    return counted.withColumn("status", status)


def batch_status(jobs: DataFrame, batch_id: str) -> DataFrame:
    """The (doc_id, status) rows of one batch."""
    return jobs.filter(F.col("batch_id") == batch_id).select("doc_id", "status")


def batch_progress(jobs: DataFrame) -> DataFrame:
    """Per batch: total, done and failed job counts."""
    return (
        jobs.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status").isin("indexed", "succeeded")).alias("done"),
            F.count_if(F.col("status").isin("failed", "dead")).alias("failed"),
        )
    )


def classify_failures(failures: DataFrame) -> DataFrame:
    """Next status, message and retry delay for rows (error_type, error_msg, retries).

    Transient errors go to `failed` and are retried after 60, 120, ... seconds while retries remain.
    """
    transient = F.col("error_type").isin(K.TRANSIENT_ERRORS)
    permanent = F.col("error_type").isin(K.PERMANENT_ERRORS)
    again = transient & (F.col("retries") < K.MAX_TASK_RETRIES)
    message = (
        F.when(transient, F.col("error_msg"))
        .when(permanent, F.concat(F.lit("PERMANENT_ERROR: "), "error_msg"))
        .otherwise(F.concat(F.lit("UNEXPECTED_ERROR: "), "error_msg"))
    )
    delay = F.lit(K.RETRY_BASE_SECONDS) * F.pow(F.lit(2.0), F.col("retries")).cast("bigint")
    return (
        failures.withColumn("next_status", F.when(transient, "failed").otherwise("dead"))
        .withColumn("message", message)
        .withColumn("will_retry", again)
        .withColumn("delay_seconds", F.when(again, delay))
    )


def dead_letter_health(dead: DataFrame, queue: str = "ingest_dlq", warn_over: int = K.DEAD_LETTER_WARNING) -> DataFrame:
    """Number of dead letters and `warning` when there are more than `warn_over`."""
    return dead.agg(F.count("*").alias("message_count")).select(
        F.lit(queue).alias("dlq_name"),
        "message_count",
        F.when(F.col("message_count") > warn_over, "warning").otherwise("ok").alias("status"),
    )


def object_path(user_id: Column, doc_id: Column, explicit: Column | None = None) -> Column:
    """Storage path: an explicit name wins, else `user/doc`, else `doc`."""
    derived = F.when(F.length(F.coalesce(user_id, F.lit(""))) > 0, F.concat_ws("/", user_id, doc_id)).otherwise(doc_id)
    if explicit is None:
        return derived
    return F.when(F.length(F.coalesce(explicit, F.lit(""))) > 0, explicit).otherwise(derived)


def download_path(source: Column, user_id: Column) -> Column:
    """Path of a hit's file: prefixed by the user unless the source is a path already."""
    return F.when(F.contains(source, F.lit("/")), source).otherwise(object_path(user_id, source))


