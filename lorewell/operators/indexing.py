"""Chunk keys, incremental index maintenance, cascading deletes, embeddings and the answer cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import WORD_CLASS
from lorewell.operators.skew import lookup

FIELD_SEPARATOR = "\x1f"
#: The column of hashed word counts.
COUNTED = "__tf"


def chunk_key(content: Column, source: Column, chunk_index: Column) -> Column:
    """Content-addressed key. The ingest time is left out, so an unchanged chunk keeps its key."""
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, content, source, chunk_index.cast("string")), 256)


def index_diff(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(chunk_key, source, op): what an incoming batch changes in the stored index.

    op is `added`, `skipped` (same key already there), `deleted` (vanished from a source of the batch) or
    `untouched` (its source is not in the batch). Only keys and sources are read, never chunk texts, and the stored
    rows meet the batch's sources by semi- and anti-join: who drops `untouched` does not pay for it.
    """
    new = incoming.groupBy("chunk_key").agg(F.min("source").alias("source"))
    touched = incoming.select(F.col("source").alias("batch_source")).distinct()
    stored, same = current.select("chunk_key", "source"), F.col("source").eqNullSafe(F.col("batch_source"))
    old = stored.join(touched, same, "left_semi").select(F.col("chunk_key").alias("old_key"), F.col("source").alias("old_source"))
    joined = new.join(old, F.col("chunk_key") == F.col("old_key"), "full_outer")
    op = F.when(F.col("old_key").isNull(), "added").when(F.col("chunk_key").isNull(), "deleted").otherwise("skipped")
    changed = joined.select(
        F.coalesce("chunk_key", "old_key").alias("chunk_key"), F.coalesce("source", "old_source").alias("source"), op.alias("op")
    )
    untouched = stored.join(touched, same, "left_anti").select("chunk_key", "source", F.lit("untouched").alias("op"))
    return changed.unionByName(untouched)


def first_rows(chunks: DataFrame) -> DataFrame:
    """One row per chunk_key: the one that comes first by source, position and content."""
    others = [c for c in chunks.columns if c != "chunk_key"]
    order = [c for c in ("source", "chunk_index", "content") if c in others]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    return chunks.groupBy("chunk_key").agg(first).select("chunk_key", "r.*").select(*chunks.columns)


def apply_diff(incoming: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """The index after the batch: current rows without the deleted ones, plus the added rows."""
    deleted = diff.filter(F.col("op") == "deleted").select("chunk_key")
    added = diff.filter(F.col("op") == "added").select("chunk_key")
    kept = current.join(deleted, "chunk_key", "left_anti")
    new = first_rows(incoming).join(added, "chunk_key", "left_semi")
    return kept.unionByName(new)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if(F.col("op") == "added").alias("num_added"),
        F.count_if(F.col("op") == "skipped").alias("num_skipped"),
        F.count_if(F.col("op") == "deleted").alias("num_deleted"),
    )


def record_rows(batches: DataFrame) -> DataFrame:
    """Rows (key, namespace, group_id, updated_at) from batches of parallel key and group lists.

    `batches`: namespace, keys ARRAY, group_ids ARRAY or NULL, now DOUBLE, time_at_least DOUBLE or NULL.
    Lists of unequal length stop the job.
    """
    groups = F.coalesce("group_ids", F.transform("keys", lambda k: F.lit(None).cast("string")))
    paired = F.when(F.size("keys") == F.size(groups), F.arrays_zip(F.col("keys"), groups.alias("group_ids"))).otherwise(
        F.raise_error(F.lit("the number of keys differs from the number of group ids"))
    )
    return batches.select(
        "namespace", F.greatest("now", "time_at_least").alias("updated_at"), F.explode(paired).alias("p")
    ).select(F.col("p.keys").alias("key"), "namespace", F.col("p.group_ids").alias("group_id"), "updated_at")


def upsert_records(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Record table after the updates: a known (key, namespace) gets the new group and time, others are added.

    Of several updates of one key the latest counts. An aggregate, so it needs no MERGE support.
    """
    columns = ["key", "namespace", "group_id", "updated_at"]
    stored = records.select(*columns, F.lit(0).alias("version"))
    fresh = updates.select(*columns, F.lit(1).alias("version"))
    newest = F.max_by(F.struct("group_id", "updated_at"), F.struct("version", "updated_at", "group_id"))
    return (
        stored.unionByName(fresh)
        .groupBy("key", "namespace")
        .agg(newest.alias("r"))
        .select("key", "namespace", "r.group_id", "r.updated_at")
    )


def keys_by_group(records: DataFrame, group_ids: DataFrame) -> DataFrame:
    """Keys of the given groups (a table with `group_id`)."""
    return records.join(group_ids, "group_id", "left_semi").select("key")


@dataclass
class Deletion:
    chunks: DataFrame
    records: DataFrame
    events: DataFrame


def delete_documents(ids: DataFrame, chunks: DataFrame, records: DataFrame, as_of: Column) -> Deletion:
    """Chunks and records without the given documents, and the status events of their deletion.

    A document without chunks still gets its events, so deleting twice is harmless.
    """
    doc_ids = ids.select("doc_id").distinct()
    groups = doc_ids.withColumnRenamed("doc_id", "group_id")
    gone = keys_by_group(records, groups)
    steps = F.posexplode(F.array(F.lit("deleting"), F.lit("deleted"))).alias("seq", "status")
    events = doc_ids.select("doc_id", steps).select(
        "doc_id", "status", F.lit(None).cast("string").alias("error_msg"), as_of.alias("ts"), "seq"
    )
    return Deletion(
        chunks=chunks.join(gone.withColumnRenamed("key", "chunk_key"), "chunk_key", "left_anti"),
        records=records.join(groups, "group_id", "left_anti"),
        events=events,
    )


def wipe_documents(
    ids: DataFrame, chunks: DataFrame, records: DataFrame, as_of: Column, protected_mark: str
) -> Deletion:
    """Delete the documents whose id does not contain the protected mark."""
    return delete_documents(ids.filter(~F.contains("doc_id", F.lit(protected_mark))), chunks, records, as_of)


def list_document_chunks(chunks: DataFrame, records: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The chunks recorded for the given documents, in index order, with each document's total."""
    groups = doc_ids.select(F.col("doc_id").alias("group_id")).distinct()
    keys = records.join(groups, "group_id", "left_semi").select(
        F.col("key").alias("chunk_key"), F.col("group_id").alias("doc_id")
    )
    totals = keys.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    listed = lookup(chunks.join(keys, "chunk_key"), totals, ["doc_id"], "inner")
    return listed.orderBy("doc_id", "chunk_index")


def _counting(column: str, dims: int) -> list:
    words = RegexTokenizer(inputCol=column, outputCol="__words", pattern=f"[{WORD_CLASS}]+", gaps=False, toLowercase=True)
    return [words, HashingTF(inputCol="__words", outputCol=COUNTED, numFeatures=dims)]


def count_words(texts: DataFrame, column: str = "content", dims: int = 256) -> DataFrame:
    """Add the hashed word counts that `fit_embedder` and `embed` start from. A table written with them is not read as text again."""
    return PipelineModel(_counting(column, dims)).transform(texts).drop("__words")


def fit_embedder(texts: DataFrame, column: str = "content", dims: int = 256) -> PipelineModel:
    """Hashed tf-idf embedding, learnt in one pass; the state is one number per dimension.

    Vectors of a caller's own model can be used instead anywhere an `embedding` column is read.
    """
    counted = texts if COUNTED in texts.columns else count_words(texts.select(column), column, dims)
    weighing = [IDF(inputCol=COUNTED, outputCol="__tfidf"), Normalizer(inputCol="__tfidf", outputCol="__unit")]
    fitted = Pipeline(stages=weighing).fit(counted.select(COUNTED))
    return PipelineModel([*_counting(column, dims), *fitted.stages])


def embed(df: DataFrame, embedder: PipelineModel, column: str = "content") -> DataFrame:
    """Add `embedding` ARRAY<FLOAT> of unit length (all zero for text without words)."""
    if COUNTED in df.columns:
        made = PipelineModel(embedder.stages[2:]).transform(df)
        return made.withColumn("embedding", vector_to_array("__unit", "float32")).drop(COUNTED, "__tfidf", "__unit")
    source = embedder.stages[0].getInputCol()
    named = df.withColumn("__text", F.col(column)) if column == source else df.withColumn(source, F.col(column))
    made = embedder.transform(named)
    result = made.withColumn("embedding", vector_to_array("__unit", "float32"))
    extra = ["__text"] if column == source else [source]
    return result.drop("__words", COUNTED, "__tfidf", "__unit", *extra)


def cache_put(requests: DataFrame, as_of: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Cache rows (cache_key, value, expires_at); `as_of` is in seconds."""
    return requests.select(
        "cache_key", "value", (F.floor(as_of) + F.lit(ttl_seconds)).cast("bigint").alias("expires_at")
    )


def cache_purge(cache: DataFrame, as_of: Column) -> DataFrame:
    """Cache rows that have not expired; a row without expiry never does."""
    return cache.filter(F.coalesce(F.col("expires_at") >= F.floor(as_of), F.lit(True)))


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Each request with `hit` and the cached value; expired rows do not answer."""
    live = cache_purge(cache, as_of).select("cache_key", "value", F.lit(True).alias("found"))
    answered = lookup(requests, live, ["cache_key"])
    return answered.withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")
