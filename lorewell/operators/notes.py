"""Notes as document events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import slugify


def note_events(notes: DataFrame, as_of: Column, origin: str = "agent_generated") -> DataFrame:
    """(key, value): one JSON document event per note (doc_id, title, content, doc_type, user_id)."""
    filename = F.concat(
        F.lit("agent_notes/"), slugify(F.col("title")), F.lit("_"), F.date_format(as_of, "yyyyMMdd_HHmmss"), F.lit(".md")
    )
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "content")
    metadata = F.struct(
        F.col("filename").alias("source"),
        F.coalesce("doc_type", F.lit("general")).alias("doc_type"),
        F.col("title"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.lit(origin).alias("origin"),
    )
    payload = F.struct("doc_id", "filename", "user_id", F.col("text").alias("content"), F.col("metadata"))
    return (
        notes.withColumn("filename", filename)
        .withColumn("text", text)
        .withColumn("metadata", metadata)
        .select(
            F.col("doc_id").alias("key"),
            F.to_json(payload, {"ignoreNullFields": "false"}).alias("value"),
        )
    )
