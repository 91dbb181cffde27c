"""The document-event stream: reading, parsing, failure routing and replay removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.operators.admission import UUID_PATTERN
from lorewell.schemas import DOCUMENT_EVENT, MESSAGE


def read_document_events(
    spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, max_files: int = 1000
) -> DataFrame:
    """A stream of messages (key, value, headers, timestamp): a Kafka topic, or JSON message files."""
    if kafka:
        raw = spark.readStream.format("kafka").option("includeHeaders", "true").options(**kafka).load()
        text_headers = F.transform(
            "headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))
        )
        return raw.select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
            text_headers.alias("headers"), "timestamp",
        )
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", max_files).json(path)


def header(name: str) -> Column:
    """The last header of a name; NULL if absent."""
    values = F.filter(
        F.coalesce("headers", F.array().cast("array<struct<key:string,value:string>>")), lambda h: h["key"] == name
    )
    return F.try_element_at(F.transform(values, lambda h: h["value"]), F.lit(-1))


def parse_document_events(messages: DataFrame) -> DataFrame:
    """Messages with the event's fields, its retry count and an `error` for values that cannot be read.

    A missing doc_id is derived from the message, so that reading the message again gives the same id.
    """
    parsed = messages.withColumn("e", F.from_json("value", DOCUMENT_EVENT)).withColumn(
        "is_object", F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False))
    )
    digest = F.md5(F.concat_ws("\x1f", F.col("timestamp").cast("string"), "key", "value"))
    derived = F.concat_ws(
        "-", *[F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    named = F.length(F.coalesce("e.doc_id", F.lit(""))) > 0
    error = F.when(~F.col("is_object"), F.lit("invalid JSON")).when(
        named & ~F.rlike("e.doc_id", F.lit(UUID_PATTERN)), F.lit("badly formed hexadecimal UUID string")
    )
    return parsed.select(
        *messages.columns,
        F.when(named, F.lower("e.doc_id")).otherwise(derived).alias("doc_id"),
        F.coalesce("e.filename", F.lit(K.UNKNOWN_FILE)).alias("filename"),
        "e.user_id",
        "e.content",
        "e.object_name",
        "e.metadata",
        F.coalesce(F.try_to_number(header("retry-count"), F.lit("999999")).cast("int"), F.lit(0)).alias("retry_count"),
        error.alias("error"),
    )


def due() -> Column:
    """When a retried message may be taken again; NULL for a message that is no retry."""
    return F.timestamp_seconds(F.try_to_number(header("due"), F.lit("999999999999")))


def retries(failed: DataFrame, failed_at: Column, limit: int = K.MAX_CONSUMER_RETRIES) -> DataFrame:
    """Failed messages that go round again: their retry count one higher, due 60, 120, ... seconds after `failed_at`."""
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    wait = F.lit(K.RETRY_BASE_SECONDS) * F.pow(F.lit(2.0), F.col("retry_count")).cast("bigint")
    headers = F.array(entry("retry-count", F.col("retry_count") + 1), entry("due", F.unix_seconds(failed_at) + wait))
    return failed.filter(F.col("retry_count") < limit).select("key", "value", headers.alias("headers"), "timestamp")


def dead_letters(failed: DataFrame, topic: str, failed_at: Column, limit: int = K.MAX_CONSUMER_RETRIES) -> DataFrame:
    """Failed messages without retries left, with origin, error and time."""
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    headers = F.array(
        entry("original-topic", F.lit(topic)),
        entry("error", F.col("error")),
        entry("failed-at", F.date_format(failed_at, "yyyy-MM-dd'T'HH:mm:ss")),
    )
    return failed.filter(F.col("retry_count") >= limit).select("key", "value", headers.alias("headers"), "timestamp")


def dedup_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Replays of a doc_id within the delay are dropped; the state forgets ids older than that.

    Replays that come later are caught by the job table instead (`admission.register_jobs`).
    """
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["doc_id"])

