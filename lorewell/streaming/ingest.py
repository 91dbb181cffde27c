"""The ingestion stream: document events in, jobs, chunks, retries and dead letters out.

At-least-once in, idempotent out. Everything a batch writes is named after the batch, and the chunk store
skips a version it already holds, so a batch that failed half-way can run again.

Failed messages are written to the retry folder with the time they are due, and the stream reads that folder as its second source.
A batch takes the messages that are due by its own time, which is stored once per batch, and hands the others on in the waiting
folder, the third source, whose files are deleted once they have been read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lorewell import constants as K
from lorewell.operators import admission as A
from lorewell.operators import chunking as C
from lorewell.operators.indexing import chunk_key
from lorewell.schemas import CHUNKS, JOB_EVENTS, JOBS, MESSAGE
from lorewell.session import materialize
from lorewell.sources.sinks import ChunkStore, write_dead_letters
from lorewell.streaming import events as E
from lorewell.streaming.tables import batch_writer, read_batches


@dataclass
class DocumentIngest:
    """Settings and folders of one ingestion stream; `objects` is the folder that events by reference point into."""

    base: str
    topic: str = "raw-documents"
    lexicon: dict[str, list[str]] = field(default_factory=lambda: C.LEXICON)
    max_bytes: int = K.MAX_FILE_BYTES
    user_buckets: int = 32
    source_buckets: int = 16
    allowed_delay_seconds: int | None = None
    objects: str | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)

    @property
    def jobs_path(self) -> str:
        return f"{self.base}/jobs"

    @property
    def store(self) -> ChunkStore:
        return ChunkStore(f"{self.base}/chunks", self.user_buckets, self.source_buckets)

    @property
    def retry_path(self) -> str:
        return f"{self.base}/retry"

    @property
    def waiting_path(self) -> str:
        return f"{self.base}/waiting"

    @property
    def dead_path(self) -> str:
        return f"{self.base}/dead"

    @property
    def events_path(self) -> str:
        return f"{self.base}/job_events"

    def jobs(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Registered jobs of all batches, or of those before a batch. An id is registered once."""
        rows = read_batches(spark, self.jobs_path, _parse_datatype_string(JOBS))
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def job_events(self, spark: SparkSession) -> DataFrame:
        """Status events of the jobs, for `admission.fold_status`."""
        return read_batches(spark, self.events_path, _parse_datatype_string(JOB_EVENTS)).drop("batch")

    def chunks(self, spark: SparkSession, users: list[str] | None = None) -> DataFrame:
        """The current chunk table."""
        return self.store.read(spark, _parse_datatype_string(CHUNKS), users)

    def _one_value(self, spark: SparkSession, name: str, batch: int):
        """The one value that a batch stored under a name."""
        rows = read_batches(spark, f"{self.base}/{name}", _parse_datatype_string("value timestamp"))
        row = rows.filter(F.col("batch") == batch).select("value").first()
        return row and row["value"]

    def _store_value(self, spark: SparkSession, name: str, batch: int, value: datetime | None) -> None:
        batch_writer(f"{self.base}/{name}")(spark.createDataFrame([(value,)], "value timestamp"), batch)

    def now(self, spark: SparkSession, batch: int) -> datetime:
        """The time of a batch: read from the clock once, so that the batch gives the same result when it runs again."""
        stored = self._one_value(spark, "clock", batch)
        if stored is None:
            self._store_value(spark, "clock", batch, self.clock())
            stored = self._one_value(spark, "clock", batch)
        return stored

    def watermark(self, spark: SparkSession, before: int):
        """The latest event time of the batches before this one, kept by the last of them, less the allowed delay."""
        latest = self._one_value(spark, "latest", before - 1) if before else None
        return None if latest is None else latest - timedelta(seconds=self.allowed_delay_seconds)

    def with_objects(self, parsed: DataFrame) -> DataFrame:
        """Events by reference (an object_name and no content) with the text of their object.

        The names of one micro-batch are looked up one by one; the objects are read by the tasks. An object that is not
        there is an error of the event.
        """
        spark = parsed.sparkSession
        refers = F.col("content").isNull() & (F.length(F.coalesce("object_name", F.lit(""))) > 0) & F.col("error").isNull()
        names = [r[0] for r in parsed.filter(refers).select("object_name").distinct().collect()]  # of one micro-batch
        found = []
        for name in names if self.objects else []:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.objects.rstrip('/')}/{name}")
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if system.exists(path):
                found.append((name, system.makeQualified(path).toString()))
        missing = F.when(refers & F.col("object_text").isNull(), F.concat(F.lit("FileNotFoundError: "), "object_name"))
        if not found:
            return parsed.withColumn("object_text", F.lit(None).cast("string")).withColumn(
                "error", F.coalesce("error", missing)
            ).drop("object_text")
        listed = spark.createDataFrame(found, "ref string, path string")
        files = spark.read.format("binaryFile").load([p for _, p in found])
        texts = C.extract_text(files.join(listed, "path").withColumn("filename", F.col("ref"))).select("ref", F.col("text").alias("object_text"))
        joined = parsed.join(texts, refers & (F.col("object_name") == F.col("ref")), "left")
        return (
            joined.withColumn("error", F.coalesce("error", missing))
            .withColumn("content", F.coalesce("content", "object_text"))
            .drop("ref", "object_text")
        )

    def process(self, messages: DataFrame, batch_id: int) -> None:
        """One micro-batch. Its time is stored, so a replay gives the same result."""
        spark = messages.sparkSession
        now = F.lit(self.now(spark, batch_id))
        early = F.coalesce(E.due() > now, F.lit(False))
        waiting = materialize(messages.filter(early).select("key", "value", "headers", "timestamp"), "waiting")
        waiting.write.mode("overwrite").json(f"{self.waiting_path}/batch={batch_id}")
        messages = messages.filter(~early)
        parsed = self.with_objects(E.parse_document_events(messages)).withColumn("length", F.octet_length("content"))
        checked = A.validate_files(parsed.withColumnRenamed("error", "unreadable"), max_bytes=self.max_bytes)
        checked = checked.withColumn("error", F.coalesce("unreadable", "error")).drop("unreadable")
        watermark = None if self.allowed_delay_seconds is None else self.watermark(spark, batch_id)
        if watermark is not None:
            # too late to be taken in: kept as dead letters, whatever their retry count
            late = F.coalesce((F.col("timestamp") < F.lit(watermark)) & E.due().isNull(), F.lit(False))  # a retry was in time once
            checked = checked.withColumn("retry_count", F.when(late, K.MAX_CONSUMER_RETRIES).otherwise(F.col("retry_count")))
            checked = checked.withColumn("error", F.when(late, "late event").otherwise(F.col("error")))
        # a text is written once: as the message of a failure, or as the content of an upload; from here on rows without it meet it by `row`
        bad = F.col("error").isNotNull()
        checked = checked.withColumn("file_hash", F.when(~bad, A.content_hash(F.col("content"))))
        checked = checked.withColumn("value", F.when(bad, F.col("value"))).withColumn("content", F.when(~bad, F.col("content")))
        checked = materialize(checked.drop("headers").withColumn("row", F.monotonically_increasing_id()), "events")

        failed = checked.filter(F.col("error").isNotNull())
        E.retries(failed, now).write.mode("overwrite").json(f"{self.retry_path}/batch={batch_id}")
        write_dead_letters(E.dead_letters(failed, self.topic, F.col("timestamp")), self.dead_path, batch_id)

        uploads = checked.filter(F.col("error").isNull()).select(
            F.struct("timestamp", "doc_id").alias("arrival"),
            F.col("doc_id").alias("new_doc_id"), "user_id", "filename", "metadata", "timestamp", "file_hash", "row",
        )
        # only the jobs this batch can meet: its own hashes and ids are the small side of both joins
        stored = self.jobs(spark, before=batch_id)
        same_content = stored.join(uploads.select("file_hash").distinct(), "file_hash", "left_semi")
        decided = materialize(A.dedup_decision(uploads, same_content), "decided")
        queued = decided.filter(F.col("decision") == "queued")

        new = queued.select(
            "doc_id", "user_id", F.lit(str(batch_id)).alias("batch_id"), F.col("filename").alias("source_path"),
            "file_hash", F.col("timestamp").alias("uploaded_at"), "metadata",
        )
        same_id = stored.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
        fresh = A.register_jobs(same_id, new).join(same_id.select("doc_id"), "doc_id", "left_anti")
        batch_writer(self.jobs_path)(fresh.withColumn("status", F.lit("queued")), batch_id)

        if not self.store.holds(spark, batch_id):
            # of several events with one doc_id in a batch, the latest content is indexed
            latest = queued.groupBy("doc_id").agg(
                F.max_by(F.struct("user_id", "filename", "metadata", "timestamp", "row"), "arrival").alias("d")
            )
            texts = checked.filter(F.col("error").isNull()).select("row", "content")
            docs = latest.select("doc_id", "d").join(texts, F.col("d.row") == F.col("row")).select(
                F.col("doc_id").alias("source"), "d.user_id", "d.filename", F.col("content").alias("text"),
                F.col("d.metadata")["document_date"].alias("document_date"), F.col("d.timestamp").alias("ingested_at"),
            )
            chunks = C.chunk_documents(docs, F.col("ingested_at"), lexicon=self.lexicon)
            keyed = chunks.withColumn("chunk_key", chunk_key(F.col("content"), F.col("source"), F.col("chunk_index")))
            self.store.update(keyed, batch_id)

        # what became of every message: only documents with chunks in the store are indexed
        reached = self.store.sources(spark, queued.select(F.col("doc_id").alias("source")))
        done = queued.groupBy("doc_id").agg(F.max("timestamp").alias("ts")).join(
            reached.select(F.col("source").alias("doc_id"), F.lit(True).alias("reached")), "doc_id", "left"
        )
        last = F.when(F.col("reached"), "indexed").otherwise("failed")
        problem = F.when(F.col("reached"), F.lit(None)).otherwise("no text to index")
        over = F.col("retry_count") >= K.MAX_CONSUMER_RETRIES
        refused = failed.groupBy("doc_id").agg(F.max_by(F.struct("timestamp", "error", "retry_count"), "timestamp").alias("f")).select(
            "doc_id", F.col("f.timestamp").alias("ts"), F.col("f.error").alias("problem"), F.col("f.retry_count").alias("retry_count")
        )
        outcomes = done.select("doc_id", "ts", F.array(F.lit("received"), F.lit("queued"), last).alias("steps"), problem.alias("problem")).unionByName(
            refused.select("doc_id", "ts", F.array(F.lit("received"), F.when(over, "dead").otherwise("failed")).alias("steps"), "problem")
        )
        if self.allowed_delay_seconds is not None:
            seen = (self._one_value(spark, "latest", batch_id - 1) if batch_id else None, outcomes.agg(F.max("ts")).first()[0])
            self._store_value(spark, "latest", batch_id, max((t for t in seen if t is not None), default=None))
        events = outcomes.select("doc_id", "ts", "problem", F.size("steps").alias("n"), F.posexplode("steps").alias("step", "status"))
        batch_writer(self.events_path)(
            events.select(
                "doc_id", "status", F.when(F.col("step") == F.col("n") - 1, F.col("problem")).alias("error_msg"), "ts",
                (F.lit(batch_id).cast("bigint") * 10 + F.col("step")).alias("seq"),
            ),
            batch_id,
        )

    def start(self, messages: DataFrame, checkpoint: str, **trigger):
        """Run the stream over new messages and retries; `trigger` as for writeStream.trigger.

        Waiting retries are handed on by every batch, so an interval of about the shortest wait is sensible.
        """
        reader = lambda: messages.sparkSession.readStream.schema(MESSAGE)
        retried = reader().json(f"{self.retry_path}/batch=*")
        waited = reader().option("cleanSource", "delete").json(f"{self.waiting_path}/batch=*")
        columns = ["key", "value", "headers", "timestamp"]
        both = messages.select(*columns).unionByName(retried.select(*columns)).unionByName(waited.select(*columns))
        return (
            both.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
