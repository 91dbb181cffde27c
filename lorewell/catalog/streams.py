"""Streaming and source/sink queries: stream or round trip in, table out, checked against plain SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lorewell.catalog import conversations as CV
from lorewell.catalog import telemetry as TL
from lorewell.catalog import views as V
from lorewell.catalog.texts import COMMON_WORDS, sql_strip
from lorewell.functions import text as TX
from lorewell.functions.registry import register
from lorewell.operators import feedback as FB
from lorewell.operators import notes as N
from lorewell.operators import telemetry as T
from lorewell.session import shared_dir
from lorewell.sources import sinks as K
from lorewell.sources import tables as ST
from lorewell.streaming import events as E
from lorewell.streaming import folds as FO
from lorewell.streaming import turns as TU
from lorewell.streaming.ingest import DocumentIngest
from lorewell.streaming.late import LateGate
from lorewell.streaming.tables import batch_writer, read_latest, run_to_end

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _event_stream(spark, d):
    """The events table as a stream of its files."""
    schema = V.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class _Streamed:
    """Lets the view functions run over the event stream instead of the event table."""

    def __init__(self, spark, d):
        self.stream = _event_stream(spark, d)

    @property
    def read(self):
        return self

    def parquet(self, path):
        return self.stream


def _run(spark, result, name, keys):
    """Run an update-mode aggregate to the end and read its table."""
    base = shared_dir(spark, name)
    writer = result.writeStream.outputMode("update").foreachBatch(batch_writer(f"{base}/out"))
    run_to_end(writer, f"{base}/checkpoint")
    return read_latest(spark, f"{base}/out", result.schema, keys)


@query
def status_stream(spark, d):
    return _run(spark, FO.status_state(V.job_events(_Streamed(spark, d), d)), "status", ["doc_id"])


SQL["status_stream"] = V.with_views(
    "v_job_events",
    """SELECT doc_id, arg_max(status, (ts, seq)) AS status, arg_max(struct_pack(m := error_msg), (ts, seq)).m AS error_msg,
  count(*) FILTER (WHERE status = 'failed') AS attempts, max(ts) AS updated_at FROM v_job_events GROUP BY doc_id""",
)


@query
def turn_sessions(spark, d):
    blocks = FO.turn_blocks(V.graph_events(_Streamed(spark, d), d))
    return FO.turn_sessions(_run(spark, blocks, "turns", ["turn_id", "block"]))


SQL["turn_sessions"] = V.with_views(
    "v_graph_events",
    f"""WITH s AS (SELECT turn_id, max(seq) FILTER (WHERE {CV._GEN_START}) AS last_start, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  epoch_us(min(ts) FILTER (WHERE {CV._TOKEN})) AS token_us FROM v_graph_events GROUP BY turn_id),
a AS (SELECT turn_id, string_agg(content, '' ORDER BY seq) AS answer FROM v_graph_events JOIN s USING (turn_id)
  WHERE {CV._TOKEN} AND (last_start IS NULL OR seq > last_start) GROUP BY turn_id)
SELECT s.turn_id, answer, (token_us - first_us) / 1000000 AS first_token_seconds, (last_us - first_us) / 1000000 AS total_seconds
FROM s LEFT JOIN a ON s.turn_id = a.turn_id""",
)


@query
def success_rate_stream(spark, d):
    tasks = _event_stream(spark, d).select("ts", (F.col("event_type") != "error").alias("succeeded"))
    return _run(spark, T.success_rate(tasks.withWatermark("ts", "1 hour")), "rate", ["window_start"])


SQL["success_rate_stream"] = TL.SQL["success_rate"]


@query
def dedup_event_stream(spark, d):
    """One event per user and kind survives; here the whole month lies within the delay."""
    events = _event_stream(spark, d).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("doc_id"), F.col("ts").alias("timestamp")
    )
    base = shared_dir(spark, "dedup")
    run_to_end(
        E.dedup_events(events, "40 days").writeStream.format("parquet").outputMode("append").option("path", f"{base}/out"),
        f"{base}/checkpoint",
    )
    return spark.read.parquet(f"{base}/out").select("doc_id")


SQL["dedup_event_stream"] = "SELECT DISTINCT user_id || '/' || event_type AS doc_id FROM events"


DELAY = dt.timedelta(days=10)


def _gated(spark, parts, delay, name):
    """A gate that has seen the parts one after the other, each as a stream's new files."""
    base = shared_dir(spark, name)
    gate = LateGate(f"{base}/gate", delay)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        gate.run(spark.readStream.schema(part.schema).parquet(f"{base}/in"), f"{base}/checkpoint")
    return gate


def _gated_events(spark, d):
    """Two thirds of the events arrive first, the others after them: some of those too late."""
    events = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    after = F.col("event_id") % 3 == 0
    return _gated(spark, [events.filter(~after), events.filter(after)], DELAY, "late"), events.schema


_GATED = f"""g AS (SELECT event_id, ts, event_type, event_id % 3 = 0 AND ts < (SELECT max(ts) FROM events WHERE event_id % 3 <> 0)
  - INTERVAL {DELAY.days} DAY AS late FROM events)"""


@query
def late_events(spark, d):
    """Every event with what the gate made of it, and the number of late events that it counted in the event's batch."""
    gate, schema = _gated_events(spark, d)
    on_time = spark.read.parquet(gate.on_time_path).withColumn("late", F.lit(False))
    both = on_time.unionByName(gate.late(spark, schema).withColumn("late", F.lit(True)))
    counted = gate.counts(spark).select("batch", "n", "n_late")
    return both.join(counted, "batch").select("event_id", "late", "n", "n_late")


SQL["late_events"] = f"""WITH {_GATED}
SELECT event_id, late, count(*) OVER (PARTITION BY event_id % 3 = 0) AS n, count(*) FILTER (late) OVER (PARTITION BY event_id % 3 = 0) AS n_late FROM g"""


@query
def success_rate_on_time(spark, d):
    """Success rate over the on-time events, as a stream; a delay as long as the gate's drops none of them."""
    gate, schema = _gated_events(spark, d)
    tasks = gate.on_time(spark, schema).select("ts", (F.col("event_type") != "error").alias("succeeded"))
    return _run(spark, T.success_rate(tasks.withWatermark("ts", f"{DELAY.days} days")), "rate", ["window_start"])


SQL["success_rate_on_time"] = f"WITH {_GATED}, on_time AS (SELECT * FROM g WHERE NOT late) " + TL.SQL["success_rate"].replace(
    "FROM events", "FROM on_time"
)


@query
def live_turns(spark, d):
    """Turns that answer when they have been silent for half an hour, with their late tokens; `open`: whether a state is left."""
    events = V.graph_events(spark, d)
    again = events.filter(CV.E.token()).groupBy("turn_id").agg(F.max_by(F.struct(*events.columns), "seq").alias("e")).select("e.*")
    again = again.withColumn("seq", F.col("seq") + 1_000_000_000)
    last = events.agg(F.max("ts").alias("ts"))
    closing = lambda days: last.select(
        F.lit("closing").alias("turn_id"), F.lit(days).cast("bigint").alias("seq"), F.expr(f"ts + INTERVAL {days} DAYS").alias("ts"),
        F.lit("on_chain_end").alias("event"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns[4:]],
    )
    parts = [events, again.unionByName(closing(2)), closing(3)]
    base, gate = shared_dir(spark, "live"), None
    gate = LateGate(f"{base}/gate", dt.timedelta(hours=1))
    for part in parts:  # the second stream follows the first one batch by batch
        part.write.mode("append").parquet(f"{base}/in")
        gate.run(spark.readStream.schema(part.schema).parquet(f"{base}/in"), f"{base}/gate-checkpoint")
        finished = TU.live_turns(gate.on_time(spark, events.schema), "1 hour", 1800)
        writer = finished.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        run_to_end(writer, f"{base}/checkpoint")
    late = gate.late(spark, events.schema).groupBy("turn_id").agg(F.count(F.lit(1)).alias("late_tokens"))
    left = TU.open_turns(spark, f"{base}/checkpoint").select("turn_id", F.lit(True).alias("open"))
    done = spark.read.schema(TU.FINISHED).parquet(f"{base}/out")
    return done.join(late, "turn_id", "left").join(left, "turn_id", "full").select(
        "turn_id", "answer", "n_tokens", "first_token_seconds", "total_seconds", F.coalesce("late_tokens", F.lit(0)).alias("late_tokens"),
        F.coalesce("open", F.lit(False)).alias("open"),
    )


SQL["live_turns"] = V.with_views(
    "v_graph_events",
    f"""WITH again AS (SELECT * REPLACE (seq + 1000000000 AS seq) FROM v_graph_events WHERE {CV._TOKEN}
  QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY seq DESC) = 1),
bound AS (SELECT max(ts) - INTERVAL 1 HOUR AS least FROM v_graph_events),
seen AS (SELECT * FROM v_graph_events UNION ALL SELECT * FROM again WHERE ts >= (SELECT least FROM bound)),
late AS (SELECT turn_id, count(*) AS n FROM again WHERE ts < (SELECT least FROM bound) GROUP BY turn_id),
s AS (SELECT turn_id, max(seq) FILTER (WHERE {CV._GEN_START}) AS last_start, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  epoch_us(min(ts) FILTER (WHERE {CV._TOKEN})) AS token_us FROM seen GROUP BY turn_id),
a AS (SELECT turn_id, string_agg(content, '' ORDER BY seq) AS answer, count(*) AS n_tokens FROM seen JOIN s USING (turn_id)
  WHERE {CV._TOKEN} AND (last_start IS NULL OR seq > last_start) GROUP BY turn_id)
SELECT s.turn_id, answer, coalesce(n_tokens, 0) AS n_tokens, (token_us - first_us) / 1000000 AS first_token_seconds,
  (last_us - first_us) / 1000000 AS total_seconds, coalesce(late.n, 0) AS late_tokens, false AS open
FROM s LEFT JOIN a ON s.turn_id = a.turn_id LEFT JOIN late ON s.turn_id = late.turn_id
UNION ALL SELECT 'closing', NULL, NULL, NULL, NULL, 0, true""",
)


def _messages(spark, d):
    """Documents as messages: some without id, with a broken id, with broken JSON or a forbidden file type."""
    n = F.col("doc_id")
    event = F.struct(
        F.when(n % 9 == 0, F.lit(None)).when(n % 9 == 1, "no-uuid").otherwise(V.uuid_text(n.cast("string"))).alias("doc_id"),
        F.concat(F.lit("f"), n.cast("string"), F.when(n % 8 == 7, ".exe").otherwise(".txt")).alias("filename"),
        F.col("lang").alias("user_id"), F.col("text").alias("content"),
    )
    value = F.when(n % 10 == 9, F.lit("{broken")).otherwise(F.to_json(event))
    count = F.struct(F.lit("retry-count").alias("key"), (n % 5).cast("string").alias("value"))
    return V.table(spark, d, "documents").select(
        n.cast("string").alias("key"), value.alias("value"), F.array(count).alias("headers"),
        V.micros(F.lit(V.EPOCH_2024) + n * V.MINUTE).alias("timestamp"),
    )


_MESSAGES = """m AS (SELECT doc_id AS n, lang, text, doc_id % 5 AS retry_count, CASE WHEN doc_id % 10 = 9 THEN 'invalid JSON'
  WHEN doc_id % 9 = 1 THEN 'badly formed hexadecimal UUID string' WHEN doc_id % 8 = 7 THEN 'bad type' END AS problem FROM documents)"""


def _ingested(spark, d):
    base = shared_dir(spark, "ingest")
    _messages(spark, d).write.json(f"{base}/in")
    job = DocumentIngest(f"{base}/out", lexicon=COMMON_WORDS, user_buckets=4, source_buckets=2)
    job.start(E.read_document_events(spark, f"{base}/in"), f"{base}/checkpoint").awaitTermination()
    return job


@query
def ingest_stream(spark, d):
    """The whole stream; what became of every message: its last state, and the size of what was indexed."""
    job = _ingested(spark, d)
    last = job.job_events(spark).groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("state"))
    counted = job.chunks(spark).groupBy(F.col("source").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last_index")
    )
    jobs = job.jobs(spark).select("doc_id", "user_id", "file_hash", "status")
    joined = last.join(jobs, "doc_id", "left").join(counted, "doc_id", "left")
    return joined.select("state", "user_id", "file_hash", "status", (F.col("n") == F.col("last_index") + 1).alias("complete"))


SQL["ingest_stream"] = f"""WITH {_MESSAGES}
SELECT * FROM (SELECT DISTINCT 'indexed' AS state, lang AS user_id, sha256(text) AS file_hash, 'queued' AS status, true AS complete FROM m WHERE problem IS NULL)
UNION ALL SELECT CASE WHEN retry_count < 3 THEN 'failed' ELSE 'dead' END, NULL, NULL, NULL, NULL FROM m WHERE problem IS NOT NULL AND problem <> 'badly formed hexadecimal UUID string'
UNION ALL SELECT * FROM (SELECT CASE WHEN max_by(retry_count, n) < 3 THEN 'failed' ELSE 'dead' END, NULL, NULL, NULL, NULL FROM m WHERE problem = 'badly formed hexadecimal UUID string' HAVING count(*) > 0)"""


@query
def route_failures(spark, d):
    """Retries and dead letters the stream wrote."""
    job = _ingested(spark, d)
    retry = spark.read.schema(E.MESSAGE).json(job.retry_path)
    dead = spark.read.schema(E.MESSAGE).json(job.dead_path)
    pick = lambda df, kind, name: df.select(
        F.lit(kind).alias("kind"), "key", F.coalesce(E.header(name), F.lit("")).alias("note")
    )
    return pick(retry, "retry", "retry-count").unionByName(
        pick(dead, "dead", "error").withColumn(
            "note", F.when(F.startswith("note", F.lit("Extensi")), "bad type").otherwise(F.col("note"))
        )
    )


SQL["route_failures"] = f"""WITH {_MESSAGES} SELECT CASE WHEN retry_count < 3 THEN 'retry' ELSE 'dead' END AS kind, CAST(n AS VARCHAR) AS key,
  CASE WHEN retry_count < 3 THEN CAST(retry_count + 1 AS VARCHAR) ELSE problem END AS note FROM m WHERE problem IS NOT NULL"""


@query
def read_document_events(spark, d):
    """Parsed messages; ids made up for messages without one are only checked for presence."""
    base = shared_dir(spark, "messages")
    _messages(spark, d).write.json(f"{base}/in")
    parsed = E.parse_document_events(E.read_document_events(spark, f"{base}/in"))
    run_to_end(parsed.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    made = F.col("key").cast("bigint") % 9 == 0
    return spark.read.parquet(f"{base}/out").select(
        "key", "error", "filename", "user_id", "retry_count",
        F.when(F.col("error").isNull(), F.when(made, F.length("doc_id").cast("string")).otherwise(F.col("doc_id"))).alias("doc_id"),
    )


SQL["read_document_events"] = f"""WITH {_MESSAGES} SELECT CAST(n AS VARCHAR) AS key, CASE WHEN problem <> 'bad type' THEN problem END AS error,
  CASE WHEN problem = 'invalid JSON' THEN 'unknown_file' ELSE 'f' || n || CASE WHEN n % 8 = 7 THEN '.exe' ELSE '.txt' END END AS filename,
  CASE WHEN problem IS DISTINCT FROM 'invalid JSON' THEN lang END AS user_id, retry_count,
  CASE WHEN problem IS NULL OR problem = 'bad type' THEN CASE WHEN n % 9 = 0 THEN '36' ELSE {V.sql_uuid("CAST(n AS VARCHAR)")} END END AS doc_id FROM m"""


@query
def write_chunks(spark, d):
    """Chunks written to the store, updated with a batch that edits one chunk of each source, read back."""
    store = K.ChunkStore(shared_dir(spark, "store"), user_buckets=4, source_buckets=2)
    chunks = V.chunks(spark, d).drop("embedding")
    store.write(chunks, 0)
    edited = chunks.withColumn(
        "chunk_key", F.when(F.col("chunk_index") == 3, F.col("chunk_key") + 1000000).otherwise(F.col("chunk_key"))
    )
    store.update(edited, 1)
    return store.read(spark, chunks.schema).select("chunk_key", "source", "chunk_index", "user_id", "content")


SQL["write_chunks"] = V.with_views(
    "v_chunks",
    """SELECT CASE WHEN chunk_index = 3 THEN chunk_key + 1000000 ELSE chunk_key END AS chunk_key,
  source, chunk_index, user_id, content FROM v_chunks""",
)


def _changed_store(spark, d):
    """A store whose sources of every third chunk owner moved to another user."""
    store = K.ChunkStore(shared_dir(spark, "store"), user_buckets=4, source_buckets=2)
    chunks = V.chunks(spark, d).drop("embedding")
    store.write(chunks, 0)
    moved = chunks.filter(F.substring("source", -1, 1).isin("0", "3", "6")).withColumn("user_id", F.lit("moved"))
    store.update(moved, 1)
    return store, chunks


@query
def store_user_change(spark, d):
    """Documents handed in again by another user replace their chunks."""
    store, chunks = _changed_store(spark, d)
    return store.read(spark, chunks.schema).select("chunk_key", "source", "chunk_index", "user_id", "content")


SQL["store_user_change"] = V.with_views(
    "v_chunks",
    """SELECT chunk_key, source, chunk_index, CASE WHEN right(source, 1) IN ('0', '3', '6') THEN 'moved' ELSE user_id END AS user_id,
  content FROM v_chunks""",
)


@query
def store_delete(spark, d):
    """Deleted sources leave the store; compaction changes nothing."""
    store, chunks = _changed_store(spark, d)
    store.delete(chunks.select("source").filter(F.substring("source", -1, 1).isin("3", "5")), chunks.schema, 2)
    store.compact(spark, chunks.schema, 3)
    return store.read(spark, chunks.schema).select("chunk_key", "source", "chunk_index", "user_id", "content")


SQL["store_delete"] = V.with_views(
    "v_chunks",
    """SELECT chunk_key, source, chunk_index, CASE WHEN right(source, 1) IN ('0', '3', '6') THEN 'moved' ELSE user_id END AS user_id,
  content FROM v_chunks WHERE right(source, 1) NOT IN ('3', '5')""",
)


@query
def publish_notes(spark, d):
    """Conversation rows as notes, published as message files and read as document events."""
    notes = V.table(spark, d, "conversations").select(
        V.uuid_text(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("doc_type"), F.col("role").alias("user_id"),
    )
    path = shared_dir(spark, "notes")
    K.publish_notes(N.note_events(notes, F.lit(CV.NOTE_TIME).cast("timestamp")), path)
    parsed = E.parse_document_events(spark.read.schema(E.MESSAGE).json(path))
    return parsed.select("key", "doc_id", "user_id", "content", F.col("metadata")["origin"].alias("origin"), "error")


SQL["publish_notes"] = f"""WITH n AS (SELECT {V.sql_uuid("conv_id || '-' || turn")} AS doc_id, * FROM conversations)
SELECT doc_id AS key, doc_id, role AS user_id, '# ' || string_split(text, chr(10))[1] || chr(10) || chr(10) || text AS content,
  'agent_generated' AS origin, CAST(NULL AS VARCHAR) AS error FROM n"""


@query
def write_csv_report(spark, d):
    """The run report written as CSV and scanned again."""
    path = shared_dir(spark, "report")
    K.write_csv_report(TL._exported(spark, d), path)
    return ST.scan_runs(spark, path)


SQL["write_csv_report"] = TL.SQL["runs_in_range"]


@query
def write_golden(spark, d):
    path = shared_dir(spark, "golden")
    K.write_golden(FB.export_golden(V.feedback(spark, d)), path)
    return ST.scan_golden(spark, path, pairs=True)


SQL["write_golden"] = V.with_views(
    "v_feedback",
    """SELECT coalesce(user_prompt, 'N/A') AS input, coalesce(ai_response, 'N/A') AS actual_output,
  CASE WHEN score = 1 THEN coalesce(ai_response, 'N/A') ELSE '(Corregido) ' || user_correction END AS expected_output,
  CASE WHEN score = 1 THEN 'positive' ELSE 'correction' END AS feedback_type
FROM v_feedback WHERE score = 1 OR (score = -1 AND user_correction IS NOT NULL)""",
)


@query
def scan_pages(spark, d):
    return ST.scan_pages(spark, f"{d}/pages.parquet")


SQL["scan_pages"] = "SELECT page_id, url, html FROM pages"


@query
def sql_functions(spark, d):
    """The functions registered for SQL, called from SQL on every document."""
    register(spark)
    V.documents(spark, d).createOrReplaceTempView("lorewell_documents")
    return spark.sql(
        """SELECT doc_id, slugify(text) AS slug, strip_code_fence('```json\\n' || text || '```') AS reply, pieces
        FROM lorewell_documents JOIN (SELECT doc_id, count(*) AS pieces FROM lorewell_documents,
          LATERAL split_structured(text, 1000000000, 0) GROUP BY doc_id) USING (doc_id)"""
    )


SQL["sql_functions"] = rf"""SELECT doc_id, substr(regexp_replace(regexp_replace({sql_strip('lower(text)')}, '[^{TX.WORD_CLASS}{TX.BLANK_CLASS}-]', '', 'g'),
  '[{TX.BLANK_CLASS}_-]+', '_', 'g'), 1, 60) AS slug, {sql_strip('text')} AS reply, count(*) OVER (PARTITION BY doc_id) AS pieces FROM documents"""
