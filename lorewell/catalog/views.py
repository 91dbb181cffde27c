"""Derived views over the shared tables, once as DataFrames and once as SQL text.

Every view covers its whole base table; the modulo rules only derive column values. Nothing is random and
nothing depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.constants import DOC_TYPES, NOTE_TOOL, RETRIEVER_TOOL, WEB_TOOL
from lorewell.session import spread

EPOCH_2024 = 1704067200000000
MINUTE, HOUR = 60_000_000, 3_600_000_000
STATUSES = [
    "received", "queued", "processing", "extracting", "chunking", "embedding",
    "stored", "indexed", "failed", "dead", "deleted", "succeeded",
]
EXTENSIONS = [".pdf", ".docx", ".txt", ".md", ".json", ".csv", ".exe", ""]

VIEW_SQL: dict[str, str] = {}
_NEEDS: dict[str, list[str]] = {}


def _sql(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    VIEW_SQL[name] = text
    _NEEDS[name] = list(needs)


def with_views(names: str, body: str) -> str:
    """SQL text of `body` preceded by the named views and whatever they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS[name]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work that is heavy per text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pick(values: list[str], index: Column) -> Column:
    """The value at a 0-based position of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def uuid_text(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat_ws(
        "-", *[F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def sql_uuid(seed: str) -> str:
    h = f"md5({seed})"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)"
    )


def micros(expr: Column) -> Column:
    return F.timestamp_micros(expr.cast("bigint"))


# --- jobs and uploads ------------------------------------------------------

def jobs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    status = pick(STATUSES, F.floor(n / 2) % 12)
    return docs.select(
        uuid_text(n.cast("string")).alias("doc_id"),
        F.when(n % 17 != 0, F.col("lang")).alias("user_id"),
        F.floor(n / 50).cast("string").alias("batch_id"),
        F.concat(F.lit("doc_"), n.cast("string"), pick(EXTENSIONS, n % 8)).alias("source_path"),
        status.alias("status"),
        (n % 3).alias("attempts"),
        F.when(status == "failed", F.lit("boom")).alias("error_msg"),
        micros(F.lit(EPOCH_2024) + n * MINUTE).alias("created_at"),
        micros(F.lit(EPOCH_2024) + n * MINUTE + (n % 90) * 1_000_000).alias("updated_at"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        F.octet_length("text").cast("bigint").alias("length"),
    )


_sql(
    "v_jobs",
    f"""SELECT {sql_uuid("CAST(doc_id AS VARCHAR)")} AS doc_id,
  CASE WHEN doc_id % 17 <> 0 THEN lang END AS user_id,
  CAST(doc_id // 50 AS VARCHAR) AS batch_id,
  'doc_' || doc_id || {sql_list(EXTENSIONS)}[(doc_id % 8) + 1] AS source_path,
  {sql_list(STATUSES)}[((doc_id // 2) % 12) + 1] AS status,
  doc_id % 3 AS attempts,
  CASE WHEN (doc_id // 2) % 12 = 8 THEN 'boom' END AS error_msg,
  make_timestamp({EPOCH_2024} + doc_id * {MINUTE}) AS created_at,
  make_timestamp({EPOCH_2024} + doc_id * {MINUTE} + (doc_id % 90) * 1000000) AS updated_at,
  sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS length FROM documents""",
)


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Every document handed in again; a third of them by another user, so all three outcomes occur."""
    n = F.col("doc_id")
    user = F.when(n % 17 == 0, F.lit(None)).when(n % 3 == 0, F.lit("team")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select(
        n.alias("arrival"),
        uuid_text(F.concat(F.lit("new-"), n.cast("string"))).alias("new_doc_id"),
        user.alias("user_id"),
        F.floor(n / 50).cast("string").alias("batch_id"),
        F.concat(
            F.lit("in/Upload."), n.cast("string"),
            F.when(n % 5 == 0, F.upper(pick(EXTENSIONS, n % 8))).otherwise(pick(EXTENSIONS, n % 8)),
        ).alias("filename"),
        F.when(n % 29 != 0, F.sha2(F.col("text").cast("binary"), 256)).alias("file_hash"),
        F.octet_length("text").cast("bigint").alias("length"),
    )


_sql(
    "v_uploads",
    f"""SELECT doc_id AS arrival, {sql_uuid("'new-' || doc_id")} AS new_doc_id,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'team' ELSE lang END AS user_id,
  CAST(doc_id // 50 AS VARCHAR) AS batch_id,
  'in/Upload.' || doc_id || CASE WHEN doc_id % 5 = 0 THEN upper({sql_list(EXTENSIONS)}[(doc_id % 8) + 1])
     ELSE {sql_list(EXTENSIONS)}[(doc_id % 8) + 1] END AS filename,
  CASE WHEN doc_id % 29 <> 0 THEN sha256(text) END AS file_hash,
  CAST(strlen(text) AS BIGINT) AS length FROM documents""",
)


def event_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


SQL_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def job_events(spark: SparkSession, d: str) -> DataFrame:
    names = {"click": "processing", "view": "extracting", "purchase": "indexed", "error": "failed", "signup": "queued"}
    status = F.lit(None)
    for event_type, name in names.items():
        status = F.when(F.col("event_type") == event_type, name).otherwise(status)
    return event_times(spark, d).select(
        F.col("user_id").alias("doc_id"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), "props")).alias("error_msg"),
        "ts",
        F.col("event_id").alias("seq"),
    )


_sql(
    "v_job_events",
    """SELECT user_id AS doc_id,
  CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'extracting' WHEN 'purchase' THEN 'indexed'
    WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' END AS status,
  CASE WHEN event_type = 'error' THEN 'error ' || props END AS error_msg, ts, event_id AS seq FROM events""",
)


# --- vector chunks and questions -------------------------------------------

def chunks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vec_id")
    source = F.floor(n / 10)
    word = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        n.alias("chunk_key"),
        word("s", source).alias("source"),
        word("u", source % 3).alias("user_id"),
        F.when(source % 4 != 0, word("file_", source)).alias("filename"),
        (n % 10).alias("chunk_index"),
        F.when(source % 2 == 0, "markdown").otherwise("agentic").alias("chunk_type"),
        F.when(F.col("label") != 9, pick(DOC_TYPES, F.col("label"))).alias("doc_type"),
        micros(F.lit(EPOCH_2024) + n * HOUR).alias("created_at"),
        F.concat_ws(
            " ", word("topic", F.col("label")), word("Item", n % 7), word("group", n % 11),
            F.when(n % 5 == 0, word("topic", F.col("label"))),
        ).alias("content"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding"),
    )


_sql(
    "v_chunks",
    f"""SELECT vec_id AS chunk_key, 's' || (vec_id // 10) AS source, 'u' || ((vec_id // 10) % 3) AS user_id,
  CASE WHEN (vec_id // 10) % 4 <> 0 THEN 'file_' || (vec_id // 10) END AS filename,
  vec_id % 10 AS chunk_index,
  CASE WHEN (vec_id // 10) % 2 = 0 THEN 'markdown' ELSE 'agentic' END AS chunk_type,
  CASE WHEN label <> 9 THEN {sql_list(DOC_TYPES)}[label + 1] END AS doc_type,
  make_timestamp({EPOCH_2024} + vec_id * {HOUR}) AS created_at,
  concat_ws(' ', 'topic' || label, 'Item' || (vec_id % 7), 'group' || (vec_id % 11),
    CASE WHEN vec_id % 5 = 0 THEN 'topic' || label END) AS content,
  CAST(label AS BIGINT) AS label, embedding FROM embeddings""",
)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per label: the mean vector of all its rows. The filters vary with the label."""
    means = (
        table(spark, d, "embeddings")
        .select(F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    )
    q = F.col("label")
    text = F.concat_ws(" ", F.concat(F.lit("Topic"), q.cast("string")), F.concat(F.lit("item"), (q % 7).cast("string")))
    return means.select(
        q.alias("query_id"),
        F.when(q != 8, text).otherwise("  ").alias("query"),
        F.when(q % 4 != 3, F.concat(F.lit("u"), (q % 3).cast("string"))).alias("user_id"),
        F.when(q == 1, "2024-01-05").when(q == 2, "not a date").when(q == 6, "2999-01-01").alias("date_from"),
        F.when(q == 3, "s5").when(q == 4, "no such file").alias("source_filter"),
        F.when(q == 5, F.lit(DOC_TYPES[5])).alias("doc_type"),
        F.when(q != 9, 2 + q % 6).alias("k_results"),
        F.transform("xs", lambda s: s["x"]).alias("embedding"),
    )


_sql(
    "v_questions",
    f"""SELECT label AS query_id,
  CASE WHEN label <> 8 THEN 'Topic' || label || ' item' || (label % 7) ELSE '  ' END AS query,
  CASE WHEN label % 4 <> 3 THEN 'u' || (label % 3) END AS user_id,
  CASE label WHEN 1 THEN '2024-01-05' WHEN 2 THEN 'not a date' WHEN 6 THEN '2999-01-01' END AS date_from,
  CASE label WHEN 3 THEN 's5' WHEN 4 THEN 'no such file' END AS source_filter,
  CASE WHEN label = 5 THEN '{DOC_TYPES[5]}' END AS doc_type,
  CASE WHEN label <> 9 THEN 2 + label % 6 END AS k_results,
  list(x ORDER BY pos) AS embedding
FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM
   (SELECT CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x
    FROM embeddings) GROUP BY label, pos) GROUP BY label""",
)


# --- whole texts -----------------------------------------------------------

def texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document with some of its line breaks turned into paragraphs, lists or headings."""
    n, text = F.col("doc_id"), F.col("text")
    shaped = (
        F.when(n % 5 == 0, F.replace(text, F.lit("\n"), F.lit("\n\n")))
        .when(n % 5 == 1, F.replace(text, F.lit("\n"), F.lit("\n- ")))
        .when(n % 5 == 2, F.concat(F.lit("# Título\n"), text))
        .when(n % 5 == 3, F.concat(F.lit("  \u00a0"), text, F.lit("\t\n \u2003")))
        .otherwise(text)
    )
    return documents(spark, d).select(
        n.alias("doc_id"),
        F.concat(F.lit("d"), n.cast("string")).alias("source"),
        F.when(n % 17 != 0, F.col("lang")).alias("user_id"),
        F.concat(F.lit("doc_"), n.cast("string"), pick(EXTENSIONS, n % 8)).alias("filename"),
        F.when(n % 31 != 30, shaped).alias("text"),
        F.when(n % 6 == 0, "2026-3-5").when(n % 6 == 1, "2024-02-30").when(n % 6 == 2, "nope")
        .when(n % 6 == 3, "2025-12-31T10:00").when(n % 6 == 4, "").alias("document_date"),
    )


_sql(
    "v_texts",
    f"""SELECT doc_id, 'd' || doc_id AS source, CASE WHEN doc_id % 17 <> 0 THEN lang END AS user_id,
  'doc_' || doc_id || {sql_list(EXTENSIONS)}[(doc_id % 8) + 1] AS filename,
  CASE WHEN doc_id % 31 <> 30 THEN CASE doc_id % 5 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10))
    WHEN 1 THEN replace(text, chr(10), chr(10) || '- ') WHEN 2 THEN '# Título' || chr(10) || text
    WHEN 3 THEN '  ' || chr(160) || text || chr(9) || chr(10) || ' ' || chr(8195) ELSE text END END AS text,
  CASE doc_id % 6 WHEN 0 THEN '2026-3-5' WHEN 1 THEN '2024-02-30' WHEN 2 THEN 'nope' WHEN 3 THEN '2025-12-31T10:00'
    WHEN 4 THEN '' END AS document_date FROM documents""",
)


# --- text lines ------------------------------------------------------------

def lines(spark: SparkSession, d: str) -> DataFrame:
    """Newline pieces of every document, in order; a stand-in for stored chunks."""
    return documents(spark, d).select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")
    ).withColumn("pos", F.col("pos").cast("bigint"))


_sql(
    "v_lines",
    """SELECT doc_id, lang, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, unnest(parts) AS content
FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)""",
)


# --- stored and incoming index rows ----------------------------------------

def _index_key(df: DataFrame) -> DataFrame:
    key = F.sha2(F.concat_ws("\x1f", "content", "source", F.col("chunk_index").cast("string")), 256)
    return df.select("source", "chunk_index", "content", key.alias("chunk_key"))


def index_current(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation row and every page as stored chunks."""
    conv = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"),
        F.col("turn").alias("chunk_index"), F.col("text").alias("content"),
    )
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"),
        F.lit(0).cast("bigint").alias("chunk_index"), F.col("html").alias("content"),
    )
    return _index_key(conv.unionByName(pages))


def index_incoming(spark: SparkSession, d: str) -> DataFrame:
    """The conversations again, system rows gone and some rows edited, and all labels as new sources."""
    edited = (F.col("conv_id") + F.col("turn")) % 4 == 0
    conv = table(spark, d, "conversations").filter(F.col("role") != "system").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"),
        F.col("turn").alias("chunk_index"),
        F.when(edited, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")).alias("content"),
    )
    labels = table(spark, d, "labels").select(
        F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("source"),
        F.lit(0).cast("bigint").alias("chunk_index"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"),
    )
    return _index_key(conv.unionByName(labels))


_SQL_KEY = "sha256(content || chr(31) || source || chr(31) || chunk_index) AS chunk_key"
_sql(
    "v_index_current",
    f"""SELECT *, {_SQL_KEY} FROM (SELECT 'c' || conv_id AS source, turn AS chunk_index, text AS content FROM conversations
  UNION ALL SELECT 'p' || page_id, 0, html FROM pages)""",
)
_sql(
    "v_index_incoming",
    f"""SELECT *, {_SQL_KEY} FROM (SELECT 'c' || conv_id AS source, turn AS chunk_index,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN text || ' (edited)' ELSE text END AS content FROM conversations WHERE role <> 'system'
  UNION ALL SELECT 'l' || doc_id, 0, 'quality ' || quality FROM labels)""",
)


def records(spark: SparkSession, d: str) -> DataFrame:
    return index_current(spark, d).select(
        F.col("chunk_key").alias("key"), F.lit("main").alias("namespace"), F.col("source").alias("group_id"),
        F.col("chunk_index").cast("double").alias("updated_at"),
    )


_sql(
    "v_records",
    """SELECT chunk_key AS key, 'main' AS namespace, source AS group_id, CAST(chunk_index AS DOUBLE) AS updated_at
FROM v_index_current""",
    ("v_index_current",),
)


# --- conversations ---------------------------------------------------------

TOOLS = [RETRIEVER_TOOL, WEB_TOOL, NOTE_TOOL]


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation rows as graph messages: long assistant rows play tool outputs, system rows synthetic ones."""
    n, t = F.col("conv_id"), F.col("turn")
    long_row = (F.col("role") == "assistant") & (F.length("text") > 500)
    role = (
        F.when(long_row, "tool").when(F.col("role") == "assistant", "ai").otherwise("human")
    )
    content = (
        F.when(F.col("role") == "system", F.concat(F.lit("[SISTEMA]: "), "text"))
        .when(long_row & ((n + t) % 11 == 0), F.concat(F.lit("ERROR_TOOL: "), "text"))
        .when(long_row & ((n + t) % 7 == 0), F.concat(F.lit("No encontré nada. "), "text"))
        .when((role == "ai") & (n % 5 == 0), F.concat("text", F.lit("\n### Fuentes\n- doc")))
        .when((role == "ai") & (n % 5 == 1), F.lit(" "))
        .otherwise(F.col("text"))
    )
    return table(spark, d, "conversations").select(
        n.alias("thread_id"),
        t.alias("seq"),
        F.concat_ws("-", n.cast("string"), t.cast("string")).alias("id"),
        role.alias("role"),
        F.when(role == "tool", pick(TOOLS, (n + t) % 3)).alias("name"),
        F.when((role == "ai") & ((n + t) % 5 == 0), F.array(F.lit(WEB_TOOL)))
        .otherwise(F.array().cast("array<string>"))
        .alias("tool_calls"),
        content.alias("content"),
    )


_sql(
    "v_messages",
    f"""SELECT conv_id AS thread_id, turn AS seq, conv_id || '-' || turn AS id, r AS role,
  CASE WHEN r = 'tool' THEN {sql_list(TOOLS)}[((conv_id + turn) % 3) + 1] END AS name,
  CASE WHEN r = 'ai' AND (conv_id + turn) % 5 = 0 THEN ['{WEB_TOOL}'] ELSE CAST([] AS VARCHAR[]) END AS tool_calls,
  CASE WHEN role = 'system' THEN '[SISTEMA]: ' || text
    WHEN r = 'tool' AND (conv_id + turn) % 11 = 0 THEN 'ERROR_TOOL: ' || text
    WHEN r = 'tool' AND (conv_id + turn) % 7 = 0 THEN 'No encontré nada. ' || text
    WHEN r = 'ai' AND conv_id % 5 = 0 THEN text || chr(10) || '### Fuentes' || chr(10) || '- doc'
    WHEN r = 'ai' AND conv_id % 5 = 1 THEN ' ' ELSE text END AS content
FROM (SELECT *, CASE WHEN role = 'assistant' AND length(text) > 500 THEN 'tool'
   WHEN role = 'assistant' THEN 'ai' ELSE 'human' END AS r FROM conversations)""",
)


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant row rated by its thread's labelled document: quality gives the score, toxic a correction.

    Threads without a label are not rated: score 0, no correction.
    """
    conv = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    labels = table(spark, d, "labels")
    n, t = F.col("conv_id"), F.col("turn")
    return conv.join(labels, n == F.col("doc_id"), "left").select(
        F.concat_ws("-", F.lit("fb"), n.cast("string"), t.cast("string")).alias("id"),
        n.cast("string").alias("thread_id"),
        F.when(n % 13 != 0, F.concat(F.lit("question "), n.cast("string"))).alias("user_prompt"),
        F.when(t % 4 != 3, F.col("text")).alias("ai_response"),
        F.when(F.col("quality") == 1, 1).when(F.col("quality").isNull() | (n % 10 == 0), 0).otherwise(-1).cast("bigint").alias("score"),
        F.when(n % 2 == 0, F.concat(F.lit("better "), F.col("toxic").cast("string"))).alias("user_correction"),
        micros(F.lit(EPOCH_2024) + n * HOUR + t * MINUTE).alias("timestamp"),
    )


_sql(
    "v_feedback",
    f"""SELECT 'fb-' || conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS thread_id,
  CASE WHEN conv_id % 13 <> 0 THEN 'question ' || conv_id END AS user_prompt,
  CASE WHEN turn % 4 <> 3 THEN text END AS ai_response,
  CAST(CASE WHEN quality = 1 THEN 1 WHEN quality IS NULL OR conv_id % 10 = 0 THEN 0 ELSE -1 END AS BIGINT) AS score,
  CASE WHEN conv_id % 2 = 0 THEN 'better ' || toxic END AS user_correction,
  make_timestamp({EPOCH_2024} + conv_id * {HOUR} + turn * {MINUTE}) AS timestamp
FROM conversations LEFT JOIN labels ON conv_id = doc_id WHERE role = 'assistant'""",
)


# --- runs and frames -------------------------------------------------------

def runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    e = event_times(spark, d).withColumn("k", prop_k())
    return e.select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("event_type").alias("name"),
        F.col("ts").alias("start_time"),
        F.when(k % 9 != 0, micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("bigint"))).alias("end_time"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.when(F.col("user_id") % 6 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("thread_id"),
        F.when(k % 4 == 0, "smoke").alias("test_type"),
        F.when(k % 8 != 0, F.array(F.col("event_type"), F.concat(F.lit("k"), k.cast("string")))).alias("tags"),
        F.when(k % 10 != 0, k).alias("prompt_tokens"),
        (k * 2).alias("completion_tokens"),
        (k * 3).alias("total_tokens"),
        F.when(k % 10 != 0, k / 1000).alias("total_cost"),
        (F.col("event_type") != "view").alias("is_root"),
    )


_sql(
    "v_runs",
    f"""SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS name, ts AS start_time,
  CASE WHEN k % 9 <> 0 THEN make_timestamp(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT)) END AS end_time,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN user_id % 6 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id, 't' || (user_id % 20) AS thread_id,
  CASE WHEN k % 4 = 0 THEN 'smoke' END AS test_type,
  CASE WHEN k % 8 <> 0 THEN [event_type, 'k' || k] END AS tags,
  CASE WHEN k % 10 <> 0 THEN k END AS prompt_tokens, k * 2 AS completion_tokens, k * 3 AS total_tokens,
  CASE WHEN k % 10 <> 0 THEN k / 1000 END AS total_cost, event_type <> 'view' AS is_root
FROM (SELECT *, {SQL_K} AS k FROM events)""",
)


def graph_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as runtime events of one assistant turn per user and day."""
    k, kind = F.col("k"), F.col("event_type")
    e = event_times(spark, d).withColumn("k", prop_k())
    event = (
        F.when(kind == "signup", "on_chat_model_start")
        .when(kind.isin("click", "view"), "on_chat_model_stream")
        .when(kind == "purchase", F.when(k % 2 == 0, "on_tool_start").otherwise("on_tool_end"))
        .when(k % 3 == 0, "on_chain_end")
        .when(k % 3 == 1, "on_chain_start")
        .otherwise("on_error")
    )
    name = (
        F.when(kind == "purchase", pick(TOOLS, k % 3))
        .when((kind == "error") & (k % 3 == 0), "task_planner")
        .when((kind == "error") & (k % 3 == 1), pick(["grade_documents", "grade_hallucinations", "agent"], k % 5 % 3))
        .otherwise("model")
    )
    content = (
        F.when(kind.isin("click", "view"), F.when(k % 10 == 0, " ").when(k % 10 == 1, "").otherwise(F.concat(F.lit("w"), k.cast("string"), F.lit(" "))))
        .when((kind == "error") & (k % 3 == 2), "boom")
    )
    data = F.when(kind.isin("purchase", "error"), F.col("props"))
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("turn_id"),
        F.col("event_id").alias("seq"),
        "ts",
        event.alias("event"),
        name.alias("name"),
        (k % 12 != 0).alias("is_generation"),
        content.alias("content"),
        data.alias("data"),
    )


_sql(
    "v_graph_events",
    f"""SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS turn_id, event_id AS seq, ts,
  CASE WHEN event_type = 'signup' THEN 'on_chat_model_start'
    WHEN event_type IN ('click', 'view') THEN 'on_chat_model_stream'
    WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'on_tool_start' ELSE 'on_tool_end' END
    WHEN k % 3 = 0 THEN 'on_chain_end' WHEN k % 3 = 1 THEN 'on_chain_start' ELSE 'on_error' END AS event,
  CASE WHEN event_type = 'purchase' THEN {sql_list(TOOLS)}[(k % 3) + 1]
    WHEN event_type = 'error' AND k % 3 = 0 THEN 'task_planner'
    WHEN event_type = 'error' AND k % 3 = 1 THEN ['grade_documents', 'grade_hallucinations', 'agent'][(k % 5 % 3) + 1]
    ELSE 'model' END AS name,
  k % 12 <> 0 AS is_generation,
  CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k % 10 = 0 THEN ' ' WHEN k % 10 = 1 THEN '' ELSE 'w' || k || ' ' END
    WHEN event_type = 'error' AND k % 3 = 2 THEN 'boom' END AS content,
  CASE WHEN event_type IN ('purchase', 'error') THEN props END AS data
FROM (SELECT *, {SQL_K} AS k FROM events)""",
)


# --- web results -----------------------------------------------------------

def web_results(spark: SparkSession, d: str) -> DataFrame:
    """Pages as search hits of the question 'site number': up to a handful of ranked results per question."""
    p = F.col("page_id")
    return table(spark, d, "pages").select(
        F.floor(p / 6).alias("query_id"),
        (p % 6).alias("position"),
        F.when(p % 5 != 0, F.concat(F.lit("Page "), p.cast("string"))).alias("title"),
        F.when(p % 7 != 0, F.col("url")).alias("link"),
        F.when(p % 9 != 0, F.col("html")).alias("snippet"),
    )


_sql(
    "v_web_results",
    """SELECT page_id // 6 AS query_id, page_id % 6 AS position,
  CASE WHEN page_id % 5 <> 0 THEN 'Page ' || page_id END AS title,
  CASE WHEN page_id % 7 <> 0 THEN url END AS link, CASE WHEN page_id % 9 <> 0 THEN html END AS snippet FROM pages""",
)


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """One stored text per URL; every fourth page is unreadable."""
    return (
        table(spark, d, "pages")
        .groupBy("url")
        .agg(F.min("page_id").alias("p"))
        .select(
            "url",
            F.when(F.col("p") % 4 != 0, F.concat(F.lit("text of page "), F.col("p").cast("string")))
            .otherwise("")
            .alias("text"),
        )
    )


_sql(
    "v_page_texts",
    """SELECT url, CASE WHEN min(page_id) % 4 <> 0 THEN 'text of page ' || min(page_id) ELSE '' END AS text
FROM pages GROUP BY url""",
)
