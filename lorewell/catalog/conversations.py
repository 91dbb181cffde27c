"""Pages, notes, chats, memory, audit, frame and feedback queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.catalog import views as V
from lorewell.catalog.texts import BLANKS, sql_strip, sql_words
from lorewell.functions import text as T
from lorewell.operators import audit as A
from lorewell.operators import chats as C
from lorewell.operators import feedback as FB
from lorewell.operators import frames as E
from lorewell.operators import memory as M
from lorewell.operators import notes as N
from lorewell.operators import pages as P
from lorewell.schemas import DOCUMENT_EVENT
from lorewell.session import spread

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- pages and notes ---------------------------------------------------------

@query
def page_paragraphs(spark, d):
    return P.page_paragraphs(spread(V.table(spark, d, "pages"), "page_id"))


@query
def assemble_results(spark, d):
    questions = V.table(spark, d, "pages").select(F.col("page_id").alias("query_id"))
    return P.assemble_results(V.web_results(spark, d), V.page_texts(spark, d), questions)


SQL["assemble_results"] = V.with_views(
    "v_web_results v_page_texts",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS nth FROM v_web_results),
c AS (SELECT r.query_id, nth, '- Título: ' || coalesce(title, 'Sin título') || chr(10) || '  URL: ' || coalesce(link, '#') || chr(10) || '  Contenido: ' ||
   CASE WHEN nth <= 2 AND length(t.text) > 0 AND link <> '#' THEN '{K.WEB_PAGE_LABEL}' || t.text || '...'
     ELSE '{K.WEB_SNIPPET_LABEL}' || coalesce(snippet, '') || '...' END AS item
  FROM r LEFT JOIN v_page_texts t ON r.link = t.url WHERE nth <= 4),
a AS (SELECT query_id, 'Resultados de la Búsqueda Profunda Web:' || chr(10) || chr(10) || string_agg(item, chr(10) || chr(10) ORDER BY nth) AS answer FROM c GROUP BY query_id)
SELECT page_id AS query_id, coalesce(answer, '{K.WEB_NOTHING}') AS answer FROM pages LEFT JOIN a ON page_id = a.query_id""",
)

NOTE_TIME = "2026-03-05 06:07:08"


@query
def note_events(spark, d):
    """Every document as a note titled by its first line."""
    n = F.col("doc_id")
    notes = V.documents(spark, d).select(
        V.uuid_text(n.cast("string")).alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.when(n % 2 == 0, "technical_doc").alias("doc_type"), F.when(n % 3 != 0, F.col("lang")).alias("user_id"),
    )
    events = N.note_events(notes, F.lit(NOTE_TIME).cast("timestamp"))
    event = F.from_json("value", DOCUMENT_EVENT).alias("e")
    meta = [F.col("e.metadata")[k].alias(f"metadata_{k}") for k in ("source", "doc_type", "title", "created_at", "origin")]
    return events.select("key", event).select("key", "e.doc_id", "e.filename", "e.user_id", "e.content", *meta)


SQL["note_events"] = rf"""WITH n AS (SELECT {V.sql_uuid("CAST(doc_id AS VARCHAR)")} AS doc_id, string_split(text, chr(10))[1] AS title, text AS content,
  CASE WHEN doc_id % 2 = 0 THEN 'technical_doc' ELSE 'general' END AS doc_type, CASE WHEN doc_id % 3 <> 0 THEN lang END AS user_id FROM documents),
f AS (SELECT *, 'agent_notes/' || substr(regexp_replace(regexp_replace({sql_strip('lower(title)')}, '[^{T.WORD_CLASS}{T.BLANK_CLASS}-]', '', 'g'),
  '[{T.BLANK_CLASS}_-]+', '_', 'g'), 1, 60) || '_20260305_060708.md' AS filename FROM n)
SELECT doc_id AS key, doc_id, filename, user_id, '# ' || title || chr(10) || chr(10) || content AS content, filename AS metadata_source,
  doc_type AS metadata_doc_type, title AS metadata_title, '2026-03-05T06:07:08' AS metadata_created_at, 'agent_generated' AS metadata_origin FROM f"""


# --- chats -------------------------------------------------------------------

def _turns(spark, d):
    """Conversation rows as incoming messages of their threads."""
    n, t = F.col("conv_id"), F.col("turn")
    return V.table(spark, d, "conversations").select(
        n.alias("thread_id"), F.when(n % 5 != 0, F.concat(F.lit("u"), (n % 4).cast("string"))).alias("user_id"),
        F.col("text").alias("message"), V.micros(F.lit(V.EPOCH_2024) + n * V.MINUTE + t * 1_000_000).alias("ts"),
        t.alias("seq"), F.concat_ws("-", n.cast("string"), t.cast("string")).alias("turn_id"),
        F.when(F.col("role") == "user", F.concat(F.lit("re: "), "text")).when(F.col("role") == "system", F.lit("")).alias("answer"),
    )


_TURNS = f"""turns AS (SELECT conv_id AS thread_id, CASE WHEN conv_id % 5 <> 0 THEN 'u' || (conv_id % 4) END AS user_id, text AS message,
  make_timestamp({V.EPOCH_2024} + conv_id * {V.MINUTE} + turn * 1000000) AS ts, turn AS seq, conv_id || '-' || turn AS turn_id,
  CASE role WHEN 'user' THEN 're: ' || text WHEN 'system' THEN '' END AS answer FROM conversations)"""


def _known_chats(spark, d):
    """Threads named like a labelled document exist already."""
    return V.table(spark, d, "labels").select(
        F.col("doc_id").alias("thread_id"), F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string")).alias("user_id"),
        F.lit("known").alias("title"), V.micros(F.lit(V.EPOCH_2024) - F.col("doc_id") * V.HOUR).alias("created_at"),
    ).withColumn("updated_at", F.col("created_at"))


_KNOWN = f"""known AS (SELECT doc_id AS thread_id, 'u' || (doc_id % 4) AS user_id, 'known' AS title,
  make_timestamp({V.EPOCH_2024} - doc_id * {V.HOUR}) AS created_at FROM labels)"""


@query
def create_chats(spark, d):
    return C.create_chats(_turns(spark, d), _known_chats(spark, d))


SQL["create_chats"] = f"""WITH {_TURNS}, {_KNOWN}, f AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, seq) AS rn FROM turns)
SELECT thread_id, user_id, title, created_at, created_at AS updated_at FROM known
UNION ALL SELECT thread_id, coalesce(user_id, 'anonymous'), CASE WHEN length(message) > 50 THEN substr(message, 1, 50) || '...' ELSE message END, ts, ts
FROM f WHERE rn = 1 AND thread_id NOT IN (SELECT thread_id FROM known)"""


@query
def list_chats(spark, d):
    return C.list_chats(_known_chats(spark, d))


SQL["list_chats"] = f"WITH {_KNOWN} SELECT user_id, thread_id, title, created_at FROM known ORDER BY 1, 4 DESC, 2"


def _stored_messages(spark, d):
    t = _turns(spark, d)
    return t.select(
        F.concat(F.lit("old-"), "turn_id").alias("id"), "thread_id", F.lit("user").alias("role"),
        F.col("message").alias("content"), F.col("ts").alias("created_at"), F.lit(-1).cast("bigint").alias("position"),
    )


@query
def append_messages(spark, d):
    return C.append_messages(_stored_messages(spark, d), _turns(spark, d))


_APPENDED = f"""WITH {_TURNS} SELECT 'old-' || turn_id AS id, thread_id, 'user' AS role, message AS content, ts AS created_at, CAST(-1 AS BIGINT) AS position FROM turns
UNION ALL SELECT turn_id || '-user', thread_id, 'user', message, ts, 0 FROM turns
UNION ALL SELECT turn_id || '-assistant', thread_id, 'assistant', answer, ts, 1 FROM turns WHERE length(answer) > 0"""
SQL["append_messages"] = _APPENDED


@query
def thread_messages(spark, d):
    return C.thread_messages(_stored_messages(spark, d))


SQL["thread_messages"] = f"""WITH {_TURNS} SELECT 'old-' || turn_id AS id, thread_id, 'user' AS role, message AS content, ts AS created_at,
  CAST(-1 AS BIGINT) AS position FROM turns ORDER BY thread_id, created_at"""


@query
def delete_threads(spark, d):
    """Threads with a system row are deleted from all four tables."""
    ids = V.table(spark, d, "conversations").filter(F.col("role") == "system").select(F.col("conv_id").alias("thread_id"))
    feedback = V.feedback(spark, d).withColumn("thread_id", F.col("thread_id").cast("bigint"))
    checkpoints = V.messages(spark, d).select("thread_id", "id")
    left = C.delete_threads(ids, _known_chats(spark, d), _stored_messages(spark, d), feedback, checkpoints)
    rows = None
    for name, table, key in (
        ("chat", left.chats, F.col("title")), ("message", left.messages, F.col("id")),
        ("feedback", left.feedback, F.col("id")), ("checkpoint", left.checkpoints, F.col("id")),
    ):
        part = table.select(F.lit(name).alias("kind"), "thread_id", key.alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


SQL["delete_threads"] = V.with_views(
    "v_feedback v_messages",
    f"""WITH {_TURNS}, {_KNOWN}, gone AS (SELECT conv_id AS thread_id FROM conversations WHERE role = 'system'),
a AS (SELECT 'chat' AS kind, thread_id, title AS id FROM known UNION ALL SELECT 'message', thread_id, 'old-' || turn_id FROM turns
  UNION ALL SELECT 'feedback', CAST(thread_id AS BIGINT), id FROM v_feedback UNION ALL SELECT 'checkpoint', thread_id, id FROM v_messages)
SELECT * FROM a WHERE thread_id NOT IN (SELECT thread_id FROM gone)""",
)


# --- memory ------------------------------------------------------------------

_REAL = "(role = 'human' AND NOT starts_with(content, '[SISTEMA]'))"


def _bounds(source: str) -> str:
    return f"""b AS (SELECT thread_id, max(seq) FILTER (WHERE {_REAL}) AS last_user, max(seq) AS last_row,
  max(seq) FILTER (WHERE role = 'ai') AS last_ai, count(*) FILTER (WHERE {_REAL}) AS user_rows,
  arg_max(content, seq) FILTER (WHERE {_REAL}) AS user_text, arg_max(content, seq) AS answer,
  max(seq) FILTER (WHERE role = 'ai' AND len(tool_calls) = 0) AS keep_answer FROM {source} GROUP BY thread_id)"""


_BOUNDS = _bounds("v_messages")


@query
def reduce_messages(spark, d):
    """Three versions of each message; the middle or the last one of some is a removal."""
    m = V.messages(spark, d).select("thread_id", "id", "seq", "content")
    n, base = F.col("thread_id") + F.col("seq"), F.col("seq") * 10
    edited = F.when(n % 3 != 0, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))
    versions = m.select(
        "thread_id", "id",
        F.explode(
            F.array(
                F.struct(base.alias("version"), F.lit(False).alias("removed"), F.col("content")),
                F.struct((base + 500).alias("version"), (n % 4 == 0).alias("removed"), F.lit("draft").alias("content")),
                F.struct((base + 1000).alias("version"), (n % 8 == 0).alias("removed"), edited.alias("content")),
            )
        ).alias("v"),
    ).select("thread_id", "id", "v.*")
    return M.reduce_messages(versions)


SQL["reduce_messages"] = V.with_views(
    "v_messages",
    """WITH n AS (SELECT *, thread_id + seq AS n FROM v_messages)
SELECT thread_id, id, CASE WHEN n % 4 = 0 THEN seq * 10 + 1000 ELSE seq * 10 END AS seq,
  CASE WHEN n % 3 <> 0 THEN content || ' (edited)' ELSE content END AS content FROM n WHERE n % 8 <> 0""",
)


@query
def reduce_run_summaries(spark, d):
    m = V.messages(spark, d)
    updates = m.select("thread_id", "seq", F.when(F.col("role") != "tool", F.col("content")).alias("summary"))
    return M.reduce_run_summaries(updates)


SQL["reduce_run_summaries"] = V.with_views(
    "v_messages",
    """WITH r AS (SELECT thread_id, max(seq) AS reset_at FROM v_messages WHERE role = 'tool' GROUP BY thread_id)
SELECT m.thread_id, m.seq, m.content AS summary FROM v_messages m LEFT JOIN r ON m.thread_id = r.thread_id
WHERE role <> 'tool' AND (reset_at IS NULL OR seq > reset_at)""",
)


@query
def current_turn(spark, d):
    return M.current_turn(V.messages(spark, d)).select("thread_id", "seq", "role")


SQL["current_turn"] = V.with_views(
    "v_messages",
    f"WITH {_BOUNDS} SELECT m.thread_id, seq, role FROM v_messages m JOIN b USING (thread_id) WHERE last_user IS NULL OR seq > last_user",
)


@query
def last_tool_batch(spark, d):
    return M.last_tool_batch(V.messages(spark, d)).select("thread_id", "seq", "name")


SQL["last_tool_batch"] = V.with_views(
    "v_messages",
    f"""WITH {_BOUNDS} SELECT m.thread_id, seq, name FROM v_messages m JOIN b USING (thread_id)
WHERE role = 'tool' AND (last_ai IS NULL OR seq > last_ai)""",
)


@query
def truncate_tool_rows(spark, d):
    return M.truncate_tool_rows(V.messages(spark, d), limit=900).select("thread_id", "id", "name", "content")


SQL["truncate_tool_rows"] = V.with_views(
    "v_messages",
    f"""SELECT thread_id, id, name, CASE WHEN role = 'tool' AND length(content) > 900 THEN '{K.TOOL_TEXT_PLACEHOLDER}' ELSE content END AS content
FROM v_messages""",
)

def _audited(spark, d):
    """Messages with one more assistant row per thread: tool code, a refusal, nothing, a call or plain text."""
    m = V.messages(spark, d)
    n = F.col("thread_id")
    no_calls = F.array().cast("array<string>")
    extra = m.groupBy("thread_id").agg((F.max("seq") + 1).alias("seq")).select(
        "thread_id", "seq", F.concat(F.lit("x"), n.cast("string")).alias("id"), F.lit("ai").alias("role"),
        F.lit(None).cast("string").alias("name"),
        F.when(n % 9 == 8, F.array(F.lit(K.WEB_TOOL))).otherwise(no_calls).alias("tool_calls"),
        F.when(n % 7 == 0, "call default_api.search()").when(n % 7 == 1, " \n").when(n % 7 == 2, "No encontré información sobre eso")
        .when(n % 7 == 3, "").otherwise("en fin el resumen").alias("content"),
    )
    return m.unionByName(extra)


_AUDITED = f"""audited AS (SELECT thread_id, seq, id, role, name, tool_calls, content FROM v_messages
  UNION ALL SELECT thread_id, max(seq) + 1, 'x' || thread_id, 'ai', NULL,
    CASE WHEN thread_id % 9 = 8 THEN ['{K.WEB_TOOL}'] ELSE CAST([] AS VARCHAR[]) END,
    CASE thread_id % 7 WHEN 0 THEN 'call default_api.search()' WHEN 1 THEN ' ' || chr(10) WHEN 2 THEN 'No encontré información sobre eso'
      WHEN 3 THEN '' ELSE 'en fin el resumen' END FROM v_messages GROUP BY thread_id)"""


_STEPS = """steps AS (SELECT m.* FROM audited m JOIN b USING (thread_id) WHERE seq > last_user AND seq < last_row)"""


@query
def turn_steps(spark, d):
    return M.turn_steps(_audited(spark, d))


SQL["turn_steps"] = V.with_views(
    "v_messages",
    f"""WITH {_AUDITED}, {_bounds("audited")}, {_STEPS} SELECT thread_id, seq, id, name, CASE role WHEN 'ai' THEN 'Asistente (Plan): ' || content
  WHEN 'tool' THEN 'Herramienta (' || coalesce(name, 'unknown') || '): ' || content END AS log_line FROM steps""",
)


@query
def summarize_turn(spark, d):
    return M.summarize_turn(_audited(spark, d))


SQL["summarize_turn"] = V.with_views(
    "v_messages",
    f"""WITH {_AUDITED}, {_bounds("audited")}, {_STEPS}, u AS (SELECT thread_id, name, min(seq) AS f FROM steps WHERE name IS NOT NULL GROUP BY ALL),
t AS (SELECT thread_id, string_agg(name, ', ' ORDER BY f) AS tools FROM u GROUP BY thread_id)
SELECT thread_id, user_text || ' → ' || coalesce(tools, '') || ' → ' || answer AS summary
FROM b LEFT JOIN t USING (thread_id) WHERE last_user IS NOT NULL""",
)


@query
def prune_turn(spark, d):
    return M.prune_turn(_audited(spark, d)).select("thread_id", "seq", "id")


SQL["prune_turn"] = V.with_views(
    "v_messages", f"WITH {_AUDITED}, {_bounds("audited")}, {_STEPS} SELECT thread_id, seq, id FROM audited WHERE id NOT IN (SELECT id FROM steps)"
)


@query
def collapse_conversation(spark, d):
    m = V.messages(spark, d)
    summaries = m.filter(F.col("role") == "tool").select("thread_id", "seq", F.col("content").alias("summary"))
    previous = m.filter(F.col("seq") == 0).select("thread_id", F.concat(F.lit("before: "), "id").alias("summary"))
    return M.collapse_conversation(m, summaries, previous)


_DUE = "due AS (SELECT * FROM b WHERE user_rows >= 4 AND last_user IS NOT NULL AND keep_answer IS NOT NULL)"
SQL["collapse_conversation"] = V.with_views(
    "v_messages",
    f"""WITH {_BOUNDS}, {_DUE}, l AS (SELECT thread_id, 0 AS part, seq, 'before: ' || id AS line FROM v_messages WHERE seq = 0
  UNION ALL SELECT m.thread_id, 1, seq, role || ': ' || content FROM v_messages m JOIN due USING (thread_id) WHERE seq <> last_user AND seq <> keep_answer
  UNION ALL SELECT thread_id, 2, seq, 'Turno: ' || content FROM v_messages WHERE role = 'tool')
SELECT thread_id, string_agg(line, chr(10) ORDER BY part, seq) AS summary FROM l
WHERE thread_id IN (SELECT thread_id FROM due) GROUP BY thread_id""",
)


@query
def collapsed_messages(spark, d):
    return M.collapsed_messages(V.messages(spark, d)).select("thread_id", "seq", "id")


SQL["collapsed_messages"] = V.with_views(
    "v_messages",
    f"""WITH {_BOUNDS}, {_DUE} SELECT m.thread_id, seq, id FROM v_messages m LEFT JOIN due USING (thread_id)
WHERE due.last_user IS NULL OR seq IN (due.last_user, due.keep_answer)""",
)


def _with_summaries(spark, d):
    """Some threads open with a stored summary instead of a synthetic row."""
    m = V.messages(spark, d)
    stored = F.startswith("content", F.lit(K.SYNTHETIC_PREFIX)) & (F.col("thread_id") % 2 == 0)
    return m.withColumn("role", F.when(stored, "system").otherwise(F.col("role"))).withColumn(
        "content", F.when(stored, F.concat(F.lit(K.SUMMARY_PREFIX + " "), "content")).otherwise(F.col("content"))
    )


@query
def planner_context(spark, d):
    return M.planner_context(_with_summaries(spark, d))


SQL["planner_context"] = V.with_views(
    "v_messages",
    f"""WITH m AS (SELECT thread_id, seq, CASE WHEN s THEN 'system' ELSE role END AS role, tool_calls,
   CASE WHEN s THEN '{K.SUMMARY_PREFIX} ' || content ELSE content END AS content
   FROM (SELECT *, starts_with(content, '[SISTEMA]') AND thread_id % 2 = 0 AS s FROM v_messages)),
s AS (SELECT thread_id, arg_min(content, seq) AS first FROM m WHERE role = 'system' GROUP BY thread_id),
r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS rn FROM m WHERE role = 'ai' AND len(tool_calls) = 0 AND length(content) > 0),
a AS (SELECT thread_id, string_agg('  - ' || content, chr(10) ORDER BY seq) AS answers FROM r WHERE rn <= 2 GROUP BY thread_id)
SELECT t.thread_id, coalesce('{K.PREVIOUS_SUMMARY}' || first, '{K.PREVIOUS_ANSWERS}' || chr(10) || answers, '{K.NO_CONVERSATION}') AS context
FROM (SELECT DISTINCT thread_id FROM m) t LEFT JOIN s USING (thread_id) LEFT JOIN a USING (thread_id)""",
)


# --- audit -------------------------------------------------------------------

def _turn_state(spark, d):
    """One row of counters and a plan per thread."""
    n = F.col("thread_id")
    step = lambda tool, done: F.struct(
        F.lit(tool).alias("tool"), F.concat(F.lit("because "), n.cast("string")).alias("reason"), F.lit(done).alias("done")
    )
    empty = F.array().cast("array<struct<tool:string,reason:string,done:boolean>>")
    plan = (
        F.when(n % 4 == 0, empty)
        .when(n % 4 == 1, F.array(step(K.RETRIEVER_TOOL, False)))
        .when(n % 4 == 2, F.array(step(K.WEB_TOOL, False), step(K.NOTE_TOOL, False)))
        .otherwise(F.array(step(K.NOTE_TOOL, True), step(K.RETRIEVER_TOOL, False)))
    )
    return V.messages(spark, d).select("thread_id").distinct().select(
        "thread_id", (n % 3).alias("generate_retry_count"), (n % 2).alias("retrieve_retry_count"),
        F.when(n % 5 != 0, n % 2).alias("docs_parse_retries"), (n % 4).alias("hallucinations_parse_retries"),
        plan.alias("task_plan"),
    )


_SEARCH = "(role = 'tool' AND name IN ('knowledge_base_retriever', 'web_search'))"


def _features(source: str) -> str:
    return f"""f0 AS (SELECT thread_id, arg_max(content, seq) AS last_content, arg_max(len(tool_calls), seq) AS n_calls,
  max(seq) FILTER (WHERE {_REAL}) AS last_user, arg_max(content, seq) FILTER (WHERE {_REAL}) AS question,
  max(seq) FILTER (WHERE role = 'ai') AS last_ai, max(seq) FILTER (WHERE {_SEARCH}) AS last_search FROM {source} GROUP BY thread_id),
f AS (SELECT *, last_search IS NOT NULL AND (last_user IS NULL OR last_search > last_user) AS search_used,
  last_search IS NOT NULL AND (last_ai IS NULL OR last_search > last_ai) AS search_in_batch FROM f0)"""


@query
def next_step(spark, d):
    return A.next_step(_audited(spark, d), _turn_state(spark, d))


SQL["next_step"] = V.with_views(
    "v_messages",
    f"""WITH {_AUDITED}, {_features('audited')}, r AS (SELECT thread_id, CASE WHEN n_calls > 0 THEN 'tool_calls'
  WHEN (contains(last_content, 'tool_code') OR contains(last_content, 'default_api') OR contains(last_content, 'knowledge_base_retriever(')) AND thread_id % 3 < 2 THEN 'tool_code'
  WHEN length(trim(last_content, {BLANKS})) = 0 AND search_used AND thread_id % 3 < 2 THEN 'no_synthesis'
  WHEN length(trim(last_content, {BLANKS})) = 0 THEN 'empty' WHEN search_used THEN 'searched' ELSE 'plain' END AS reason FROM f)
SELECT thread_id, reason, CASE reason WHEN 'tool_calls' THEN 'tools' WHEN 'tool_code' THEN 'agent' WHEN 'no_synthesis' THEN 'agent'
  WHEN 'searched' THEN 'grade_generation_vs_documents' ELSE 'cleanup_rag_memory' END AS step FROM r""",
)


@query
def route_after_tools(spark, d):
    return A.route_after_tools(V.messages(spark, d))


SQL["route_after_tools"] = V.with_views(
    "v_messages",
    f"WITH {_features('v_messages')} SELECT thread_id, CASE WHEN search_in_batch THEN 'grade_documents' ELSE 'agent' END AS step FROM f",
)


@query
def triage_search_output(spark, d):
    return A.triage_search_output(V.messages(spark, d), _turn_state(spark, d))


_BATCH = f"""batch AS (SELECT m.thread_id, m.seq, m.content FROM v_messages m JOIN f USING (thread_id)
  WHERE {_SEARCH} AND (last_ai IS NULL OR m.seq > last_ai))"""
SQL["triage_search_output"] = V.with_views(
    "v_messages",
    f"""WITH {_features('v_messages')}, {_BATCH},
g AS (SELECT thread_id, bool_or(contains(content, 'ERROR_TOOL:')) AS failed,
  bool_or(contains(content, 'No encontré') OR contains(content, 'La búsqueda web no arrojó')) AS empty FROM batch GROUP BY thread_id),
c AS (SELECT f.thread_id, failed, empty, f.thread_id % 2 + CASE WHEN failed THEN 1 ELSE 0 END AS n FROM f LEFT JOIN g USING (thread_id))
SELECT thread_id, CASE WHEN failed IS NULL THEN 'skip' WHEN failed AND n >= 2 THEN 'give_up' WHEN failed THEN 'retry' WHEN empty THEN 'no_results'
  ELSE 'grade' END AS outcome, n AS retrieve_retry_count, CASE WHEN n > 0 AND n < 2 THEN 'rewrite_query' ELSE 'agent' END AS route FROM c""",
)


@query
def grade_relevance(spark, d):
    return A.grade_relevance(V.messages(spark, d), _turn_state(spark, d))


SQL["grade_relevance"] = V.with_views(
    "v_messages",
    f"""WITH {_features('v_messages')}, {_BATCH},
q AS (SELECT DISTINCT thread_id, unnest({sql_words('question')}) AS term FROM f WHERE thread_id IN (SELECT thread_id FROM batch)),
h AS (SELECT DISTINCT thread_id, unnest({sql_words('content')}) AS term FROM batch),
s AS (SELECT q.thread_id, round(avg(CASE WHEN h.term IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS share
  FROM q LEFT JOIN h ON q.thread_id = h.thread_id AND q.term = h.term GROUP BY q.thread_id)
SELECT thread_id, share, CASE WHEN share >= 0.3 THEN 'yes' ELSE 'no' END AS grade,
  CASE WHEN share >= 0.3 THEN 'agent' WHEN coalesce(CASE WHEN thread_id % 5 <> 0 THEN thread_id % 2 END, 0) + 1 < 2 THEN 'search_again' ELSE 'agent' END AS action FROM s""",
)


@query
def grade_groundedness(spark, d):
    return A.grade_groundedness(_audited(spark, d), _turn_state(spark, d))


_FOUND = f"""found AS (SELECT m.thread_id, m.content FROM audited m JOIN f USING (thread_id)
  WHERE {_SEARCH} AND length(content) > 0 AND (last_user IS NULL OR m.seq > last_user))"""
_GROUNDED = f"""{_AUDITED}, {_features('audited')}, {_FOUND},
q AS (SELECT DISTINCT thread_id, unnest({sql_words('last_content')}) AS term FROM f),
h AS (SELECT DISTINCT thread_id, unnest({sql_words('content')}) AS term FROM found),
s AS (SELECT q.thread_id, round(avg(CASE WHEN h.term IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS share
  FROM q LEFT JOIN h ON q.thread_id = h.thread_id AND q.term = h.term GROUP BY q.thread_id),
g AS (SELECT t.thread_id, share FROM (SELECT DISTINCT thread_id FROM found) t LEFT JOIN s USING (thread_id))"""
SQL["grade_groundedness"] = V.with_views(
    "v_messages",
    f"""WITH {_GROUNDED} SELECT thread_id, share, CASE WHEN share IS NULL THEN CASE WHEN thread_id % 4 + 1 > 2 THEN 'accept' ELSE 'regrade' END
  WHEN share >= 0.6 THEN 'accept' WHEN thread_id % 3 + 1 < 2 THEN 'retry' ELSE 'refuse' END AS action FROM g""",
)

_STATE = """state AS (SELECT thread_id, unnest(plan).tool AS tool, generate_subscripts(plan, 1) - 1 AS step, unnest(plan).done AS done FROM
  (SELECT thread_id, CASE thread_id % 4 WHEN 1 THEN [{'tool': 'knowledge_base_retriever', 'done': false}]
     WHEN 2 THEN [{'tool': 'web_search', 'done': false}, {'tool': 'save_note_to_knowledge_base', 'done': false}]
     WHEN 3 THEN [{'tool': 'save_note_to_knowledge_base', 'done': true}, {'tool': 'knowledge_base_retriever', 'done': false}] END AS plan
   FROM (SELECT DISTINCT thread_id FROM v_messages)))"""


def _used(source: str) -> str:
    return f"""used AS (SELECT m.thread_id, m.name AS tool, replace(arg_min(content, m.seq), chr(10), ' ') AS snippet
  FROM {source} m JOIN f USING (thread_id) WHERE role = 'tool' AND (last_user IS NULL OR m.seq > last_user) GROUP BY m.thread_id, m.name),
steps AS (SELECT s.thread_id, s.step, s.tool, s.done OR u.tool IS NOT NULL AS done, u.snippet FROM state s
  LEFT JOIN used u ON s.thread_id = u.thread_id AND s.tool = u.tool)"""


@query
def plan_steps(spark, d):
    return A.plan_steps(V.messages(spark, d), _turn_state(spark, d))


SQL["plan_steps"] = V.with_views(
    "v_messages",
    f"""WITH {_STATE}, {_features('v_messages')}, {_used('v_messages')}
SELECT thread_id, step, tool, 'because ' || thread_id AS reason, done, snippet FROM steps""",
)


@query
def plan_completion(spark, d):
    return A.plan_completion(V.messages(spark, d), _turn_state(spark, d))


SQL["plan_completion"] = V.with_views(
    "v_messages",
    f"""WITH {_STATE}, {_features('v_messages')}, {_used('v_messages')},
p AS (SELECT thread_id, string_agg(tool, ', ' ORDER BY step) AS pending FROM steps WHERE NOT done GROUP BY thread_id)
SELECT thread_id, CASE WHEN pending IS NULL THEN 'ok' WHEN thread_id % 3 >= 2 THEN 'give_up' ELSE 'retry' END AS verdict, coalesce(pending, '') AS pending
FROM f LEFT JOIN p USING (thread_id)""",
)


@query
def declined_without_search(spark, d):
    return A.declined_without_search(_audited(spark, d), _turn_state(spark, d))


SQL["declined_without_search"] = V.with_views(
    "v_messages",
    f"""WITH {_AUDITED}, {_STATE}, {_features('audited')}, {_used('audited')},
p AS (SELECT thread_id, bool_or(snippet IS NOT NULL) AS any_used FROM steps WHERE tool IN ('knowledge_base_retriever', 'web_search') GROUP BY thread_id),
x AS (SELECT thread_id, (contains(last_content, 'Lo siento, no pude obtener datos') OR contains(last_content, 'La búsqueda no arrojó resultados')
  OR contains(last_content, 'No encontré información')) AND NOT coalesce(any_used, true) AS declined FROM f LEFT JOIN p USING (thread_id))
SELECT thread_id, declined, declined AND thread_id % 3 < 2 AS nudge FROM x""",
)


@query
def called_tools(spark, d):
    return A.called_tools(V.messages(spark, d))


SQL["called_tools"] = V.with_views(
    "v_messages",
    """SELECT thread_id, seq, generate_subscripts(tool_calls, 1) - 1 AS position, unnest(tool_calls) AS tool
FROM v_messages WHERE role = 'ai'""",
)


@query
def planned_tools(spark, d):
    return A.planned_tools(_turn_state(spark, d))


SQL["planned_tools"] = V.with_views("v_messages", f"WITH {_STATE} SELECT thread_id, step, tool FROM state")


@query
def tool_selection_accuracy(spark, d):
    expected = V.messages(spark, d).select("thread_id").distinct().withColumn(
        "expected_tool", F.when(F.col("thread_id") % 2 == 0, K.WEB_TOOL).otherwise(K.RETRIEVER_TOOL)
    )
    return A.tool_selection_accuracy(V.messages(spark, d), expected)


SQL["tool_selection_accuracy"] = V.with_views(
    "v_messages",
    """WITH e AS (SELECT DISTINCT thread_id, CASE WHEN thread_id % 2 = 0 THEN 'web_search' ELSE 'knowledge_base_retriever' END AS expected_tool FROM v_messages),
c AS (SELECT DISTINCT thread_id, unnest(tool_calls) AS tool FROM v_messages WHERE role = 'ai')
SELECT expected_tool, count(*) AS cases, round(avg(CASE WHEN c.tool IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy
FROM e LEFT JOIN c ON e.thread_id = c.thread_id AND e.expected_tool = c.tool GROUP BY expected_tool""",
)


@query
def retry_counters(spark, d):
    kinds = {"click": "retrieve", "view": "generate", "purchase": "docs_parse", "error": "hallucinations_parse"}
    kind = F.lit(None)
    for event_type, name in kinds.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    retries = V.event_times(spark, d).select(
        F.col("user_id").alias("thread_id"), F.date_format("ts", "yyyy-MM-dd").alias("turn"), kind.alias("kind")
    )
    return A.retry_counters(retries)


SQL["retry_counters"] = """SELECT user_id AS thread_id, strftime(ts, '%Y-%m-%d') AS turn,
  least(count(*) FILTER (WHERE event_type = 'click'), 2) AS retrieve_retry_count,
  least(count(*) FILTER (WHERE event_type = 'view'), 2) AS generate_retry_count,
  least(count(*) FILTER (WHERE event_type = 'purchase'), 2) AS docs_parse_retries,
  least(count(*) FILTER (WHERE event_type = 'error'), 2) AS hallucinations_parse_retries FROM events GROUP BY ALL"""


# --- frames ------------------------------------------------------------------

_GEN_START = "(event = 'on_chat_model_start' AND is_generation)"
_TOKEN = "(event = 'on_chat_model_stream' AND is_generation AND length(coalesce(content, '')) > 0)"
_FRAMES = f"""seg AS (SELECT *, sum(CASE WHEN {_GEN_START} THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id ORDER BY seq) AS segment FROM v_graph_events),
shown AS (SELECT turn_id, segment, bool_or(length(trim(content, {BLANKS})) > 0) AS shown FROM seg WHERE {_TOKEN} GROUP BY ALL),
marked AS (SELECT s.*, {_GEN_START} AND coalesce(p.shown, false) AS restart FROM seg s LEFT JOIN shown p ON s.turn_id = p.turn_id AND s.segment = p.segment + 1),
typed AS (SELECT *, CASE WHEN restart THEN 'status' WHEN event = 'on_chain_end' AND name = 'task_planner' THEN 'plan' WHEN {_TOKEN} THEN 'token'
  WHEN event = 'on_tool_start' THEN 'tool-start' WHEN event = 'on_tool_end' THEN 'tool-end'
  WHEN event = 'on_chain_start' AND name IN ('grade_documents', 'grade_hallucinations') THEN 'status' WHEN event = 'on_error' THEN 'error' END AS type FROM marked),
frames AS (SELECT turn_id, seq, ts, type, CASE WHEN event = 'on_chat_model_start' THEN '{K.CORRECTION_NOTICE}'
    WHEN event = 'on_chain_start' AND name = 'grade_documents' THEN '{K.GRADING_NOTICE}' WHEN event = 'on_chain_start' THEN '{K.HALLUCINATION_NOTICE}'
    WHEN type IN ('token', 'error') THEN content END AS content,
  CASE WHEN type = 'plan' THEN data WHEN type IN ('tool-start', 'tool-end') THEN name END AS data,
  CASE WHEN type = 'tool-start' THEN data END AS input FROM typed WHERE type IS NOT NULL)"""


def _in_parts(spark, d):
    """Events whose content comes as a list of objects, a list of texts, plain, or as a broken list."""
    content, n = F.col("content"), F.col("seq") % 4
    part = F.struct(F.lit("text").alias("type"), content.alias("text"))
    listed = (
        F.when(n == 0, F.to_json(F.array(part))).when(n == 1, F.to_json(F.array(content, F.lit(""))))
        .when(n == 3, F.concat(F.lit("["), content)).otherwise(content)
    )
    return V.graph_events(spark, d).withColumn("content", F.when(content.isNotNull(), listed))


_PARTS = "v_parts AS (SELECT * REPLACE (CASE WHEN seq % 4 = 3 THEN '[' || content ELSE content END AS content) FROM v_graph_events)"


@query
def frames_from_events(spark, d):
    return E.frames_from_events(V.graph_events(spark, d))


SQL["frames_from_events"] = V.with_views("v_graph_events", f"WITH {_FRAMES} SELECT * FROM frames")


@query
def frames_from_events_parts(spark, d):
    """Frames of events whose content is a list of parts."""
    return E.frames_from_events(_in_parts(spark, d))


SQL["frames_from_events_parts"] = V.with_views(
    "v_graph_events", f"WITH {_PARTS}, {_FRAMES.replace('v_graph_events', 'v_parts')} SELECT * FROM frames"
)


@query
def parse_frames(spark, d):
    """Events as raw lines: some without the prefix, some with broken JSON."""
    k = V.prop_k()
    e = V.event_times(spark, d)
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("props").alias("content"), F.col("user_id").alias("data")))
    line = (
        F.when(k % 7 == 0, F.concat(F.lit(": ping "), body))
        .when(k % 7 == 1, F.concat(F.lit("data: "), F.substring(body, 1, 20)))
        .otherwise(F.concat(F.lit("data: "), body))
    )
    return E.parse_frames(e.select("event_id", line.alias("line")))


SQL["parse_frames"] = f"""SELECT event_id, event_type AS type, props AS content, CAST(user_id AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS input
FROM events WHERE {V.SQL_K} % 7 > 1"""


@query
def assemble_answer_parts(spark, d):
    """Answers whose tokens are lists of parts."""
    return E.assemble_answer(_in_parts(spark, d))


SQL["assemble_answer_parts"] = V.with_views(
    "v_graph_events",
    f"""WITH {_PARTS}, s AS (SELECT turn_id, max(seq) AS last_start FROM v_parts WHERE {_GEN_START} GROUP BY turn_id)
SELECT turn_id, string_agg(content, '' ORDER BY seq) AS answer FROM v_parts LEFT JOIN s USING (turn_id)
WHERE {_TOKEN} AND (last_start IS NULL OR seq > last_start) GROUP BY turn_id""",
)


@query
def assemble_answer(spark, d):
    return E.assemble_answer(V.graph_events(spark, d))


SQL["assemble_answer"] = V.with_views(
    "v_graph_events",
    f"""WITH s AS (SELECT turn_id, max(seq) AS last_start FROM v_graph_events WHERE {_GEN_START} GROUP BY turn_id)
SELECT turn_id, string_agg(content, '' ORDER BY seq) AS answer FROM v_graph_events LEFT JOIN s USING (turn_id)
WHERE {_TOKEN} AND (last_start IS NULL OR seq > last_start) GROUP BY turn_id""",
)


@query
def turn_latency(spark, d):
    frames = V.graph_events(spark, d).withColumn("type", F.when(E.token(), "token").otherwise("other"))
    return E.turn_latency(frames)


SQL["turn_latency"] = V.with_views(
    "v_graph_events",
    f"""SELECT turn_id, (epoch_us(min(ts) FILTER (WHERE {_TOKEN})) - epoch_us(min(ts))) / 1000000 AS first_token_seconds,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS total_seconds FROM v_graph_events GROUP BY turn_id""",
)


# --- feedback ----------------------------------------------------------------

@query
def append_feedback(spark, d):
    stored = V.feedback(spark, d).withColumn("tools_used", F.lit(None).cast("string"))
    new = V.table(spark, d, "labels").select(
        F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("thread_id"),
        F.col("quality").cast("bigint").alias("score"), F.array(F.lit(K.WEB_TOOL)).alias("tools_used"),
    )
    return FB.append_feedback(stored, new).select("id", "thread_id", "score", "tools_used", "user_prompt")


SQL["append_feedback"] = V.with_views(
    "v_feedback",
    """SELECT id, thread_id, score, CAST(NULL AS VARCHAR) AS tools_used, user_prompt FROM v_feedback
UNION ALL SELECT 'new-' || doc_id, CAST(doc_id AS VARCHAR), quality, '["web_search"]', NULL FROM labels""",
)


@query
def latest_feedback(spark, d):
    return FB.latest_feedback(V.feedback(spark, d)).select("id", "thread_id", "score", "timestamp")


SQL["latest_feedback"] = V.with_views(
    "v_feedback", "SELECT id, thread_id, score, timestamp FROM v_feedback ORDER BY timestamp DESC, id"
)


@query
def export_golden(spark, d):
    existing = V.table(spark, d, "benchmark").select(
        F.col("text").alias("input"), F.lit("N/A").alias("actual_output"), F.col("text").alias("expected_output"),
        F.lit("old").alias("feedback_type"),
    )
    return FB.export_golden(V.feedback(spark, d), existing)


SQL["export_golden"] = V.with_views(
    "v_feedback",
    """SELECT text AS input, 'N/A' AS actual_output, text AS expected_output, 'old' AS feedback_type FROM benchmark
UNION ALL SELECT coalesce(user_prompt, 'N/A'), coalesce(ai_response, 'N/A'),
  CASE WHEN score = 1 THEN coalesce(ai_response, 'N/A') ELSE '(Corregido) ' || user_correction END,
  CASE WHEN score = 1 THEN 'positive' ELSE 'correction' END
FROM v_feedback WHERE score = 1 OR (score = -1 AND user_correction IS NOT NULL)""",
)
