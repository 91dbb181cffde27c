"""Evaluation queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.catalog import search as S
from lorewell.catalog import views as V
from lorewell.catalog.texts import AS_OF, COMMON_WORDS, _CLEAN, _FOUND, sql_profile, sql_strip, sql_words
from lorewell.functions import text as T
from lorewell.operators import chunking as C
from lorewell.operators import evaluation as E
from lorewell.operators import indexing as I
from lorewell.operators import retrieval as R

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_SEARCH = "(role = 'tool' AND name IN ('knowledge_base_retriever', 'web_search'))"


@query
def final_answer(spark, d):
    return E.final_answer(V.messages(spark, d))


SQL["final_answer"] = V.with_views(
    "v_messages",
    f"""WITH m AS (SELECT thread_id, seq, role, {sql_strip('content')} AS t FROM v_messages),
l AS (SELECT thread_id, arg_max(t, seq) FILTER (WHERE role = 'ai' AND length(t) > 0 AND NOT starts_with(t, '[Pensamiento')) AS t FROM m GROUP BY thread_id),
c AS (SELECT thread_id, CASE WHEN contains(t, '### Fuentes') THEN {sql_strip("string_split(t, '### Fuentes')[1]")}
  WHEN contains(t, '**Fuentes**') THEN {sql_strip("string_split(t, '**Fuentes**')[1]")}
  WHEN contains(t, 'Fuentes:') THEN {sql_strip("string_split(t, 'Fuentes:')[1]")} ELSE t END AS t FROM l)
SELECT thread_id, CASE WHEN length(t) > 0 THEN t ELSE '{K.NO_ANSWER}' END AS answer FROM c""",
)


@query
def retrieval_contexts(spark, d):
    return E.retrieval_contexts(V.messages(spark, d))


_CONTEXTS = f"""found AS (SELECT thread_id, min(seq) AS seq, t AS context FROM (SELECT *, {sql_strip('content')} AS t FROM v_messages)
  WHERE {_SEARCH} AND length(t) > 0 AND NOT contains(t, 'ERROR') AND NOT contains(t, 'No encontré') GROUP BY thread_id, t),
contexts AS (SELECT * FROM found UNION ALL SELECT DISTINCT thread_id, 0, '{K.NO_CONTEXT}' FROM v_messages
  WHERE thread_id NOT IN (SELECT thread_id FROM found))"""
SQL["retrieval_contexts"] = V.with_views("v_messages", f"WITH {_CONTEXTS} SELECT thread_id, seq, context FROM contexts")


def _relevant_hits(spark, d, n=None):
    """Ranked hits, relevant when the chunk carries the question's label."""
    questions, chunks = S._valid(spark, d), V.chunks(spark, d)
    hits = R.attach_chunks(R.vector_topk(questions, chunks, n), chunks)
    return hits.select(
        "query_id", F.col("vector_rank").alias("rank"), (F.col("label") == F.col("query_id")).alias("relevant"), "source"
    )


@query
def contextual_precision(spark, d):
    return E.contextual_precision(_relevant_hits(spark, d))


SQL["contextual_precision"] = V.with_views(
    S.VIEWS,
    f"""WITH {S._VALID}, {S._candidates('cand', 'valid')}, p AS (SELECT query_id, label = query_id AS rel,
  sum(CASE WHEN label = query_id THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY vector_rank) / vector_rank AS precision_at FROM cand)
SELECT query_id, round(coalesce(avg(precision_at) FILTER (WHERE rel), 0), 9) AS contextual_precision FROM p GROUP BY query_id""",
)


def _expected(spark, d, name):
    """The last assistant row of each stored conversation stands for the expected answer."""
    a = V.table(spark, d, "conversations").filter(F.col("role") == "assistant")
    return a.groupBy(F.col("conv_id").alias("thread_id")).agg(F.max_by("text", "turn").alias(name))


_EXPECTED = "expected AS (SELECT conv_id AS thread_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"


def _share(name: str) -> str:
    return f"""q AS (SELECT DISTINCT thread_id, unnest({sql_words('text')}) AS term FROM expected),
h AS (SELECT DISTINCT thread_id, unnest({sql_words('context')}) AS term FROM contexts)
SELECT q.thread_id, round(avg(CASE WHEN h.term IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS {name}
FROM q LEFT JOIN h ON q.thread_id = h.thread_id AND q.term = h.term GROUP BY q.thread_id"""


@query
def contextual_recall(spark, d):
    return E.contextual_recall(_expected(spark, d, "expected"), E.retrieval_contexts(V.messages(spark, d)))


SQL["contextual_recall"] = V.with_views(
    "v_messages", f"WITH {_CONTEXTS}, {_EXPECTED}, {_share('contextual_recall')}"
)


@query
def faithfulness(spark, d):
    return E.faithfulness(_expected(spark, d, "answer"), E.retrieval_contexts(V.messages(spark, d)))


SQL["faithfulness"] = V.with_views("v_messages", f"WITH {_CONTEXTS}, {_EXPECTED}, {_share('faithfulness')}")


@query
def answer_relevancy(spark, d):
    """Every thread's user texts against its assistant texts."""
    conv = V.table(spark, d, "conversations")
    return E.answer_relevancy(
        conv.select(
            F.col("conv_id").alias("thread_id"), F.when(F.col("role") == "user", F.col("text")).alias("question"),
            F.when(F.col("role") == "assistant", F.col("text")).alias("answer"),
        )
    )


SQL["answer_relevancy"] = f"""WITH w AS (SELECT conv_id AS thread_id, role, unnest({sql_words('text')}) AS term FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT thread_id, term, count(*) FILTER (WHERE role = 'user') AS l, count(*) FILTER (WHERE role = 'assistant') AS r FROM w GROUP BY ALL),
s AS (SELECT thread_id, round(coalesce(CAST(sum(l * r) AS DOUBLE) / nullif(sqrt(CAST(sum(l * l) AS DOUBLE) * CAST(sum(r * r) AS DOUBLE)), 0), 0), 9) AS x FROM c GROUP BY thread_id)
SELECT t.thread_id, coalesce(x, 0) AS answer_relevancy FROM (SELECT DISTINCT conv_id AS thread_id FROM conversations) t LEFT JOIN s USING (thread_id)"""


@query
def chunk_quality(spark, d):
    """Document lines as made chunks; the ideal chunks are the document's first and last line joined, and its first."""
    lines = V.lines(spark, d)
    generated = lines.select(F.col("doc_id").alias("case_id"), F.col("pos").alias("chunk_no"), "content")
    parts = F.split("text", "\n", -1)
    golden = V.documents(spark, d).select(
        F.col("doc_id").alias("case_id"),
        F.array(F.concat_ws(" ", parts[0], F.element_at(parts, -1)), parts[0]).alias("ideal_chunks"),
    )
    return E.chunk_quality(generated, golden)


SQL["chunk_quality"] = V.with_views(
    "v_lines",
    f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
i AS (SELECT doc_id, 0 AS ideal_no, concat_ws(' ', parts[1], parts[-1]) AS ideal FROM p UNION ALL SELECT doc_id, 1, parts[1] FROM p),
it AS (SELECT DISTINCT doc_id, ideal_no, unnest({sql_words('ideal')}) AS term FROM i),
n AS (SELECT doc_id, ideal_no, count(*) AS n FROM it GROUP BY ALL),
ct AS (SELECT DISTINCT doc_id, pos, unnest({sql_words('content')}) AS term FROM v_lines),
s AS (SELECT it.doc_id, ideal_no, pos, count(*) AS shared FROM it JOIN ct ON it.doc_id = ct.doc_id AND it.term = ct.term GROUP BY ALL),
b AS (SELECT doc_id, ideal_no, max(shared) AS shared FROM s GROUP BY ALL)
SELECT n.doc_id AS case_id, round(avg(coalesce(shared / n.n, 0)), 9) AS chunk_quality FROM n LEFT JOIN b ON n.doc_id = b.doc_id AND n.ideal_no = b.ideal_no GROUP BY n.doc_id""",
)

METRICS = ["contextual_precision", "contextual_recall", "answer_relevancy", "faithfulness", "other"]


def _scores(spark, d, shift=0):
    """Events as scores of one metric per event type; user and hour make the case."""
    kinds = ["click", "view", "purchase", "error", "signup"]
    metric = F.lit(None)
    for kind, name in zip(kinds, METRICS):
        metric = F.when(F.col("event_type") == kind, name).otherwise(metric)
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    return (
        V.event_times(spark, d)
        .groupBy(F.concat_ws("/", F.col("user_id").cast("string"), hour).alias("case_id"), metric.alias("metric"))
        .agg((F.max((V.prop_k() + shift * F.col("user_id")) % 100) / 100).alias("score"))
    )


def _scores_sql(shift: int = 0) -> str:
    return f"""SELECT user_id || '/' || strftime(ts, '%Y-%m-%d %H') AS case_id, CASE event_type WHEN 'click' THEN 'contextual_precision'
  WHEN 'view' THEN 'contextual_recall' WHEN 'purchase' THEN 'answer_relevancy' WHEN 'error' THEN 'faithfulness' ELSE 'other' END AS metric,
  max(({V.SQL_K} + {shift} * user_id) % 100) / 100 AS score FROM events GROUP BY ALL"""


@query
def threshold_gate(spark, d):
    return E.threshold_gate(_scores(spark, d))


_GATED = f"""scores AS ({_scores_sql()}), limits AS (SELECT unnest(['contextual_precision', 'contextual_recall', 'answer_relevancy', 'faithfulness']) AS metric,
  unnest([0.4::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.85::DOUBLE]) AS threshold),
gated AS (SELECT case_id, s.metric, score, threshold, score >= threshold AS passed FROM scores s JOIN limits l ON s.metric = l.metric)"""
SQL["threshold_gate"] = f"WITH {_GATED} SELECT * FROM gated"


@query
def agent_threshold_gate(spark, d):
    return E.threshold_gate(_scores(spark, d), K.AGENT_THRESHOLDS)


SQL["agent_threshold_gate"] = f"""WITH scores AS ({_scores_sql()}), limits AS (SELECT * FROM (VALUES ('faithfulness', 0.85::DOUBLE), ('answer_relevancy', 0.8::DOUBLE)) t(metric, threshold))
SELECT case_id, s.metric, score, threshold, score >= threshold AS passed FROM scores s JOIN limits l ON s.metric = l.metric"""


@query
def case_verdict(spark, d):
    return E.case_verdict(E.threshold_gate(_scores(spark, d)))


SQL["case_verdict"] = f"WITH {_GATED} SELECT case_id, bool_and(passed) AS passed FROM gated GROUP BY case_id"


@query
def regression_gate(spark, d):
    return E.regression_gate(_scores(spark, d, shift=1), _scores(spark, d))


SQL["regression_gate"] = f"""WITH old AS ({_scores_sql()}), new AS ({_scores_sql(1)})
SELECT case_id, metric, o.score AS old_score, n.score AS new_score, n.score >= o.score - 0.05::DOUBLE AS passed
FROM new n JOIN old o USING (case_id, metric)"""


@query
def mentions_any(spark, d):
    terms = F.array(F.lit("THE"), F.lit("que"), F.lit("Über"))
    return V.table(spark, d, "documents").select("doc_id", T.mentions_any(F.col("text"), terms).alias("mentions"))


SQL["mentions_any"] = """SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'que') OR contains(lower(text), 'über') AS mentions
FROM documents"""


@query
def k_respected(spark, d):
    """Hits for k = 2 to 7 of every question, whatever number it asks for itself."""
    hits = _relevant_hits(spark, d, F.lit(7))
    ks = F.explode(F.sequence(F.lit(2), F.lit(7))).alias("k")
    return E.k_respected(hits.select("query_id", "rank", "source", ks).filter(F.col("rank") <= F.col("k")))


SQL["k_respected"] = V.with_views(
    S.VIEWS,
    f"""WITH {S._VALID}, {S._candidates('cand', 'valid', 'CAST(7 AS BIGINT)')},
n AS (SELECT query_id, k, count(DISTINCT source) AS sources FROM cand JOIN (SELECT unnest([2, 3, 4, 5, 6, 7]) AS k) ON vector_rank <= k GROUP BY query_id, k)
SELECT query_id, CAST(k AS BIGINT) AS k, sources, sources <= k AS within,
  sources >= coalesce(lag(sources) OVER (PARTITION BY query_id ORDER BY k), 0) AS not_fewer FROM n""",
)


@query
def seed_corpus(spark, d):
    """Benchmark texts as golden documents, chunked and indexed twice: the second run adds nothing."""
    golden = V.table(spark, d, "benchmark").select(
        F.col("item_id").alias("case_no"), F.lit("general").alias("category"), F.col("text").alias("raw_text")
    )
    made = C.chunk_documents(E.golden_documents(golden), F.lit(AS_OF).cast("timestamp"), lexicon=COMMON_WORDS)
    keyed = made.withColumn("chunk_key", I.chunk_key(F.col("content"), F.col("source"), F.col("chunk_index")))
    diff = I.index_diff(keyed, keyed)
    return diff.groupBy("source").agg(
        F.count_if(F.col("op") == "added").alias("added"), (F.count_if(F.col("op") == "skipped") > 0).alias("kept")
    )


SQL["seed_corpus"] = f"""SELECT 'golden_eval_doc_fixed_' || item_id AS source, CAST(0 AS BIGINT) AS added, true AS kept FROM benchmark
WHERE length({sql_strip('text')}) > 0"""


@query
def metadata_expectations(spark, d):
    """The profile's type against the type the language lets one expect."""
    docs = V.texts(spark, d).withColumn("text", T.clean_text(F.col("text")))
    produced = C.profile_documents(docs, lexicon=COMMON_WORDS).select(
        "doc_id", "profile.doc_type", "profile.document_date"
    )
    by_lang = {"en": "meeting_notes", "de": "class_notes", "fr": "technical_doc", "es": "research_paper"}
    wanted = F.lit(None)
    for lang, doc_type in by_lang.items():
        wanted = F.when(F.col("lang") == lang, doc_type).otherwise(wanted)
    expected = V.table(spark, d, "documents").select(
        "doc_id", wanted.alias("doc_type"), F.when(F.col("doc_id") % 2 == 0, "2024-01-01").alias("document_date")
    )
    return E.metadata_expectations(produced, expected, "doc_id")



SQL["metadata_expectations"] = V.with_views(
    "v_texts",
    f"""WITH c AS (SELECT doc_id, {_CLEAN} AS text FROM v_texts), p AS (SELECT doc_id, strftime({_FOUND}, '%Y-%m-%d') AS found, {sql_profile('text')} FROM c)
SELECT d.doc_id, CASE lang WHEN 'en' THEN 'meeting_notes' WHEN 'de' THEN 'class_notes' WHEN 'fr' THEN 'technical_doc' WHEN 'es' THEN 'research_paper' END
    IS NOT DISTINCT FROM p.doc_type AS type_ok, CASE WHEN d.doc_id % 2 = 0 THEN '2024-01-01' END IS NOT DISTINCT FROM found AS date_ok
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""",
)
