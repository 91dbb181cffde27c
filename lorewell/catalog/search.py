"""Retrieval queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.catalog import views as V
from lorewell.catalog.texts import AS_OF, BLANKS, COMMON_WORDS, sql_words
from lorewell.operators import chunking as C
from lorewell.operators import indexing as I
from lorewell.operators import retrieval as R
from lorewell.operators import approx as X
from lorewell.plans import retrieve as P
from lorewell.session import materialize, shared_dir

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


VIEWS = "v_chunks v_questions"


def _questions(spark, d):
    return materialize(V.questions(spark, d), "questions")


def _valid(spark, d):
    checked = R.validate_requests(_questions(spark, d))
    return checked.filter(F.col("error").isNull()).drop("error")


# --- SQL building blocks: each is a list of CTEs -----------------------------

_PREDICATE = """(q.user_id IS NULL OR c.user_id = q.user_id)
    AND (q.source_filter IS NULL OR c.source = q.source_filter OR c.filename = q.source_filter)
    AND (q.doc_type IS NULL OR c.doc_type = q.doc_type)
    AND (try_strptime(q.date_from, '%Y-%m-%d') IS NULL OR c.created_at >= try_strptime(q.date_from, '%Y-%m-%d'))"""
_VALID = f"""valid AS (SELECT * EXCLUDE (k_results), coalesce(k_results, 4) AS k_results FROM v_questions
  WHERE length(trim(query, {BLANKS})) > 0)"""


def _candidates(name: str, questions: str, n: str = "CAST(floor(2.5 * q.k_results) AS BIGINT)") -> str:
    return f"""{name}_all AS (SELECT q.query_id, q.k_results, q.user_id AS query_user, c.*, {n} AS n,
    round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.embedding), 9) AS similarity
  FROM {questions} q JOIN v_chunks c ON {_PREDICATE}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_key) AS vector_rank
  FROM {name}_all) WHERE vector_rank <= n)"""


_FLAT = "replace(content, chr(10), ' ')"
_BM25 = f"""corpus AS (SELECT count(*) AS n_chunks, avg(len({sql_words(_FLAT)})) AS mean_words FROM v_chunks),
chunk_terms AS (SELECT chunk_key, unnest(list_distinct({sql_words(_FLAT)})) AS term FROM v_chunks),
dfs AS (SELECT term, count(*) AS df FROM chunk_terms GROUP BY term),
question_terms AS (SELECT query_id, unnest(list_distinct({sql_words('query')})) AS term FROM valid)"""


def _scored(name: str, candidates: str) -> str:
    return f"""{name}_w AS (SELECT query_id, chunk_key, unnest({sql_words(_FLAT)}) AS term, len({sql_words(_FLAT)}) AS n_words FROM {candidates}),
{name}_tf AS (SELECT query_id, chunk_key, term, n_words, count(*) AS tf FROM {name}_w GROUP BY ALL),
{name}_s AS (SELECT t.query_id, t.chunk_key, round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (1 - 0.75 + 0.75 * n_words / mean_words))), 9) AS score
  FROM {name}_tf t JOIN question_terms USING (query_id, term) JOIN dfs USING (term) CROSS JOIN corpus GROUP BY t.query_id, t.chunk_key),
{name} AS (SELECT c.*, coalesce(s.score, 0) AS score FROM {candidates} c LEFT JOIN {name}_s s USING (query_id, chunk_key))"""


def _ranked(name: str, scored: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank) AS rank
  FROM {scored} WHERE score > 0) WHERE rank <= k_results)"""


# hits with the second, relaxed try
_HITS = f"""{_VALID}, {_BM25}, {_candidates('cand', 'valid')}, {_scored('scored', 'cand')}, {_ranked('first_hits', 'scored')},
missed AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS date_from, CAST(NULL AS VARCHAR) AS source_filter, CAST(NULL AS VARCHAR) AS doc_type)
  FROM valid WHERE coalesce(date_from, source_filter, doc_type) IS NOT NULL AND query_id NOT IN (SELECT query_id FROM first_hits)),
{_candidates('cand2', 'missed')}, {_scored('scored2', 'cand2')}, {_ranked('second_hits', 'scored2')},
hits AS (SELECT * FROM first_hits UNION ALL SELECT * FROM second_hits)"""

_CONTEXT = """near AS (SELECT h.query_id, h.rank, string_agg(c.content, chr(10) ORDER BY c.chunk_index, c.chunk_key) AS expanded
  FROM hits h JOIN v_chunks c ON c.user_id = coalesce(h.query_user, h.user_id) AND c.source = h.source
    AND c.chunk_index IN (h.chunk_index - 1, h.chunk_index, h.chunk_index + 1)
  WHERE h.chunk_type <> 'agentic' GROUP BY h.query_id, h.rank),
inside AS (SELECT h.query_id, h.rank, c.chunk_index, c.chunk_key, c.content, row_number() OVER (PARTITION BY h.query_id, h.rank
    ORDER BY round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.embedding), 9) DESC, c.chunk_key) AS nth
  FROM hits h JOIN valid q ON q.query_id = h.query_id JOIN v_chunks c ON c.user_id = coalesce(h.query_user, h.user_id) AND c.source = h.source
  WHERE h.chunk_type = 'agentic'),
whole AS (SELECT query_id, rank, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, chunk_key) AS expanded
  FROM inside WHERE nth <= 4 GROUP BY query_id, rank),
expanded AS (SELECT h.*, CASE WHEN h.chunk_type = 'agentic' THEN w.expanded ELSE coalesce(n.expanded, h.content) END AS context
  FROM hits h LEFT JOIN near n ON n.query_id = h.query_id AND n.rank = h.rank
  LEFT JOIN whole w ON w.query_id = h.query_id AND w.rank = h.rank),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, chunk_type = 'agentic' ORDER BY rank) AS per_source FROM
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, chunk_index ORDER BY rank) AS per_chunk
      FROM expanded WHERE length(trim(coalesce(context, ''))) > 0) WHERE per_chunk = 1))
  WHERE chunk_type <> 'agentic' OR per_source = 1),
blocks AS (SELECT query_id, rank, 'Fuente: [' || coalesce(filename, source) || '](' || 'files/' ||
    CASE WHEN coalesce(query_user, user_id, '') <> '' THEN coalesce(query_user, user_id) || '/' || source ELSE source END
    || ') (Tipo: ' || coalesce(doc_type, 'general') || ')' || chr(10) || context AS block FROM kept),
contexts AS (SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id)"""


@query
def validate_requests(spark, d):
    q = V.questions(spark, d).withColumn("k_results", F.when(F.col("query_id") == 7, 8).otherwise(F.col("k_results")))
    return R.validate_requests(q).select("query_id", "query", "k_results", "error")


SQL["validate_requests"] = V.with_views(
    "v_questions",
    f"""WITH q AS (SELECT query_id, query, CASE WHEN query_id = 7 THEN 8 ELSE coalesce(k_results, 4) END AS k_results FROM v_questions)
SELECT query_id, query, k_results, CASE WHEN length(trim(query, {BLANKS})) = 0 THEN '{K.EMPTY_QUERY_ERROR}'
  WHEN k_results NOT BETWEEN 2 AND 7 THEN 'ERROR_TOOL: k_results must be between 2 and 7.' END AS error FROM q""",
)


@query
def metadata_predicate(spark, d):
    """Four requests' filters over the chunk table, one with an invalid date."""
    chunks = V.chunks(spark, d)
    requests = [
        ("dated", R.metadata_filter(date_from="2024-01-05", user_id="u1")),
        ("bad date", R.metadata_filter(date_from="05/01/2024", doc_type=K.DOC_TYPES[2])),
        ("source", R.metadata_filter(source_filter="file_7")),
    ]
    found = None
    for name, wanted in requests:
        rows = chunks.filter(wanted).select(F.lit(name).alias("request"), "chunk_key")
        found = rows if found is None else found.unionByName(rows)
    return found


SQL["metadata_predicate"] = V.with_views(
    "v_chunks",
    f"""SELECT 'dated' AS request, chunk_key FROM v_chunks WHERE user_id = 'u1' AND created_at >= TIMESTAMP '2024-01-05'
UNION ALL SELECT 'bad date', chunk_key FROM v_chunks WHERE doc_type = '{K.DOC_TYPES[2]}'
UNION ALL SELECT 'source', chunk_key FROM v_chunks WHERE source = 'file_7' OR filename = 'file_7'""",
)


@query
def overfetch(spark, d):
    q = R.validate_requests(V.questions(spark, d))
    return q.select("query_id", R.overfetch(F.col("k_results")).alias("n"))


SQL["overfetch"] = V.with_views(
    "v_questions", "SELECT query_id, CAST(floor(2.5 * coalesce(k_results, 4)) AS BIGINT) AS n FROM v_questions"
)


@query
def vector_topk(spark, d):
    return R.vector_topk(_valid(spark, d), V.chunks(spark, d)).withColumn("similarity", F.round("similarity", 6))


SQL["vector_topk"] = V.with_views(
    VIEWS,
    f"WITH {_VALID}, {_candidates('cand', 'valid')} SELECT query_id, chunk_key, round(similarity, 6) AS similarity, vector_rank FROM cand",
)


def _cells(spark, chunks):
    """The chunks as an inverted file: (stored index, cells)."""
    cells, path = X.fit_cells(chunks), shared_dir(spark, "cells")
    X.write_index(chunks, cells, path)
    return X.read_index(spark, path, chunks.schema), cells


@query
def approx_topk(spark, d):
    """The nearest chunks of each question, from the cells nearest to it."""
    index, cells = _cells(spark, materialize(V.chunks(spark, d), "chunks"))
    return X.approx_topk(_valid(spark, d), index, cells).withColumn("similarity", F.round("similarity", 6))


def _embedded_documents(spark, d):
    """All documents as chunks, and the first half of each whose id is divisible by 100 as a question."""
    none = F.lit(None).cast("string")
    docs = V.table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_key"), F.col("source"), none.alias("user_id"), none.alias("filename"), none.alias("doc_type"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"), F.col("text").alias("content"),
    )
    embedder = I.fit_embedder(docs)
    chunks = materialize(I.embed(docs, embedder), "documents")
    asked = chunks.filter(F.col("chunk_key") % 100 == 0).select(
        F.col("chunk_key").alias("query_id"), F.expr("substring(content, 1, length(content) div 2)").alias("query"),
        *[none.alias(c) for c in ("user_id", "date_from", "source_filter", "doc_type")], F.lit(K.K_DEFAULT).cast("bigint").alias("k_results"),
    )
    return chunks, materialize(I.embed(asked, embedder, "query"), "questions")


@query
def approx_recall(spark, d):
    """Share of the exact top candidates that the probed cells give, and of the chunks that were scored, per question."""
    chunks, questions = _embedded_documents(spark, d)
    index, cells = _cells(spark, chunks)
    found = X.approx_topk(questions, index, cells, exact_fallback=False)
    recall = X.recall_at_k(found, R.vector_topk(questions, chunks))
    return recall.join(X.scored_pairs(questions, index, cells), "query_id")


@query
def simple_search(spark, d):
    return R.simple_search(_valid(spark, d), V.chunks(spark, d))


SQL["simple_search"] = V.with_views(
    VIEWS,
    f"""WITH {_VALID}, users AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS date_from, CAST(NULL AS VARCHAR) AS source_filter,
  CAST(NULL AS VARCHAR) AS doc_type) FROM valid), {_candidates('cand', 'users', '3')}
SELECT query_id, vector_rank AS rank, content FROM cand""",
)


def _scored_candidates(spark, d):
    questions, chunks = _valid(spark, d), V.chunks(spark, d)
    candidates = R.attach_chunks(R.vector_topk(questions, chunks), chunks)
    scored = R.bm25_scores(candidates, questions, chunks)
    return scored.join(questions.select("query_id", "k_results"), "query_id")


@query
def rerank(spark, d):
    ranked = R.rank_scored(_scored_candidates(spark, d), F.col("k_results"))
    return ranked.select("query_id", "chunk_key", "rank", F.round("score", 6).alias("score"))


SQL["rerank"] = V.with_views(
    VIEWS,
    f"""WITH {_VALID}, {_BM25}, {_candidates('cand', 'valid')}, {_scored('scored', 'cand')}, {_ranked('ranked', 'scored')}
SELECT query_id, chunk_key, rank, round(score, 6) AS score FROM ranked""",
)


@query
def rerank_fallback(spark, d):
    """As `rerank`, but scoring failed for the odd questions."""
    scored = _scored_candidates(spark, d)
    failed = scored.withColumn("score", F.when(F.col("query_id") % 2 == 0, F.col("score")))
    return R.rank_scored(failed, F.col("k_results")).select("query_id", "chunk_key", "rank")


SQL["rerank_fallback"] = V.with_views(
    VIEWS,
    f"""WITH {_VALID}, {_BM25}, {_candidates('cand', 'valid')}, {_scored('scored', 'cand')}, {_ranked('ranked', 'scored')}
SELECT query_id, chunk_key, rank FROM ranked WHERE query_id % 2 = 0
UNION ALL SELECT query_id, chunk_key, vector_rank FROM cand WHERE query_id % 2 = 1 AND vector_rank <= k_results""",
)


@query
def relax_filters(spark, d):
    return P.ranked_hits(_valid(spark, d), V.chunks(spark, d)).select("query_id", "rank", "chunk_key")


SQL["relax_filters"] = V.with_views(VIEWS, f"WITH {_HITS} SELECT query_id, rank, chunk_key FROM hits")


def _hits(spark, d):
    questions, chunks = _valid(spark, d), V.chunks(spark, d)
    return P.ranked_hits(questions, chunks), chunks, questions


@query
def expand_adjacent(spark, d):
    hits, chunks, _ = _hits(spark, d)
    return R.expand_adjacent(hits.filter(F.col("chunk_type") != "agentic"), chunks)


SQL["expand_adjacent"] = V.with_views(VIEWS, f"WITH {_HITS}, {_CONTEXT} SELECT * FROM near")


@query
def expand_document(spark, d):
    hits, chunks, questions = _hits(spark, d)
    return R.expand_document(hits.filter(F.col("chunk_type") == "agentic"), chunks, questions)


SQL["expand_document"] = V.with_views(VIEWS, f"WITH {_HITS}, {_CONTEXT} SELECT * FROM whole")


@query
def dedup_hits(spark, d):
    hits, chunks, questions = _hits(spark, d)
    return R.dedup_hits(R.expand_hits(hits, chunks, questions)).select(
        "query_id", "rank", "source", "chunk_index", "context"
    )


SQL["dedup_hits"] = V.with_views(
    VIEWS, f"WITH {_HITS}, {_CONTEXT} SELECT query_id, rank, source, chunk_index, context FROM kept"
)


@query
def format_context(spark, d):
    hits, chunks, questions = _hits(spark, d)
    return R.format_context(R.dedup_hits(R.expand_hits(hits, chunks, questions)), "files/")


SQL["format_context"] = V.with_views(VIEWS, f"WITH {_HITS}, {_CONTEXT} SELECT * FROM contexts")


@query
def empty_result_marker(spark, d):
    """Every question, here answered only from the hits of the first, unrelaxed search."""
    questions, chunks = _valid(spark, d), V.chunks(spark, d)
    first = P.search_once(questions, chunks).withColumn("context", F.col("content"))
    return R.empty_result_marker(questions, R.format_context(first, "files/"))


SQL["empty_result_marker"] = V.with_views(
    VIEWS,
    f"""WITH {_VALID}, {_BM25}, {_candidates('cand', 'valid')}, {_scored('scored', 'cand')}, {_ranked('first_hits', 'scored')},
b AS (SELECT query_id, string_agg('Fuente: [' || coalesce(filename, source) || '](files/' || coalesce(query_user, user_id) || '/' || source ||
   ') (Tipo: ' || coalesce(doc_type, 'general') || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM first_hits GROUP BY query_id)
SELECT query_id, coalesce(context, '{K.NOTHING_FOUND}') AS context FROM valid LEFT JOIN b USING (query_id)""",
)


@query
def retrieve(spark, d):
    return P.retrieve(_questions(spark, d), V.chunks(spark, d), "files/", require_user=False)


SQL["retrieve"] = V.with_views(
    VIEWS,
    f"""WITH {_HITS}, {_CONTEXT}
SELECT v.query_id, coalesce(context, '{K.NOTHING_FOUND}') AS context FROM valid v LEFT JOIN contexts USING (query_id)
UNION ALL SELECT query_id, '{K.EMPTY_QUERY_ERROR}' FROM v_questions WHERE length(trim(query, {BLANKS})) = 0""",
)


@query
def retrieve_contexts(spark, d):
    """Documents chunked and embedded, all benchmark texts asked as questions, contexts returned."""
    made = C.chunk_documents(V.texts(spark, d), F.lit(AS_OF).cast("timestamp"), lexicon=COMMON_WORDS)
    keyed = made.withColumn("chunk_key", I.chunk_key(F.col("content"), F.col("source"), F.col("chunk_index")))
    stored = materialize(I.count_words(keyed), "chunks")
    embedder = I.fit_embedder(stored)
    chunks = materialize(I.embed(stored, embedder), "index")
    none = F.lit(None).cast("string")
    asked = V.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), none.alias("user_id"), none.alias("date_from"),
        none.alias("source_filter"), none.alias("doc_type"), F.lit(None).cast("bigint").alias("k_results"),
    )
    return P.retrieve(I.embed(asked, embedder, "query"), chunks, "files/", require_user=False)
