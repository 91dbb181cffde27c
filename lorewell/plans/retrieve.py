"""Questions to formatted contexts: validation, search, rerank, fallback, expansion, formatting."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import retrieval as R
from lorewell.session import materialize

FILTERS = ["date_from", "source_filter", "doc_type"]


def search_once(
    questions: DataFrame, chunks: DataFrame, statistics: R.IndexStatistics | None = None
) -> DataFrame:
    """Ranked hits of one block of valid questions: filtered vector search, then BM25 rerank."""
    asked = questions.select("query_id", "k_results", F.col("user_id").alias("query_user"))
    candidates = R.attach_chunks(R.vector_topk(questions, chunks, one_block=True), chunks, bounded=True)
    scored = R.bm25_scores(candidates, questions, chunks, bounded=True, statistics=statistics)
    return R.rank_scored(scored.join(F.broadcast(asked), "query_id"), F.col("k_results"))


def relaxed(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions that named a filter and found nothing, with only the user filter left."""
    named = F.lit(False)
    for c in FILTERS:
        named = named | (F.length(F.coalesce(F.col(c), F.lit(""))) > 0)
    missed = questions.filter(named).join(hits.select("query_id"), "query_id", "left_anti")
    for c in FILTERS:
        missed = missed.withColumn(c, F.lit(None).cast("string"))
    return missed


def ranked_hits(
    questions: DataFrame, chunks: DataFrame, statistics: R.IndexStatistics | None = None
) -> DataFrame:
    """Hits of one block with the filter-relaxing second try."""
    if statistics is None:
        terms = questions.select(F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))
        found = R.index_statistics(chunks, terms)
        statistics = replace(found, frequency=materialize(found.frequency, "frequency"))
    hits = materialize(search_once(questions, chunks, statistics), "hits")
    second = relaxed(questions, hits)
    if second.isEmpty():
        return hits
    return hits.unionByName(materialize(search_once(second, chunks, statistics), "hits"))


def retrieve(
    requests: DataFrame,
    chunks: DataFrame,
    url_base: str | None = None,
    require_user: bool = True,
    statistics: R.IndexStatistics | None = None,
) -> DataFrame:
    """(query_id, context) for every request: its context, the nothing-found text or its error.

    With `require_user` a request without user is refused instead of searching every tenant's chunks.
    `statistics` are computed for the asked words when none are kept with the index.
    """
    checked = R.validate_requests(requests)
    if require_user:
        missing = F.length(F.coalesce("user_id", F.lit(""))) == 0
        refused = F.lit("ERROR_TOOL: the request names no user.")
        checked = checked.withColumn("error", F.coalesce("error", F.when(missing, refused)))
    valid = checked.filter(F.col("error").isNull()).select(*R.QUESTION_COLUMNS)
    answers = checked.filter(F.col("error").isNotNull()).select("query_id", F.col("error").alias("context"))
    for block in R.question_blocks(valid):
        hits = ranked_hits(block, chunks, statistics)
        expanded = R.expand_hits(hits, chunks, block, bounded=True)
        contexts = R.format_context(R.dedup_hits(expanded), url_base)
        answers = answers.unionByName(R.empty_result_marker(block, contexts))
    return answers
