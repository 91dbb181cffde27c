"""Evaluation of retrieval, answers and chunks, and the gates on the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions.text import strip
from lorewell.operators.audit import search_row
from lorewell.operators.skew import lookup
from lorewell.operators.terms import DIGITS, count_cosine, distinct_words, term_recall


def _cut_sources(text: Column) -> Column:
    """Drop the list of sources, at the first listed marker the text contains."""
    cut = text
    for marker in reversed(K.SOURCE_MARKERS):
        cut = F.when(F.contains(text, F.lit(marker)), strip(F.substring_index(text, marker, 1))).otherwise(cut)
    return cut


def final_answer(messages: DataFrame) -> DataFrame:
    """(thread_id, answer): the last assistant text that is not a thought, without its list of sources."""
    text = strip(F.coalesce("content", F.lit("")))
    spoken = (F.col("role") == "ai") & (F.length(text) > 0) & ~F.startswith(text, F.lit(K.THOUGHT_PREFIX))
    last = messages.groupBy("thread_id").agg(F.max_by(text, F.when(spoken, F.col("seq"))).alias("text"))
    cut = _cut_sources(F.col("text"))
    return last.select(
        "thread_id", F.when(F.length(cut) > 0, cut).otherwise(F.lit(K.NO_ANSWER)).alias("answer")
    )


def retrieval_contexts(messages: DataFrame) -> DataFrame:
    """(thread_id, seq, context): usable search outputs, each once at its first place; a default text if none."""
    text = strip(F.coalesce("content", F.lit("")))
    usable = (
        search_row() & (F.length(text) > 0) & ~F.contains(text, F.lit("ERROR")) & ~F.contains(text, F.lit("No encontré"))
    )
    found = messages.filter(usable).groupBy("thread_id", text.alias("context")).agg(F.min("seq").alias("seq"))
    threads = messages.select("thread_id").distinct()
    none = threads.join(found.select("thread_id"), "thread_id", "left_anti").select(
        "thread_id", F.lit(0).cast("bigint").alias("seq"), F.lit(K.NO_CONTEXT).alias("context")
    )
    return found.select("thread_id", "seq", "context").unionByName(none)


def contextual_precision(hits: DataFrame) -> DataFrame:
    """(query_id, contextual_precision) of ranked hits with a boolean `relevant`.

    Mean of the precision at each relevant rank; 0 when nothing is relevant. A question has at most as many
    hits as it asked for.
    """
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.sum(F.col("relevant").cast("double")).over(upto) / F.row_number().over(
        Window.partitionBy("query_id").orderBy("rank")
    )
    scored = hits.withColumn("precision", at)
    return scored.groupBy("query_id").agg(
        F.round(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("precision"))), F.lit(0.0)), DIGITS).alias(
            "contextual_precision"
        )
    )


def contextual_recall(expected: DataFrame, contexts: DataFrame, key: str = "thread_id") -> DataFrame:
    """Share of the expected answer's words present in the retrieved texts, per case."""
    return term_recall(expected, contexts, [key], "expected", "context", "contextual_recall")


def answer_relevancy(cases: DataFrame, key: str = "thread_id") -> DataFrame:
    """Cosine of the word counts of question and answer, per case."""
    return count_cosine(cases, [key], "question", "answer", "answer_relevancy")


def faithfulness(answers: DataFrame, contexts: DataFrame, key: str = "thread_id") -> DataFrame:
    """Share of the answer's words present in the retrieved texts, per case."""
    return term_recall(answers, contexts, [key], "answer", "context", "faithfulness")


def chunk_quality(generated: DataFrame, golden: DataFrame) -> DataFrame:
    """(case_id, chunk_quality): for each ideal chunk the best word recall over the case's chunks, averaged.

    `generated`: case_id, chunk_no, content. `golden`: case_id, ideal_chunks ARRAY<STRING>, a handful.
    """
    ideals = golden.select("case_id", F.transform("ideal_chunks", distinct_words).alias("ideals"))
    wanted = ideals.select("case_id", F.posexplode("ideals").alias("ideal_no", "terms")).filter(F.size("terms") > 0)
    sizes = wanted.select("case_id", "ideal_no", F.size("terms").alias("n_terms"))
    # every chunk is matched in its own row; only one number per ideal chunk is shuffled
    met = lookup(generated.select("case_id", "content"), ideals, ["case_id"], "inner")
    own = met.withColumn("own", distinct_words(F.col("content")))
    matched = own.select(
        "case_id", F.posexplode(F.transform("ideals", lambda i: F.size(F.array_intersect(i, F.col("own"))))).alias("ideal_no", "n")
    )
    shared = matched.groupBy("case_id", "ideal_no").agg(F.max("n").alias("shared"))
    best = sizes.join(shared, ["case_id", "ideal_no"], "left")
    recall = F.coalesce(F.col("shared") / F.col("n_terms"), F.lit(0.0))
    return best.groupBy("case_id").agg(F.round(F.avg(recall), DIGITS).alias("chunk_quality"))


def threshold_gate(scores: DataFrame, thresholds: dict[str, float] = K.THRESHOLDS) -> DataFrame:
    """Rows (case_id, metric, score) with their threshold and whether they pass; unlisted metrics are dropped."""
    limits = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    return (
        scores.withColumn("threshold", F.try_element_at(limits, F.col("metric")))
        .filter(F.col("threshold").isNotNull())
        .withColumn("passed", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    )


def case_verdict(gated: DataFrame) -> DataFrame:
    """(case_id, passed): every metric of the case passes."""
    return gated.groupBy("case_id").agg(F.bool_and("passed").alias("passed"))


def regression_gate(new: DataFrame, old: DataFrame, tolerance: float = K.REGRESSION_TOLERANCE) -> DataFrame:
    """(case_id, metric, old_score, new_score, passed): no metric falls by more than the tolerance."""
    joined = new.select("case_id", "metric", F.col("score").alias("new_score")).join(
        old.select("case_id", "metric", F.col("score").alias("old_score")), ["case_id", "metric"]
    )
    return joined.withColumn("passed", F.col("new_score") >= F.col("old_score") - tolerance)


def k_respected(hits: DataFrame) -> DataFrame:
    """(query_id, k, sources, within, not_fewer) of hits retrieved for several k.

    within: at most k distinct sources; not_fewer: at least as many as for the next smaller k.
    """
    counted = hits.groupBy("query_id", "k").agg(F.countDistinct("source").alias("sources"))
    before = F.lag("sources").over(Window.partitionBy("query_id").orderBy("k"))
    return counted.select(
        "query_id", "k", "sources",
        (F.col("sources") <= F.col("k")).alias("within"),
        (F.col("sources") >= F.coalesce(before, F.lit(0))).alias("not_fewer"),
    )


def metadata_expectations(produced: DataFrame, expected: DataFrame, key: str = "filename") -> DataFrame:
    """Per expected document: does the produced doc_type and document_date equal the expected one?"""
    p = produced.select(key, F.col("doc_type").alias("made_type"), F.col("document_date").alias("made_date"))
    return expected.join(p, key, "left").select(
        key,
        F.col("doc_type").eqNullSafe(F.col("made_type")).alias("type_ok"),
        F.col("document_date").eqNullSafe(F.col("made_date")).alias("date_ok"),
    )


def golden_documents(golden: DataFrame, user_id: str = "eval_golden_user") -> DataFrame:
    """Golden cases (case_no, category, raw_text) as documents with fixed ids, so that a re-run replaces them."""
    number = F.col("case_no").cast("string")
    return golden.select(
        F.concat(F.lit("golden_" + K.PROTECTED_MARK), number).alias("source"),
        F.lit(user_id).alias("user_id"),
        F.concat_ws("", F.col("category"), F.lit("_"), number, F.lit(".txt")).alias("filename"),
        F.col("raw_text").alias("text"),
        F.lit(None).cast("string").alias("document_date"),
    )
