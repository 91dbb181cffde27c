"""Audit of logged assistant turns: which step had to follow, what was planned, what was grounded.

Messages as in `memory`; `turns` holds one row per thread with its counters (retrieve_retry_count,
generate_retry_count, docs_parse_retries, hallucinations_parse_retries) and task_plan
ARRAY<STRUCT<tool, reason, done>>. Everything per thread is an aggregate over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions.text import contains_any, is_blank, leading
from lorewell.operators.memory import current_turn, last_tool_batch, real_user
from lorewell.operators.skew import ordered_concat
from lorewell.operators.terms import term_recall

RELEVANT_SHARE, GROUNDED_SHARE = 0.3, 0.6


def search_row() -> Column:
    """Output of one of the search tools."""
    return (F.col("role") == "tool") & F.col("name").isin(K.SEARCH_TOOLS)


def turn_features(messages: DataFrame) -> DataFrame:
    """Per thread: its last row, and whether a search ran in the current turn and in the last tool batch."""
    seq = F.col("seq")
    facts = messages.groupBy("thread_id").agg(
        F.max_by(F.struct("role", "content", "tool_calls"), seq).alias("last"),
        F.max(F.when(real_user(), seq)).alias("last_user"),
        F.max_by("content", F.when(real_user(), seq)).alias("question"),
        F.max(F.when(F.col("role") == "ai", seq)).alias("last_ai"),
        F.max(F.when(search_row(), seq)).alias("last_search"),
    )
    after = lambda c: F.coalesce(
        F.col("last_search").isNotNull() & (F.col(c).isNull() | (F.col("last_search") > F.col(c))), F.lit(False)
    )
    return facts.select(
        "thread_id",
        F.col("last.content").alias("last_content"),
        F.size(F.coalesce("last.tool_calls", F.array().cast("array<string>"))).alias("n_calls"),
        "question",
        after("last_user").alias("search_used"),
        after("last_ai").alias("search_in_batch"),
    )


def next_step(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """(thread_id, step, reason) the router takes after the thread's last row."""
    t = turn_features(messages).join(turns.select("thread_id", "generate_retry_count"), "thread_id", "left")
    text = F.coalesce("last_content", F.lit(""))
    may_retry = F.coalesce("generate_retry_count", F.lit(0)) < K.MAX_RETRIES
    code = contains_any(text, K.CODE_MARKERS)
    blank = is_blank(text)
    calls = F.col("n_calls") > 0
    step = (
        F.when(calls, "tools")
        .when(code & may_retry, "agent")
        .when(blank & F.col("search_used") & may_retry, "agent")
        .when(blank, "cleanup_rag_memory")
        .when(F.col("search_used"), "grade_generation_vs_documents")
        .otherwise("cleanup_rag_memory")
    )
    reason = (
        F.when(calls, "tool_calls")
        .when(code & may_retry, "tool_code")
        .when(blank & F.col("search_used") & may_retry, "no_synthesis")
        .when(blank, "empty")
        .when(F.col("search_used"), "searched")
        .otherwise("plain")
    )
    return t.select("thread_id", step.alias("step"), reason.alias("reason"))


def route_after_tools(messages: DataFrame) -> DataFrame:
    """(thread_id, step): `grade_documents` if the last tool batch searched, else `agent`."""
    return turn_features(messages).select(
        "thread_id", F.when(F.col("search_in_batch"), "grade_documents").otherwise("agent").alias("step")
    )


def triage_search_output(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """(thread_id, outcome, retrieve_retry_count, route) of the last tool batch.

    outcome: skip (no search ran), retry / give_up (a tool error, by retries used), no_results, or grade.
    """
    content = F.coalesce("content", F.lit(""))
    batch = (
        last_tool_batch(messages)
        .filter(search_row())
        .groupBy("thread_id")
        .agg(
            F.bool_or(F.contains(content, F.lit(K.ERROR_PREFIX))).alias("failed"),
            F.bool_or(contains_any(content, K.NO_RESULT_MARKERS)).alias("empty"),
        )
    )
    threads = turns.select("thread_id", F.coalesce("retrieve_retry_count", F.lit(0)).alias("used"))
    t = threads.join(batch, "thread_id", "left")
    count = F.when(F.col("failed"), F.col("used") + 1).otherwise(F.col("used"))
    outcome = (
        F.when(F.col("failed").isNull(), "skip")
        .when(F.col("failed") & (count >= K.MAX_RETRIES), "give_up")
        .when(F.col("failed"), "retry")
        .when(F.col("empty"), "no_results")
        .otherwise("grade")
    )
    route = F.when((count > 0) & (count < K.MAX_RETRIES), "rewrite_query").otherwise("agent")
    return t.select("thread_id", outcome.alias("outcome"), count.alias("retrieve_retry_count"), route.alias("route"))


def _with_limit(count: Column, again: str, last: str) -> Column:
    return F.when(count < K.MAX_RETRIES, again).otherwise(last)


def grade_relevance(
    messages: DataFrame, turns: DataFrame, threshold: float = RELEVANT_SHARE, shares: DataFrame | None = None
) -> DataFrame:
    """(thread_id, share, grade, action): do the found documents speak about the current question?

    share: part of the question's words found in the last batch's search output, unless the caller brings
    `shares` (thread_id, share) from a model.
    """
    questions = turn_features(messages).filter(F.col("question").isNotNull()).select("thread_id", "question")
    found = last_tool_batch(messages).filter(search_row()).select("thread_id", "content")
    asked = questions.join(found.select("thread_id").distinct(), "thread_id", "left_semi")
    share = term_recall(asked, found, ["thread_id"], "question", "content", "share") if shares is None else shares
    t = share.join(turns.select("thread_id", F.coalesce("docs_parse_retries", F.lit(0)).alias("used")), "thread_id", "left")
    yes = F.col("share") >= threshold
    return t.select(
        "thread_id", "share", F.when(yes, "yes").otherwise("no").alias("grade"),
        F.when(yes, "agent").otherwise(_with_limit(F.coalesce("used", F.lit(0)) + 1, "search_again", "agent")).alias("action"),
    )


def grounded_share(messages: DataFrame) -> DataFrame:
    """(thread_id, share): part of the last row's words found in the search output of the current turn.

    Threads without search output in this turn are absent; share is NULL when the answer has no words.
    """
    found = current_turn(messages).filter(search_row() & (F.length("content") > 0)).select("thread_id", "content")
    searched = found.select("thread_id").distinct()
    answers = turn_features(messages).select("thread_id", "last_content").join(searched, "thread_id", "left_semi")
    share = term_recall(answers, found, ["thread_id"], "last_content", "content", "share")
    return searched.join(share, "thread_id", "left")


def grade_groundedness(
    messages: DataFrame, turns: DataFrame, threshold: float = GROUNDED_SHARE, shares: DataFrame | None = None
) -> DataFrame:
    """(thread_id, share, action): accept, retry, refuse, or regrade when no grade could be given.

    `shares` (thread_id, share) replaces `grounded_share`; a NULL share is a grade that could not be read.
    """
    counters = turns.select(
        "thread_id",
        F.coalesce("generate_retry_count", F.lit(0)).alias("generated"),
        F.coalesce("hallucinations_parse_retries", F.lit(0)).alias("parsed"),
    )
    t = (grounded_share(messages) if shares is None else shares).join(counters, "thread_id", "left")
    action = (
        F.when(F.col("share").isNull(), F.when(F.col("parsed") + 1 > K.MAX_RETRIES, "accept").otherwise("regrade"))
        .when(F.col("share") >= threshold, "accept")
        .otherwise(_with_limit(F.col("generated") + 1, "retry", "refuse"))
    )
    return t.select("thread_id", "share", action.alias("action"))


def used_tools(messages: DataFrame, chars: int | None = None) -> DataFrame:
    """(thread_id, tool, snippet): tools that answered in the current turn, with their first output (or its start)."""
    rows = current_turn(messages).filter((F.col("role") == "tool") & F.col("name").isNotNull())
    return rows.groupBy("thread_id", F.col("name").alias("tool")).agg(
        F.replace(leading(F.min_by(F.coalesce("content", F.lit("")), "seq"), chars), F.lit("\n"), F.lit(" ")).alias("snippet")
    )


def plan_steps(messages: DataFrame, turns: DataFrame, chars: int | None = None) -> DataFrame:
    """(thread_id, step, tool, reason, done, snippet): a step is done iff its tool answered in this turn."""
    steps = turns.select("thread_id", F.posexplode("task_plan").alias("step", "s")).select(
        "thread_id", "step", "s.tool", "s.reason", "s.done"
    )
    return steps.join(used_tools(messages, chars), ["thread_id", "tool"], "left").select(
        "thread_id", "step", "tool", "reason",
        (F.coalesce("done", F.lit(False)) | F.col("snippet").isNotNull()).alias("done"), "snippet",
    )


def plan_completion(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """(thread_id, verdict, pending): ok without plan or with every step done, else retry or give_up."""
    pending = ordered_concat(
        plan_steps(messages, turns).filter(~F.col("done")), ["thread_id"], "step", F.col("tool"), ", ", "pending"
    )
    t = turns.select("thread_id", F.coalesce("generate_retry_count", F.lit(0)).alias("used")).join(
        pending, "thread_id", "left"
    )
    verdict = F.when(F.col("pending").isNull(), "ok").when(F.col("used") >= K.MAX_RETRIES, "give_up").otherwise("retry")
    return t.select("thread_id", verdict.alias("verdict"), F.coalesce("pending", F.lit("")).alias("pending"))


def declined_without_search(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """(thread_id, declined, nudge): the answer gave up though the planned searches never ran."""
    planned = (
        plan_steps(messages, turns)
        .filter(F.col("tool").isin(K.SEARCH_TOOLS))
        .groupBy("thread_id")
        .agg(F.bool_or(F.col("snippet").isNotNull()).alias("any_used"))
    )
    t = (
        turn_features(messages)
        .select("thread_id", "last_content")
        .join(planned, "thread_id", "left")
        .join(turns.select("thread_id", "generate_retry_count"), "thread_id", "left")
    )
    gave_up = contains_any(F.coalesce("last_content", F.lit("")), K.DECLINED_MARKERS)
    declined = gave_up & ~F.coalesce("any_used", F.lit(True))
    may_retry = F.coalesce("generate_retry_count", F.lit(0)) < K.MAX_RETRIES
    return t.select("thread_id", declined.alias("declined"), (declined & may_retry).alias("nudge"))


def called_tools(messages: DataFrame) -> DataFrame:
    """(thread_id, seq, position, tool): every tool call of the assistant rows, in order."""
    calls = messages.filter(F.col("role") == "ai").select("thread_id", "seq", F.posexplode("tool_calls").alias("position", "tool"))
    return calls


def planned_tools(turns: DataFrame) -> DataFrame:
    """(thread_id, step, tool) of the plans."""
    return turns.select("thread_id", F.posexplode("task_plan").alias("step", "s")).select("thread_id", "step", "s.tool")


def tool_selection(messages: DataFrame, expected: DataFrame) -> DataFrame:
    """(thread_id, expected_tool, chosen): whether the expected tool was among the calls."""
    calls = called_tools(messages).select("thread_id", F.col("tool").alias("expected_tool")).distinct()
    return expected.join(
        calls.withColumn("called", F.lit(True)), ["thread_id", "expected_tool"], "left"
    ).select("thread_id", "expected_tool", F.coalesce("called", F.lit(False)).alias("chosen"))


def tool_selection_accuracy(messages: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of cases per expected tool whose run called it."""
    chosen = tool_selection(messages, expected)
    return chosen.groupBy("expected_tool").agg(
        F.count("*").alias("cases"), F.round(F.avg(F.col("chosen").cast("double")), 9).alias("accuracy")
    )


def retry_counters(retries: DataFrame) -> DataFrame:
    """Four capped counters per (thread, turn) from rows (thread_id, turn, kind); each turn starts at zero."""
    capped = lambda kind: F.least(F.count_if(F.col("kind") == kind), F.lit(K.MAX_RETRIES))
    return retries.groupBy("thread_id", "turn").agg(
        capped("retrieve").alias("retrieve_retry_count"),
        capped("generate").alias("generate_retry_count"),
        capped("docs_parse").alias("docs_parse_retries"),
        capped("hallucinations_parse").alias("hallucinations_parse_retries"),
    )
