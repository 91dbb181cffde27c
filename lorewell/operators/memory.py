"""Message-state rules: reducers, turn slicing, truncation and compaction.

Messages: thread_id, seq (unique whole number within the thread), id, role (human / ai / tool / system),
name, tool_calls, content. A thread may be arbitrarily long: per-thread facts are aggregates, rows meet them
through `lookup`, and ordered texts are joined in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions.text import leading
from lorewell.operators.skew import lookup, ordered_concat, running_total, top_per_key


def is_real_user(role: Column, content: Column) -> Column:
    """A row the user wrote, not one the system slipped in."""
    return (role == "human") & ~F.startswith(F.coalesce(content, F.lit("")), F.lit(K.SYNTHETIC_PREFIX))


def real_user() -> Column:
    return is_real_user(F.col("role"), F.col("content"))


def plain_answer() -> Column:
    """An assistant row without tool calls."""
    return (F.col("role") == "ai") & (F.size(F.coalesce("tool_calls", F.array().cast("array<string>"))) == 0)


def reduce_messages(versions: DataFrame) -> DataFrame:
    """Message state from versions (thread_id, id, version, removed, ...).

    The latest version of an id replaces the earlier ones in their place, `removed` deletes it; `seq` is the
    version of its first appearance since the last removal.
    """
    columns = [c for c in versions.columns if c not in ("thread_id", "id")]
    gone = versions.filter("removed").groupBy("thread_id", "id").agg(F.max("version").alias("gone_at"))
    alive = lookup(versions, gone, ["thread_id", "id"]).filter(
        F.col("gone_at").isNull() | (F.col("version") > F.col("gone_at"))
    )
    reduced = alive.groupBy("thread_id", "id").agg(
        F.max_by(F.struct(*columns), "version").alias("m"), F.min("version").alias("seq")
    )
    kept = [f"m.{c}" for c in columns if c not in ("version", "removed", "seq")]
    return reduced.select("thread_id", "id", "seq", *kept)


def reduce_run_summaries(updates: DataFrame) -> DataFrame:
    """Rows (thread_id, seq, summary) that remain when a NULL summary resets the thread's list."""
    resets = updates.filter(F.col("summary").isNull()).groupBy("thread_id").agg(F.max("seq").alias("reset_at"))
    return (
        lookup(updates, resets, ["thread_id"])
        .filter(F.col("summary").isNotNull() & (F.col("reset_at").isNull() | (F.col("seq") > F.col("reset_at"))))
        .select("thread_id", "seq", "summary")
    )


def _with_last(messages: DataFrame, condition: Column, out: str) -> DataFrame:
    last = messages.groupBy("thread_id").agg(F.max(F.when(condition, F.col("seq"))).alias(out))
    return lookup(messages, last, ["thread_id"])


def current_turn(messages: DataFrame) -> DataFrame:
    """Rows after the thread's last real user row; all rows if there is none."""
    return (
        _with_last(messages, real_user(), "last_user")
        .filter(F.col("last_user").isNull() | (F.col("seq") > F.col("last_user")))
        .drop("last_user")
    )


def last_tool_batch(messages: DataFrame) -> DataFrame:
    """Tool rows after the thread's last assistant row."""
    return (
        _with_last(messages, F.col("role") == "ai", "last_ai")
        .filter((F.col("role") == "tool") & (F.col("last_ai").isNull() | (F.col("seq") > F.col("last_ai"))))
        .drop("last_ai")
    )


def truncate_tool_rows(messages: DataFrame, limit: int = K.TOOL_TEXT_LIMIT) -> DataFrame:
    """Tool rows longer than `limit` keep their ids and lose their text."""
    too_long = (F.col("role") == "tool") & (F.length("content") > limit)
    return messages.withColumn("content", F.when(too_long, F.lit(K.TOOL_TEXT_PLACEHOLDER)).otherwise(F.col("content")))


def turn_bounds(messages: DataFrame) -> DataFrame:
    """(thread_id, last_user, last_row, user_text, answer) of threads with a real user row."""
    return (
        messages.groupBy("thread_id")
        .agg(
            F.max(F.when(real_user(), F.col("seq"))).alias("last_user"),
            F.max("seq").alias("last_row"),
            F.max_by("content", F.when(real_user(), F.col("seq"))).alias("user_text"),
            F.max_by("content", "seq").alias("answer"),
        )
        .filter(F.col("last_user").isNotNull())
    )


def turn_steps(messages: DataFrame, chars: int | None = None) -> DataFrame:
    """The rows between the last real user row and the final answer: the rows a summary replaces.

    `log_line` is the role label with the text (its first `chars` characters, if given), NULL for rows that are not
    logged.
    """
    bounds = turn_bounds(messages).select("thread_id", "last_user", "last_row")
    between = lookup(messages, bounds, ["thread_id"], "inner").filter(
        (F.col("seq") > F.col("last_user")) & (F.col("seq") < F.col("last_row"))
    )
    label = F.when(F.col("role") == "ai", "Asistente (Plan)").when(
        F.col("role") == "tool", F.concat(F.lit("Herramienta ("), F.coalesce("name", F.lit("unknown")), F.lit(")"))
    )
    line = F.concat(label, F.lit(": "), leading(F.coalesce("content", F.lit("")), chars))
    return between.select("thread_id", "seq", "id", "name", line.alias("log_line"))


def summarize_turn(messages: DataFrame, chars: int | None = None) -> DataFrame:
    """(thread_id, summary): the question, tools used in order of first use, the answer; `chars` shortens both texts."""
    steps = turn_steps(messages).filter(F.col("name").isNotNull())
    first_use = steps.groupBy("thread_id", "name").agg(F.min("seq").alias("first_seq"))
    tools = ordered_concat(first_use, ["thread_id"], "first_seq", F.col("name"), ", ", "tools")
    joined = turn_bounds(messages).join(tools, "thread_id", "left")
    summary = F.concat(
        leading(F.col("user_text"), chars), F.lit(" → "), F.coalesce("tools", F.lit("")), F.lit(" → "),
        leading(F.col("answer"), chars),
    )
    return joined.select("thread_id", summary.alias("summary"))


def prune_turn(messages: DataFrame) -> DataFrame:
    """Messages without the steps that `summarize_turn` stands for."""
    steps = turn_steps(messages).select("thread_id", "seq")
    return messages.join(steps, ["thread_id", "seq"], "left_anti")


def collapse_plan(messages: DataFrame, min_user_rows: int = K.COLLAPSE_AT_USER_ROWS) -> DataFrame:
    """Threads due for collapsing, with the two rows each of them keeps.

    Due: enough real user rows, a real user row and a tool-free assistant row. Walking back from the end, a
    row is taken as the answer first, so the two kept rows are the last of their kind.
    """
    facts = messages.groupBy("thread_id").agg(
        F.count_if(real_user()).alias("user_rows"),
        F.max(F.when(real_user(), F.col("seq"))).alias("keep_user"),
        F.max(F.when(plain_answer(), F.col("seq"))).alias("keep_answer"),
    )
    return facts.filter(
        (F.col("user_rows") >= min_user_rows) & F.col("keep_user").isNotNull() & F.col("keep_answer").isNotNull()
    ).select("thread_id", "keep_user", "keep_answer")


def collapse_conversation(
    messages: DataFrame,
    run_summaries: DataFrame | None = None,
    previous: DataFrame | None = None,
    limit: int | None = None,
    min_user_rows: int = K.COLLAPSE_AT_USER_ROWS,
) -> DataFrame:
    """(thread_id, summary): one text in place of the folded rows of each due thread.

    Previous summary, folded rows as `role: content` lines and run summaries as `Turno: ` lines, in that
    order. With `limit`, up to that many characters: lines beyond it are left out before anything is gathered, so
    the text of one thread is never larger than `limit` wherever it is put together.
    """
    plan = collapse_plan(messages, min_user_rows)
    due = plan.select("thread_id")
    folded = lookup(messages, plan, ["thread_id"], "inner").filter(
        (F.col("seq") != F.col("keep_user")) & (F.col("seq") != F.col("keep_answer"))
    )
    lines = folded.select(
        "thread_id", F.lit(1).alias("part"), "seq",
        F.concat("role", F.lit(": "), F.coalesce("content", F.lit(""))).alias("line"),
    )
    if previous is not None:
        lines = lines.unionByName(
            previous.join(due, "thread_id", "left_semi").select(
                "thread_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.col("summary").alias("line")
            )
        )
    if run_summaries is not None:
        lines = lines.unionByName(
            run_summaries.join(due, "thread_id", "left_semi").select(
                "thread_id", F.lit(2).alias("part"), "seq", F.concat(F.lit("Turno: "), "summary").alias("line")
            )
        )
    # one whole number that orders the three parts of a thread
    span = 1 << 40
    ordered = lines.withColumn("pos", F.col("part") * F.lit(span) + F.col("seq"))
    if limit is None:
        return ordered_concat(ordered, ["thread_id"], "pos", F.col("line"), "\n", "summary")
    sized = running_total(ordered, ["thread_id"], "pos", F.length("line") + 1, "until")
    short = sized.filter(F.col("until") - F.length("line") - 1 < limit)
    joined = ordered_concat(short, ["thread_id"], "pos", F.substring("line", 1, limit), "\n", "summary", block=span)
    return joined.withColumn("summary", F.substring("summary", 1, limit))


def collapsed_messages(messages: DataFrame, min_user_rows: int = K.COLLAPSE_AT_USER_ROWS) -> DataFrame:
    """Messages after collapsing: due threads keep their two rows, the others are unchanged."""
    joined = lookup(messages, collapse_plan(messages, min_user_rows), ["thread_id"])
    keep = F.col("keep_user").isNull() | F.col("seq").isin(F.col("keep_user"), F.col("keep_answer"))
    return joined.filter(keep).drop("keep_user", "keep_answer")


def planner_context(messages: DataFrame, chars: int | None = None) -> DataFrame:
    """(thread_id, context): the stored summary, else the last two plain answers (shortened to `chars`), else the fixed text."""
    stored = (F.col("role") == "system") & F.startswith(F.coalesce("content", F.lit("")), F.lit(K.SUMMARY_PREFIX))
    threads = messages.groupBy("thread_id").agg(
        F.min_by("content", F.when(stored, F.col("seq"))).alias("first_summary")
    )
    answers = messages.filter(plain_answer() & (F.length(F.coalesce("content", F.lit(""))) > 0))
    recent = top_per_key(answers, ["thread_id"], [F.col("seq").desc()], 2, "nth")
    previews = F.array_sort(
        F.collect_list(F.struct("seq", F.concat(F.lit("  - "), leading(F.col("content"), chars)).alias("line")))
    )
    listed = recent.groupBy("thread_id").agg(
        F.concat(F.lit(K.PREVIOUS_ANSWERS + "\n"), F.array_join(F.transform(previews, lambda p: p["line"]), "\n")).alias("answers")
    )
    return threads.join(listed, "thread_id", "left").select(
        "thread_id",
        F.coalesce(
            F.concat(F.lit(K.PREVIOUS_SUMMARY), "first_summary"), "answers", F.lit(K.NO_CONVERSATION)
        ).alias("context"),
    )


