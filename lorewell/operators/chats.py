"""Conversation tables: threads and their messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_title(message: Column, limit: int = 50) -> Column:
    """The first characters of a message, with `...` if there are more."""
    return F.when(F.length(message) > limit, F.concat(F.substring(message, 1, limit), F.lit("..."))).otherwise(message)


def create_chats(turns: DataFrame, chats: DataFrame) -> DataFrame:
    """Chats plus a row for each new thread; its first message gives the title. Known threads are untouched.

    `turns`: thread_id, user_id, message, ts, seq.
    """
    first = turns.groupBy("thread_id").agg(
        F.min_by(F.struct("user_id", "message", "ts"), F.struct("ts", "seq")).alias("f")
    )
    new = first.join(chats.select("thread_id"), "thread_id", "left_anti").select(
        "thread_id",
        F.coalesce("f.user_id", F.lit("anonymous")).alias("user_id"),
        chat_title(F.col("f.message")).alias("title"),
        F.col("f.ts").alias("created_at"),
        F.col("f.ts").alias("updated_at"),
    )
    return chats.select(*new.columns).unionByName(new)


def list_chats(chats: DataFrame, user_id: str | None = None) -> DataFrame:
    """Threads newest first, of one user (filter reaches the scan) or of every user."""
    rows = chats if user_id is None else chats.filter(F.col("user_id") == user_id)
    return rows.select("user_id", "thread_id", "title", "created_at").orderBy(
        "user_id", F.col("created_at").desc(), "thread_id"
    )


def append_messages(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages plus two rows per turn: the user's, and the assistant's if it has text.

    `turns`: thread_id, turn_id, ts, message, answer.
    """
    def rows(role: str, text: str, order: int) -> DataFrame:
        return turns.select(
            F.concat_ws("-", F.col("turn_id").cast("string"), F.lit(role)).alias("id"),
            "thread_id",
            F.lit(role).alias("role"),
            F.col(text).alias("content"),
            F.col("ts").alias("created_at"),
            F.lit(order).cast("bigint").alias("position"),
        )

    answered = rows("assistant", "answer", 1).filter(F.length("content") > 0)
    return messages.unionByName(rows("user", "message", 0)).unionByName(answered)


def thread_messages(messages: DataFrame, thread_id=None) -> DataFrame:
    """Messages oldest first, of one thread or of all."""
    rows = messages if thread_id is None else messages.filter(F.col("thread_id") == thread_id)
    return rows.orderBy("thread_id", "created_at", "position")


@dataclass
class RemainingThreads:
    chats: DataFrame
    messages: DataFrame
    feedback: DataFrame
    checkpoints: DataFrame


def delete_threads(
    ids: DataFrame, chats: DataFrame, messages: DataFrame, feedback: DataFrame, checkpoints: DataFrame
) -> RemainingThreads:
    """The four tables without the given threads (a table with `thread_id`)."""
    doomed = ids.select("thread_id").distinct()
    return RemainingThreads(*[t.join(doomed, "thread_id", "left_anti") for t in (chats, messages, feedback, checkpoints)])
