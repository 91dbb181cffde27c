"""Continuous forms of the job fold, the turn assembly and the success rate.

All are native streaming aggregates in update mode: partial aggregation runs before the shuffle, so a hot
document, turn or window reaches the state as one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators.frames import flattened, model_start, token
from lorewell.operators.skew import DEFAULT_BLOCK, lookup, ordered_concat


def status_state(events: DataFrame) -> DataFrame:
    """Streaming: latest status, error and attempts per document."""
    last = F.max_by(F.struct("status", "error_msg"), F.struct("ts", "seq"))
    return events.groupBy("doc_id").agg(
        last.alias("last"),
        F.count_if(F.col("status") == "failed").alias("attempts"),
        F.max("ts").alias("updated_at"),
    ).select("doc_id", "last.status", "last.error_msg", "attempts", "updated_at")


def turn_blocks(events: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Streaming: per turn and range of `seq`, its tokens, last model start and times.

    A state row never holds more than one range of a turn, however long the turn grows.
    """
    piece = F.when(token(), F.struct("seq", "content"))
    return flattened(events).groupBy("turn_id", F.floor(F.col("seq") / block).alias("block")).agg(
        F.collect_list(piece).alias("tokens"),
        F.max(F.when(model_start(), F.col("seq"))).alias("last_start"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min(F.when(token(), F.col("ts"))).alias("first_token_ts"),
    )


def turn_sessions(blocks: DataFrame) -> DataFrame:
    """(turn_id, answer, first_token_seconds, total_seconds) from the current blocks of every turn."""
    facts = blocks.groupBy("turn_id").agg(
        F.max("last_start").alias("last_start"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("first_token_ts").alias("first_token_ts"),
    )
    tokens = blocks.select("turn_id", F.explode("tokens").alias("t")).select("turn_id", "t.*")
    kept = lookup(tokens, facts.select("turn_id", "last_start"), ["turn_id"]).filter(
        F.col("last_start").isNull() | (F.col("seq") > F.col("last_start"))
    )
    answers = ordered_concat(kept, ["turn_id"], "seq", F.col("content"), "", "answer")
    seconds = lambda end: (F.unix_micros(end) - F.unix_micros("first_ts")) / 1e6
    return facts.join(answers, "turn_id", "left").select(
        "turn_id", "answer", seconds("first_token_ts").alias("first_token_seconds"), seconds("last_ts").alias("total_seconds")
    )
