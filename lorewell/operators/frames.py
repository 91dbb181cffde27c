"""Turn-event streams: frames, answers and latencies.

Events: turn_id, seq (unique whole number within the turn), ts, event, name, is_generation, content, data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions.text import is_blank
from lorewell.operators.skew import DEFAULT_BLOCK, lookup, next_value, ordered_concat

FRAME = "type string, content string, data string, input string"
LINE_PREFIX = "data: "


def model_start() -> Column:
    return (F.col("event") == "on_chat_model_start") & F.col("is_generation")


def token() -> Column:
    """A piece of answer text."""
    return (
        (F.col("event") == "on_chat_model_stream")
        & F.col("is_generation")
        & (F.length(F.coalesce("content", F.lit(""))) > 0)
    )


def parse_frames(lines: DataFrame, column: str = "line") -> DataFrame:
    """Frame columns of the `data: ` lines; other lines and broken JSON are skipped."""
    others = [c for c in lines.columns if c != column]
    body = F.substring(column, len(LINE_PREFIX) + 1, 2147483647)
    parsed = lines.filter(F.startswith(column, F.lit(LINE_PREFIX))).select(*others, F.from_json(body, FRAME).alias("f"))
    return parsed.filter(F.col("f.type").isNotNull()).select(*others, "f.*")


def flatten_content(content: Column) -> Column:
    """Model content as text: a JSON list of parts is joined (the `text` of an object, else the part itself), anything else
    stays as it is."""
    parts = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    texts = F.transform(
        parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"))
    )
    return F.when(F.startswith(content, F.lit("[")), F.coalesce(F.array_join(texts, ""), content)).otherwise(content)


def flattened(events: DataFrame) -> DataFrame:
    """Events with list content as text."""
    return events.withColumn("content", flatten_content(F.col("content")))


def assemble_answer(events: DataFrame) -> DataFrame:
    """(turn_id, answer): the tokens after the turn's last model start, joined; earlier tokens are discarded."""
    starts = events.filter(model_start()).groupBy("turn_id").agg(F.max("seq").alias("last_start"))
    kept = lookup(flattened(events).filter(token()), starts, ["turn_id"]).filter(
        F.col("last_start").isNull() | (F.col("seq") > F.col("last_start"))
    )
    return ordered_concat(kept, ["turn_id"], "seq", F.col("content"), "", "answer")


def frames_from_events(events: DataFrame) -> DataFrame:
    """Frames (turn_id, seq, ts, type, content, data, input) the runtime events of each turn give rise to.

    A model start after text was already shown announces a correction.
    """
    events = flattened(events)
    # among model starts and visible tokens, a start that directly follows a token is a restart
    starts = model_start()
    visible = token() & ~is_blank(F.col("content"))
    steps = events.filter(starts | visible).select("turn_id", "seq", F.when(starts, F.col("seq")).alias("start"))
    followed = next_value(steps, ["turn_id"], ["seq"], F.floor(F.col("seq") / DEFAULT_BLOCK), "start", "next_start")
    restarts = followed.filter(F.col("start").isNull() & F.col("next_start").isNotNull()).select(
        "turn_id", F.col("next_start").alias("seq"), F.lit(True).alias("restart")
    )
    marked = events.join(restarts, ["turn_id", "seq"], "left")

    event, name = F.col("event"), F.col("name")
    starting = event == "on_chain_start"
    kind = (
        F.when(model_start() & F.col("restart"), "status")
        .when((event == "on_chain_end") & (name == "task_planner"), "plan")
        .when(token(), "token")
        .when(event == "on_tool_start", "tool-start")
        .when(event == "on_tool_end", "tool-end")
        .when(starting & name.isin("grade_documents", "grade_hallucinations"), "status")
        .when(event == "on_error", "error")
    )
    content = (
        F.when(event == "on_chat_model_start", K.CORRECTION_NOTICE)
        .when(starting & (name == "grade_documents"), K.GRADING_NOTICE)
        .when(starting, K.HALLUCINATION_NOTICE)
        .when(F.col("type").isin("token", "error"), F.col("content"))
    )
    data = F.when(F.col("type") == "plan", F.col("data")).when(F.col("type").isin("tool-start", "tool-end"), name)
    return (
        marked.withColumn("type", kind)
        .filter(F.col("type").isNotNull())
        .select(
            "turn_id", "seq", "ts", "type", content.alias("content"), data.alias("data"),
            F.when(F.col("type") == "tool-start", F.col("data")).alias("input"),
        )
    )


def frame_lines(frames: DataFrame) -> DataFrame:
    """Frames as `data: {json}` lines."""
    body = F.to_json(F.struct("type", "content", "data", "input"))
    return frames.select("turn_id", "seq", "ts", F.concat(F.lit(LINE_PREFIX), body).alias("line"))


def turn_latency(frames: DataFrame) -> DataFrame:
    """Per turn: seconds to the first token (NULL without one) and in total."""
    started = F.min("ts")
    seconds = lambda end: (F.unix_micros(end) - F.unix_micros(started)) / 1e6
    return frames.groupBy("turn_id").agg(
        seconds(F.min(F.when(F.col("type") == "token", F.col("ts")))).alias("first_token_seconds"),
        seconds(F.max("ts")).alias("total_seconds"),
    )
