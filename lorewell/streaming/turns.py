"""Live turns: the state holds the open turns; a turn answers when it has been silent for a while, and then is gone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorewell.operators.frames import flattened, model_start, token

FINISHED = "turn_id string, answer string, n_tokens bigint, first_token_seconds double, total_seconds double"
#: Turns are dealt to so many states by a hash of their id. A call costs a few milliseconds whatever it holds, an event microseconds.
BUCKETS = 4096
#: The open turns of a bucket, one array element each; `seqs` and `contents` are their tokens.
STATE = """turns array<string>, first_us array<bigint>, last_us array<bigint>, token_us array<bigint>, last_start array<bigint>,
  seqs array<array<bigint>>, contents array<array<string>>"""


class _Turns:
    """Times and tokens of the open turns of one bucket; a turn is finished `timeout_ms` after its last event."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def __call__(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # turn -> [first, last, token, last start, numbers, contents]
        held = {turn: facts for turn, *facts in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            for part in parts:
                columns = [part[c].tolist() for c in ("turn_id", "us", "seq", "content", "starts")]
                for turn, us, seq, content, starts in zip(*columns):
                    self._add(held, turn, us, seq, content, starts)
        now = state.getCurrentWatermarkMs()
        silent = [turn for turn, facts in held.items() if facts[1] // 1000 + self.timeout_ms < now]
        done = [self._finished(turn, *held.pop(turn)) for turn in silent]
        if held:
            state.update(([*held], *map(list, zip(*held.values()))))
            state.setTimeoutTimestamp(max(min(facts[1] for facts in held.values()) // 1000 + self.timeout_ms, now + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["turn_id", "answer", "n_tokens", "first_token_seconds", "total_seconds"])

    @staticmethod
    def _add(held: dict, turn: str, us: float, seq: float, content: str | None, starts: bool) -> None:
        facts = held.setdefault(turn, [None, None, None, None, [], []])
        known = us == us  # an event without a time moves none
        for place, pick, value, applies in (
            (0, min, us, known), (1, max, us, known), (2, min, us, known and content is not None), (3, max, seq, starts)
        ):
            if applies:
                facts[place] = int(value) if facts[place] is None else pick(facts[place], int(value))
        if content is not None:  # of tokens only
            facts[4].append(int(seq))
            facts[5].append(content)

    @staticmethod
    def _finished(turn, first, last, token_us, start, seqs, contents) -> tuple:
        kept = sorted((s, c) for s, c in zip(seqs, contents) if start is None or s > start)
        answer = "".join(c for _, c in kept) if kept else None
        return turn, answer, len(kept), None if token_us is None else (token_us - first) / 1e6, (last - first) / 1e6


def live_turns(events: DataFrame, delay: str = "1 hour", timeout_seconds: int = 1800, buckets: int = BUCKETS) -> DataFrame:
    """Streaming: every turn once, after `timeout_seconds` of event time without an event. It leaves the state then.

    Events behind the watermark are dropped here; `late.LateGate` before this step keeps and counts them.
    """
    shaped = flattened(events).withWatermark("ts", delay).select(
        "turn_id", "ts", "seq", F.unix_micros("ts").alias("us"), F.when(token(), F.col("content")).alias("content"),
        F.coalesce(model_start(), F.lit(False)).alias("starts"), F.pmod(F.xxhash64("turn_id"), F.lit(buckets)).alias("bucket"),
    )
    return shaped.groupBy("bucket").applyInPandasWithState(
        _Turns(timeout_seconds * 1000).__call__, FINISHED, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def open_turns(spark, checkpoint: str) -> DataFrame:
    """(turn_id) of the turns that are still held in a state."""
    state = spark.read.format("statestore").load(checkpoint).filter("value.groupState IS NOT NULL")
    return state.select(F.explode("value.groupState.turns").alias("turn_id"))
