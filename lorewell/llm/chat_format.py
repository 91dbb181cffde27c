"""Chat formatting: collapse cumulative snapshots of logged conversations, then render the maximal ones.

1. Turns get their place within their conversation. The order is made by range partitions over (conversation, turn), so
   a very long conversation is spread over tasks; only one number per (conversation, partition) is put together.
2. A turn's hash is salted with its place, and the rolling hash of a prefix is the xor of its turns' hashes (two 64-bit
   hashes side by side), which again is summed within partitions and put together by partition.
3. A conversation whose whole hash equals the hash of a proper prefix of another one, at its own length, is a snapshot of it:
   an anti-join on (length, hash) removes it. Of equal conversations the smallest id stays.
4. The remaining turns are rendered in parts of at most `PART` turns, so that no conversation becomes one unbounded row.

Edge cases: rows repeated in all four columns are one turn; equal turn numbers are ordered by role and text; NULLs sort first
and differ from empty texts in the hash, and render as empty; NULL ids are one conversation; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.session import materialize

PART = 256
ORDER = ["conv_id", "turn", "role", "text"]


def _hashes(position: str) -> list[Column]:
    content = [F.col(position)]
    for name in ("role", "text"):
        content += [F.col(name).isNull(), F.coalesce(F.col(name), F.lit(""))]
    return [F.xxhash64(*content).alias("h1"), F.xxhash64(F.lit("second"), *content).alias("h2")]


def place_turns(conversations: DataFrame) -> DataFrame:
    """The distinct turns with their `position` from 1 and the rolling hashes `p1`, `p2` of the prefix that they end."""
    turns = conversations.select(*ORDER).distinct()
    runs = materialize(
        turns.repartitionByRange(*ORDER).withColumn("run", F.spark_partition_id()), "chat-runs"
    )  # written: the numbers of partitions must not change between uses

    def before(totals: list[Column], names: list[str], rows: DataFrame) -> DataFrame:
        """Per (conversation, run) what all earlier runs of the conversation add up to: one row per run."""
        earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        per_run = rows.groupBy("conv_id", "run").agg(*[t.alias(n) for t, n in zip(totals, names)])
        joined = [
            F.coalesce((F.sum(n) if n == "n" else F.bit_xor(n)).over(earlier), F.lit(0)).alias(f"b_{n}") for n in names
        ]
        return per_run.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), *joined)

    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = runs.withColumn("local", F.row_number().over(inside))
    placed = local.join(before([F.count(F.lit(1))], ["n"], runs), same).withColumn(
        "position", (F.col("local") + F.col("b_n")).cast("bigint")
    )
    hashed = placed.select(*ORDER, "run", "position", *_hashes("position"))
    rolling = hashed.select("*", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2"))
    bases = before([F.bit_xor("h1"), F.bit_xor("h2")], ["h1", "h2"], hashed)
    return rolling.join(bases, same).select(
        *ORDER, "position", F.col("x1").bitwiseXOR(F.col("b_h1")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("b_h2")).alias("p2"), "h1", "h2",
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one; of equal ones the smallest id."""
    whole = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.bit_xor("h1").alias("w1"), F.bit_xor("h2").alias("w2")
    )
    distinct = whole.groupBy("n_turns", "w1", "w2").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"))
    # the last turn's prefix is the conversation itself
    ends = whole.select(F.col("conv_id").alias("c"), F.col("n_turns").alias("length"))
    proper = turns.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).filter("position < length")
    prefixes = proper.select(F.col("position").alias("k"), "p1", "p2").distinct()
    covered = (F.col("n_turns") == F.col("k")) & (F.col("w1") == F.col("p1")) & (F.col("w2") == F.col("p2"))
    return distinct.join(prefixes, covered, "left_anti").select("conv_id", "n_turns")


def rendered(role: Column, text: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    part: int = PART,
) -> DataFrame:
    """The maximal conversations as rows (conv_id, n_turns, part, text), parts of at most `part` turns from 0."""
    named = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"),
    )
    turns = materialize(place_turns(named), "chat-turns")
    kept = materialize(maximal(turns), "chat-maximal").select(F.col("conv_id").alias("c"), "n_turns")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    piece = F.struct("position", rendered(F.col("role"), F.col("text")).alias("piece"))
    number = F.floor((F.col("position") - 1) / part).alias("part")
    grouped = rows.groupBy("conv_id", "n_turns", number).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return grouped.select("conv_id", "n_turns", "part", F.array_join("pieces.piece", "").alias("text"))
