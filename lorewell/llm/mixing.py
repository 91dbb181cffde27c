"""Mixing sources to target weights: fixed-length blocks, drawn source counts per output shard, permuted block indexes.

1. `shares`: every source has a weight; all sources together share the words of the input. A target stops at `most` times the
   source's own words, and the excess is shared anew by weight until no target is above. Each round is one sum over the sources.
2. `pieces`: the words of a source, in the order of the ids, are cut into blocks of `block` words (the last one may be shorter). Running
   sums come from range partitions (`placing`), so a source may hold most of the rows.
3. `slots`: the output consists of shards of about `shard` slots, a slot holds one block. A source's count in a shard is the whole part
   of its expected number plus draws from the multinomial of the fractional parts. The draws of all shards are taken at equal
   distances over the summed fractions and dealt to the shards by a pseudorandom permutation: each draw by itself has the
   multinomial's probabilities, and over all shards a source gets what it should to within one block.
4. The k-th slot of a source with n blocks shows block perm(k mod n) of round k div n; every (source, round) has a pseudorandom
   permutation of its own (a Feistel network that walks until it is inside 0..n-1), so no index table exists anywhere. Within a round no
   block comes twice. Slots of a round beyond the last allowed one stay empty.
5. `taken` and `mix` join slots and blocks by (source, block index): a hot source is spread over its blocks.

All numbers come from hashes of `seed`, so a rerun gives the same mix.

Edge cases: a NULL text is empty; rows without words belong to no block and are taken 0 times; a NULL source is a source of its own, after all
others; a source without words has target 0 and takes its place in the order of the weights; NULL ids come first, equal ids are ordered
by a hash of their text, repeated rows are rows of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import arrow_pass
from lorewell.llm.placing import placed
from lorewell.operators.skew import lookup
from lorewell.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD = 1 << 16
SEED = 2024
TASK_SLOTS = 1 << 18  # slots made by one task
FRACTION = 1 << 30  # fractions are summed as whole numbers of this part


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = WEIGHTS
    most: int = MOST
    block: int = BLOCK
    shard: int = SHARD
    seed: int = SEED


# ---- permutations


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of i (below n) in the permutation of 0..n-1 that `key` names; all arrays of one length."""
    n, x = n.astype(np.uint64), i.astype(np.uint64).copy()
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2.0))).astype(np.uint64)
    half = (bits + np.uint64(2)) // np.uint64(2)  # never too few, whatever the logarithm's rounding
    mask = (np.uint64(1) << half) - np.uint64(1)
    rounds = [scramble(key.astype(np.uint64) + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) for r in range(1, 5)]
    todo = np.arange(len(x))
    while len(todo):  # a walk leaves the range at most as often as the square is larger than n, 16 times on average at worst
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for round_key in rounds:
            left, right = right, left ^ (scramble(right + round_key[todo]) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


# ---- sources and targets


def measured(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", with_words: bool = False) -> DataFrame:
    """(key, g, tie, size) per row, and its `words` if asked for; `g` sorts as the sources do, NULL last."""
    value = F.col(f"`{text}`").cast("string")
    words = [F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(WORD), F.lit(0)).alias("words")] if with_words else []
    return docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1")).alias("g"),
        F.xxhash64(value.isNull(), value).alias("tie"),
        F.coalesce(F.regexp_count(value, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), *words,
    )


def shares(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(g, no, source_size, target): the sources numbered in order, and the words that each should give."""
    sizes = materialize(rows.groupBy("g").agg(F.sum("size").alias("source_size")), "mix-sizes")
    order = placed(sizes.withColumn("all", F.lit(0)), "all", ["g"], name="mix-sources")
    weights = F.array(*[F.lit(w) for w in settings.weights])
    weight = F.element_at(weights, (F.pmod("position", F.lit(len(settings.weights))) + 1).cast("int")).cast("bigint")
    sources = materialize(order.select("g", F.col("position").alias("no"), "source_size", weight.alias("weight")), "mix-weights")
    rest, total_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, limit = rest or 0, (F.lit(settings.most) * F.col("source_size")).cast("double")

    def share(rest, weight):
        return F.col("weight").cast("double") * F.lit(float(rest or 0)) / F.lit(float(weight or 1))

    while True:  # sources at their limit stay there, since what is left per weight only grows
        above = share(rest, total_weight) > limit
        capped, free = sources.agg(F.sum(F.when(above, settings.most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if (whole - (capped or 0), free or 0) == (rest, total_weight) or not free:
            break
        rest, total_weight = whole - (capped or 0), free
    target = F.when(share(rest, total_weight) > limit, limit).otherwise(share(rest, total_weight))
    return sources.select("g", "no", "source_size", target.alias("target"))


# ---- slots


def slots(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(no, shard, k, block): the block that each slot of the output shows. `sources` as from `shares`, written."""
    n = F.ceil(F.col("source_size") / settings.block)
    expected = F.when(F.col("source_size") > 0, F.col("target") * n / F.col("source_size")).otherwise(F.lit(0.0))
    asked = sources.select("no", n.alias("blocks"), expected.alias("expected")).filter("expected > 0")
    total = round(asked.agg(F.sum("expected")).first()[0] or 0)
    shards = max(1, -(-total // settings.shard))
    each = F.col("expected") / shards
    split = asked.select(
        F.lit(0).alias("all"), "no", "blocks", F.floor(each).alias("fixed"), F.floor((each - F.floor(each)) * FRACTION).alias("part")
    )
    order = placed(materialize(split, "mix-split"), "all", ["no"], F.col("part"), name="mix-parts")
    drawn = total - shards * (split.agg(F.sum("fixed")).first()[0] or 0)
    offset = int(scramble(np.array([settings.seed], np.uint64))[0] >> np.uint64(11)) / 2**53  # within [0, 1)

    def draw(at):
        """The first draw at or after the place `at` of the summed fractions."""
        return F.ceil(at.cast("double") / F.greatest("total", F.lit(1)).cast("double") * drawn - offset).cast("bigint")

    tasks = max(sources.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    ranges = order.select("no", "blocks", "fixed", draw(F.col("before")).alias("first"), draw(F.col("before") + F.col("part")).alias("end"))
    fixed = (
        ranges.filter("fixed > 0").select("no", "blocks", "fixed", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
        .repartition(tasks, "no", "shard")  # a stated number: few rows here, but each makes many slots
        .select("no", "blocks", "shard", F.lit(None).cast("bigint").alias("draw"), F.explode(F.expr("sequence(shard * fixed, shard * fixed + fixed - 1)")).alias("k"))
    )
    drawn_slots = ranges.filter("end > first").withColumn("draw", F.explode(F.expr("sequence(first, end - 1)")))
    extra = drawn_slots.select(
        "no", "blocks", F.lit(0).cast("bigint").alias("shard"), "draw",
        (F.col("draw") - F.col("first") + F.col("fixed") * shards).alias("k"),
    )
    allowed = fixed.unionByName(extra).filter(F.col("k") < settings.most * F.col("blocks"))
    seed = np.uint64(settings.seed)

    def show(batch: pa.RecordBatch) -> pa.RecordBatch:
        no, n, k = (batch.column(c).to_numpy() for c in ("no", "blocks", "k"))
        draws = batch.column("draw").fill_null(-1).to_numpy()
        shard = batch.column("shard").to_numpy().copy()
        dealt = draws >= 0
        if dealt.any():
            size = int(dealt.sum())
            shard[dealt] = permute(draws[dealt], np.full(size, drawn), np.full(size, seed)) % shards
        key = scramble(scramble(no.astype(np.uint64) + seed) + (k // n).astype(np.uint64))
        found = permute(k % n, n, key)
        return pa.RecordBatch.from_arrays([pa.array(no), pa.array(shard), pa.array(k), pa.array(found)], names=["no", "shard", "k", "block"])

    return arrow_pass(allowed.select("no", "blocks", "shard", "draw", "k"), show, "no bigint, shard bigint, k bigint, block bigint")


# ---- documents


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the number, size and target of their source; a hot source's rows are split over tasks."""
    return lookup(rows, sources, ["g"], "inner")


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """Placed rows, one for each block they reach into: its index `block`, and the range `first` to `last` (excluded) of the row's words."""
    start, end = F.col("before"), F.col("before") + F.col("size")
    cut = rows.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"before div {block}"), F.expr(f"(before + size - 1) div {block}")))
    )
    low, high = F.col("block") * block, (F.col("block") + 1) * block
    return cut.withColumn("first", F.greatest(low, start) - start).withColumn("last", F.least(high, end) - start)


def taken(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, size, source_size, target, taken): how many words of each row the mix takes, repeats counted."""
    rows = materialize(measured(docs, key, source, text), "mix-rows")
    sources = materialize(shares(rows, settings), "mix-targets")
    numbered = materialize(with_sources(rows, sources), "mix-numbered")
    columns = ["key", "size", "source_size", "target"]
    order = placed(numbered.filter("size > 0"), "no", ["key", "tie"], F.col("size"), name="mix-order")
    uses = slots(sources, settings).groupBy("no", "block").agg(F.count(F.lit(1)).alias("uses"))
    parts = pieces(order, settings.block).select("no", "block", "before", *columns, (F.col("last") - F.col("first")).alias("words"))
    met = parts.join(uses.hint("merge"), ["no", "block"], "left")  # planned sizes do not see what the slots explode to
    some = met.groupBy("no", "before", *columns).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = numbered.filter("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"))
    return some.select(*columns, "taken").unionByName(none)


def mix(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(shard, source, k, text): the mixed corpus itself, one row per slot, words joined by blanks.

    The texts of blocks are put together once and then meet the slots that show them.
    """
    rows = materialize(measured(docs, key, source, text, with_words=True), "mix-rows")
    sources = materialize(shares(rows.drop("words"), settings), "mix-targets")
    order = placed(with_sources(rows.filter("size > 0"), sources), "no", ["key", "tie"], F.col("size"), name="mix-order")
    cut = pieces(order, settings.block).select(
        "no", "g", "block", "before", F.array_join(F.slice("words", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), " ").alias("part")
    )
    blocks = cut.groupBy("no", "block").agg(F.first("g").alias("g"), F.array_sort(F.collect_list(F.struct("before", "part"))).alias("parts"))
    shown = slots(sources, settings).hint("merge").join(blocks, ["no", "block"])
    name = F.when(F.col("g") != "1", F.expr("substring(g, 2)"))
    return shown.select("shard", name.alias("source"), "k", F.array_join("parts.part", " ").alias("text"))
