"""Building blocks that keep hot keys from landing in one task.

A key here (user, thread, source, content hash, ...) may hold a third of all rows, so

* per-key values come from `groupBy` aggregates, which combine before the shuffle;
* rows meet those values again through `lookup`, whose shuffled sides AQE can split;
* per-key order (running totals, next row, ordered concatenation) is computed in two levels: inside
  fixed ranges of the order column, then over one small row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 8192


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of `left` to a `right` holding at most one row per key.

    `right` usually comes out of a `groupBy` on the same key. Its partitioning would then be reused for the
    join, and AQE splits hot partitions only where both inputs are shuffled by the join itself. The extra
    derived key makes Spark shuffle `right` (one small row per key) once more, so a hot key of `left` is
    split into several tasks. Small `right` sides become broadcasts by their measured size.
    """
    key = F.xxhash64(*[F.col(c) for c in on])
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") for c in on],
        *[F.col(c) for c in right.columns if c not in on],
        key.alias("__rk"),
    )
    condition = F.col("__lk") == F.col("__rk")
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    joined = left.withColumn("__lk", key).join(renamed, condition, how)
    return joined.drop("__lk", "__rk", *[f"__r_{c}" for c in on])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key: the values of the greatest `order` tuple."""
    picked = F.max_by(F.struct(*columns), F.struct(*order)).alias("__p")
    return df.groupBy(*keys).agg(picked).select(*keys, "__p.*")


def _block(seq: Column, block: int) -> Column:
    return F.floor(seq / F.lit(block))


def running_total(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Per key, the sum of the whole number `value` over rows with `seq` up to and including this one.

    `seq` is a whole number, unique within the (never NULL) key. A task never sorts more than `block` rows
    of one key; the only per-key window runs over one total per block. Rows are shuffled once, by
    (key, block), and the join back reuses that partitioning.
    """
    by_block = [*keys, "__b"]
    blocked = df.withColumn("__b", _block(F.col(seq), block)).withColumn("__v", value.cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocked.groupBy(*by_block)
        .agg(F.sum("__v").alias("__t"))
        .select(*by_block, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    )
    inside = Window.partitionBy(*by_block).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = blocked.withColumn("__s", F.sum("__v").over(inside))
    joined = partial.join(bases, by_block, "inner")
    return joined.withColumn(out, F.col("__s") + F.col("__base")).drop("__b", "__v", "__s", "__base")


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, out: str
) -> DataFrame:
    """Per key, `value` of the following row in `order`; NULL on the last row.

    `block` is a column that never decreases along the order (an hour of a timestamp, a range of a number);
    one task sorts one block of one key, and a window over one row per block links the blocks.
    """
    by_block = [*keys, "__b"]
    blocked = df.withColumn("__b", block)
    inside = Window.partitionBy(*by_block).orderBy(*order)
    local = blocked.withColumn("__n", F.lead(F.struct(F.col(value).alias("v"))).over(inside))
    following = Window.partitionBy(*keys).orderBy("__b")
    firsts = (
        blocked.groupBy(*by_block)
        .agg(F.min_by(F.col(value), F.struct(*order)).alias("__f"))
        .select(*by_block, F.lead("__f").over(following).alias("__f"))
    )
    joined = local.join(firsts, by_block, "inner")
    value_after = F.when(F.col("__n").isNotNull(), F.col("__n.v")).otherwise(F.col("__f"))
    return joined.withColumn(out, value_after).drop("__b", "__n", "__f")


def ordered_concat(
    df: DataFrame, keys: Sequence[str], seq: str, text: Column, sep: str, out: str, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Per key, the texts joined in `seq` order; NULL texts are skipped.

    Pieces are joined inside ranges of `seq` first, so the last step sees one text per range.
    """
    pieces = df.select(*keys, F.col(seq).alias("__q"), text.alias("__x")).filter(F.col("__x").isNotNull())

    def join_sorted(col: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("__q", "__x")))
        return F.array_join(F.transform(ordered, lambda s: s["__x"]), sep).alias(col)

    ranges = pieces.groupBy(*keys, _block(F.col("__q"), block).alias("__b")).agg(join_sorted("__x"))
    return ranges.withColumnRenamed("__b", "__q").groupBy(*keys).agg(join_sorted(out))


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str
) -> DataFrame:
    """The first `limit` rows per key, numbered from 1 in column `rank`.

    `row_number() <= number` is planned as a limit per input partition before the shuffle, so a hot key
    ships at most `limit` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= limit)
