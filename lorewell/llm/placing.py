"""Places of rows within ordered groups, for groups of any size.

The order is made by range partitions over (group, order), so a hot group is spread over tasks. Only one number per
(group, partition) is put together by a window over the group. Rows that are equal in all of `order` keep the sequence in which the
written input is read, so even a table of one repeated row is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.session import materialize


def placed(rows: DataFrame, group: str, order: list[str], value: Column | None = None, name: str = "placed") -> DataFrame:
    """`rows` with `position` (from 0), `n` (rows of the group) and, if `value` is given, `before` and `total` (its sums).

    `rows` should read a written table: it is scanned once for the ranges and once to be dealt. `group` is never NULL;
    `value` is a whole number. NULLs of the order come first.
    """
    amount = F.lit(0) if value is None else value
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).withColumn("__v", amount.cast("bigint"))
    runs = materialize(
        dealt.repartitionByRange(group, *order, "__tie").withColumn("__run", F.spark_partition_id()), name
    )  # written: the numbers of partitions must not change between uses
    earlier = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    per_run = runs.groupBy(group, "__run").agg(F.count(F.lit(1)).alias("c"), F.sum("__v").alias("s"))
    bases = per_run.select(
        F.col(group).alias("__g"), F.col("__run").alias("__r"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__c"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__s"),
        F.sum("c").over(whole).alias("n"), F.sum("s").over(whole).alias("total"),
    )
    inside = Window.partitionBy(group, "__run").orderBy(*order, "__tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = runs.withColumn("__i", F.row_number().over(inside)).withColumn(
        "__b", F.coalesce(F.sum("__v").over(upto), F.lit(0))
    )
    joined = local.join(bases, (F.col(group) == F.col("__g")) & (F.col("__run") == F.col("__r")))
    sums = [] if value is None else [(F.col("__b") + F.col("__s")).alias("before"), F.col("total")]
    position = (F.col("__i") + F.col("__c") - 1).cast("bigint").alias("position")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], position, F.col("n"), *sums)
