"""Exact interpolated percentiles per key without gathering a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators.skew import lookup

#: Rank error of the sketch that proposes the borders of ranges, as a share of a key's rows.
ERROR = 1e-4
#: Even cuts of a key's rows beside those around the wanted ranks.
EVEN = 64


def _cuts(fractions: Sequence[float]) -> list[float]:
    """Shares of a key's rows at which its values are cut into ranges: evenly, and closely around the wanted fractions."""
    near = [f + step * ERROR for f in fractions for step in (-8, -2, 2, 8)]
    return sorted({min(max(x, 0.0), 1.0) for x in [*near, *(i / EVEN for i in range(1, EVEN))]})


def counts_by_range(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(keys, __v, __n, __b): how often each value of a key occurs, and the range it lies in, ranges ascending with the values.

    The borders come from a quantile sketch per key, so ranges follow the data: wherever the values crowd, an even range holds about
    1/EVEN of a key's rows and the one around a wanted rank at most 6 ERROR, but for copies of one value, which are one row here.
    """
    rows = df.filter(F.col(value).isNotNull())
    borders = rows.groupBy(*keys).agg(F.percentile_approx(value, _cuts(fractions), int(1 / ERROR)).alias("__c"))
    counts = rows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    below = F.size(F.filter("__c", lambda c: c < F.col("__v")))
    return lookup(counts, borders, list(keys)).select(*keys, "__v", "__n", below.alias("__b"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """One row per key with a column per named fraction, NULL values ignored; a NULL key is a key.

    A sketch only proposes value ranges; the result does not depend on its error. Counts per distinct value are added up by range,
    which tells the ranges that hold the wanted ranks (one small row per range), and only those ranges' values are ordered.
    """
    keys = list(keys)
    counts = counts_by_range(df, keys, value, list(fractions.values()))
    ranges = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("__total", F.sum("__n").over(whole)).withColumn(
        "__before", F.coalesce(F.sum("__n").over(before), F.lit(0))
    )

    def wanted(name: str, fraction: float) -> list[Column]:
        position = F.lit(fraction) * (F.col("__total") - 1)
        return [
            F.struct(
                F.lit(name).alias("name"), side.cast("bigint").alias("rank"), weight.alias("weight")
            )
            for side, weight in (
                (F.floor(position), 1 - (position - F.floor(position))),
                (F.floor(position) + 1, position - F.floor(position)),
            )
        ]

    targets = F.array(*[t for name, fraction in fractions.items() for t in wanted(name, fraction)])
    inside = F.filter(
        targets,
        lambda t: (t["weight"] > 0) & (t["rank"] >= F.col("__before")) & (t["rank"] < F.col("__before") + F.col("__n")),
    )
    needed = placed.select(
        *keys, "__b", F.transform(inside, lambda t: t.withField("rank", t["rank"] - F.col("__before"))).alias("__t")
    ).filter(F.size("__t") > 0)
    ordered = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = lookup(counts, needed, [*keys, "__b"], "inner").withColumn("__until", F.sum("__n").over(ordered))
    hits = F.filter(
        "__t", lambda t: (t["rank"] < F.col("__until")) & (t["rank"] >= F.col("__until") - F.col("__n"))
    )
    found = values.select(*keys, "__v", F.explode(hits).alias("__h"))
    return found.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("__h.name") == name, F.col("__v") * F.col("__h.weight"))).alias(name)
            for name in fractions
        ]
    )
