"""Scores from shared words. Stand-ins, with a stated rule, for judgements a language model would make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import words
from lorewell.operators.skew import lookup

DIGITS = 9


def distinct_words(text: Column) -> Column:
    """The distinct words of a text; none for NULL."""
    return F.coalesce(F.array_distinct(words(text)), F.array().cast("array<string>"))


def term_recall(
    wanted: DataFrame, given: DataFrame, keys: Sequence[str], wanted_text: str, given_text: str, out: str
) -> DataFrame:
    """Per key: share of the distinct words of the wanted texts that occur in any given text.

    Keys whose wanted texts have no word are absent. Given texts are matched row by row against their key's wanted words
    (a set no larger than the vocabulary of one key's wanted texts); only the words found are shuffled.
    """
    terms = wanted.select(*keys, F.explode(distinct_words(F.col(wanted_text))).alias("term"))
    asked = terms.groupBy(*keys).agg(F.collect_set("term").alias("asked"))
    met = lookup(given.select(*keys, F.col(given_text).alias("__text")), asked, list(keys), "inner")
    found = met.select(*keys, F.explode(F.array_intersect("asked", distinct_words(F.col("__text")))).alias("term"))
    hits = found.groupBy(*keys, "term").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("one").alias("hits"))
    joined = lookup(asked.select(*keys, F.size("asked").alias("size")), hits, list(keys))
    return joined.select(*keys, F.round(F.coalesce("hits", F.lit(0)) / F.col("size"), DIGITS).alias(out))


def count_cosine(texts: DataFrame, keys: Sequence[str], left: str, right: str, out: str) -> DataFrame:
    """Per key: cosine of the word counts of two text columns, summed over the key's rows; 0 without words."""
    side = lambda c, name: texts.select(
        *keys, F.explode(words(F.col(c))).alias("term"), F.lit(name).alias("side")
    )
    counts = (
        side(left, "l").unionByName(side(right, "r"))
        .groupBy(*keys, "term")
        .agg(F.count_if(F.col("side") == "l").alias("l"), F.count_if(F.col("side") == "r").alias("r"))
    )
    l, r = F.col("l").cast("double"), F.col("r").cast("double")
    cosine: Column = F.try_divide(F.sum(l * r), F.sqrt(F.sum(l * l) * F.sum(r * r)))
    scored = counts.groupBy(*keys).agg(F.round(F.coalesce(cosine, F.lit(0.0)), DIGITS).alias(out))
    return texts.select(*keys).distinct().join(scored, list(keys), "left").fillna(0.0, [out])
