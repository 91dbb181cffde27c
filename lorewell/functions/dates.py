"""Date parsing that never raises; bad text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_date(c: Column) -> Column:
    """The first ten characters as a date at UTC midnight; one-digit months and days are accepted."""
    head = F.substring(c, 1, 10)
    return F.when(
        F.rlike(head, F.lit(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z")),
        F.try_to_timestamp(head, F.lit("yyyy-M-d")),
    )


def strict_date(c: Column) -> Column:
    """Exactly YYYY-MM-DD as UTC midnight."""
    return F.when(
        F.rlike(c, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
    )


def first_date_in(c: Column) -> Column:
    """The first ISO date in a text that parses, else the first DD/MM/YYYY that parses."""
    iso = F.transform(
        F.regexp_extract_all(c, F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0)),
        lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")),
    )
    european = F.transform(
        F.regexp_extract_all(c, F.lit(r"[0-9]{2}/[0-9]{2}/[0-9]{4}"), F.lit(0)),
        lambda d: F.try_to_timestamp(d, F.lit("dd/MM/yyyy")),
    )
    first = lambda a: F.try_element_at(F.filter(a, lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(first(iso), first(european))


def time_bound(c: Column, default_date: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`, or `HH:mm:ss` on the given date; anything else is NULL."""
    full = F.when(
        F.rlike(c, F.lit(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z")),
        F.try_to_timestamp(c, F.lit("yyyy-M-d H:m:s")),
    )
    clock = F.when(
        F.rlike(c, F.lit(r"\A[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z")),
        F.try_to_timestamp(
            F.concat(F.date_format(default_date, "yyyy-MM-dd"), F.lit(" "), c), F.lit("yyyy-MM-dd H:m:s")
        ),
    )
    return F.coalesce(full, clock)


def unix_seconds(ts: Column) -> Column:
    """A timestamp as fractional seconds since 1970, the form chunk rows carry."""
    return F.unix_micros(ts) / F.lit(1e6)
