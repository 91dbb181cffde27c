"""Registered queries: each runs library operators over the shared tables, with SQL that must agree."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.session import configure

AREAS = ["ingest", "texts", "index", "search", "conversations", "evaluation", "telemetry", "streams"]


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and fractions as DOUBLE, so that results compare by value."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.FloatType):
            c = c.cast("double")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _wrap(fn):
    def run(spark, sf_dir):
        return _plain(fn(configure(spark), sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict:
    found = {}
    for area in AREAS:
        for name, fn in import_module(f"lorewell.catalog.{area}").QUERIES.items():
            assert name not in found, name
            found[name] = _wrap(fn)
    return found


def all_sql() -> dict[str, str]:
    found = {}
    for area in AREAS:
        module = import_module(f"lorewell.catalog.{area}")
        unknown = set(module.SQL) - set(module.QUERIES)
        assert not unknown, unknown
        found.update(module.SQL)
    return found
