"""Stored tables, exported reports and golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell import schemas as S


def scan_tables(
    spark: SparkSession, location: str, jdbc: dict[str, dict[str, str]] | None = None
) -> dict[str, DataFrame]:
    """The five stored tables by name, from parquet below `location`, or over JDBC when options are given.

    JDBC options are given per table, since the tables have different columns to split the read by: each must name
    `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions`. The key "" holds options common to all.
    """
    if jdbc:
        out = {}
        for name in S.TABLES:
            options = {**jdbc.get("", {}), **jdbc.get(name, {})}
            missing = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - set(options)
            if missing:
                raise ValueError(f"{name}: without {', '.join(sorted(missing))} one task would read the whole table")
            out[name] = spark.read.format("jdbc").options(url=location, dbtable=name, **options).load()
        return out
    return {name: spark.read.schema(schema).parquet(f"{location}/{name}") for name, schema in S.TABLES.items()}


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """An exported run report (CSV with header)."""
    rows = spark.read.schema(S.RUNS).csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*S.RUN_COLUMNS.values()).fillna({"tags": ""})


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_golden(spark: SparkSession, path: str, pairs: bool = False) -> DataFrame:
    """Golden cases, or golden question/answer pairs; a JSON array or one object per line."""
    reader = spark.read.schema(S.GOLDEN_PAIR if pairs else S.GOLDEN)
    return reader.json(path) if pairs else reader.json(path, multiLine=True)
