"""Files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, filename, length, modified, content) of all files below a path. Columns not used are not read.

    Spark's file sources leave out files of zero bytes; such an upload has to come as a row of its own.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        "length",
        F.col("modificationTime").alias("modified"),
        "content",
    )


def scan_batch(
    spark: SparkSession, paths: list[str], user_id: str | None, document_date: str | None, batch_id: str
) -> DataFrame:
    """Files handed in together: they share user, date and batch; arrival follows the path order."""
    return (
        scan_files(spark, paths)
        .withColumn("user_id", F.lit(user_id).cast("string"))
        .withColumn("document_date", F.lit(document_date).cast("string"))
        .withColumn("batch_id", F.lit(batch_id))
        .withColumn("arrival", F.struct("modified", "path"))
    )
