"""What the operators of this folder share: reading tables, the id remainder, and Arrow passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorewell.llm.words import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str | Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo `modulus`; a NULL id counts as the empty text."""
    key = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.pmod(F.crc32(F.coalesce(key, F.lit("")).cast("binary")), F.lit(modulus))


def arrow_pass(
    df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | T.StructType
) -> DataFrame:
    """`step` over every Arrow batch, in the tasks that hold the rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = step(batch)
            if isinstance(found, pa.RecordBatch):
                yield found
            else:
                yield from found

    return df.mapInArrow(run, schema)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator uses; other columns never reach the operator."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def per_text(df: DataFrame, text: str, step: Callable[[pa.Array], list], schema: str, keep: list[str] | None = None):
    """`df` (or its columns `keep`) as a struct column `row`, plus the columns of `schema` that `step` gives.

    `step` gets a slice of texts as a large string array without NULLs and returns one array per column.
    Keeping the input in a struct lets its columns have any names.
    """
    names = df.columns if keep is None else keep
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.struct(F.lit(0).alias("none")).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    out = T.StructType([packed.schema["row"], *T.StructType.fromDDL(schema).fields])
    types = [to_arrow_type(f.dataType) for f in out.fields[1:]]
    labels = [f.name for f in out.fields]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                made = [pa.array(a, t) if not isinstance(a, pa.Array) else a for a, t in zip(step(texts), types)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=labels)

    return packed.mapInArrow(run, out)
