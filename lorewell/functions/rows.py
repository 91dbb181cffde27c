"""Arrow functions of one row each, whose results leave the worker in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of input after which the results so far are handed on. A longer row is a slice of its own.
SLICE_CHARS = 1 << 21


def _chars(value) -> int:
    if isinstance(value, list):
        return sum(map(_chars, value)) + len(value)
    return len(value) if isinstance(value, str) else 1


def slices(rows: Iterator[tuple], step: Callable, limit: int = SLICE_CHARS) -> Iterator[list]:
    """Lists of `step(*row)` for rows of Arrow scalars, with about `limit` characters of input each."""
    made, held = [], 0
    for row in rows:
        values = [v.as_py() for v in row]
        made.append(step(*values))
        held += sum(map(_chars, values))
        if held >= limit:
            yield made
            made, held = [], 0
    if made:
        yield made


def by_row(step: Callable, returned: str, *columns: Column) -> Column:
    """`step` over the rows of the columns, as a column of type `returned`.

    A batch of Spark may hold texts of 64 MB; as Python objects they and their results take many times that. Here only one slice of a batch
    is ever turned into objects.
    """
    kind = to_arrow_type(T.StructType.fromDDL(f"x {returned}")[0].dataType)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            for made in slices(zip(array), step):
                yield pa.array(made, kind)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for made in slices(zip(*arrays), step):
                yield pa.array(made, kind)

    return F.arrow_udf(one if len(columns) == 1 else several, returned)(*columns)
