"""Approximate vector search by an inverted file of cells, for chunk tables too large to score in full.

The vectors of a bounded sample are split into cells of similar size; every chunk is stored in the partition of the cell whose centre is
most similar to it. A question is compared with the centres, and only the chunks of its most similar cells are read and scored,
exactly. Questions whose filters leave them fewer hits than they asked for are answered by the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from lorewell.operators import retrieval as R
from lorewell.session import materialize

#: Bounds of the sample that the cells are fitted on; every chunk is indexed, whatever the sample.
SAMPLE_VECTORS, SAMPLE_BYTES = 1 << 16, 64 << 20
#: Vectors of a full sample per cell at least, and the share of the cells that a question looks into.
PER_CELL, PROBED = 16, 0.1
#: Rounds of k-means in a split, and over all cells in the end.
ROUNDS, LAST_ROUNDS = 8, 4
CELL = "cell"


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def split_cells(vectors: np.ndarray, cells: int, seed: int = 17) -> np.ndarray:
    """Unit centres of at most `cells` cells: the largest one is split in two by k-means on angles until there are enough.

    So a dense region gets many cells, and no cell is much larger than the others. Equal vectors are never split. A few rounds
    over all cells then move every vector to its nearest centre.
    """
    unit, rng = _unit(vectors.astype(np.float64)), np.random.default_rng(seed)
    open_cells, done = [np.arange(len(unit))], []
    while open_cells and len(open_cells) + len(done) < cells:
        open_cells.sort(key=len)
        members = open_cells.pop()
        own = unit[members]
        far = int((own @ own[rng.integers(len(own))]).argmin())
        centre = np.stack([own[int((own @ own[far]).argmin())], own[far]])
        for _ in range(ROUNDS):
            side = (own @ centre.T).argmax(axis=1)
            if side.min() == side.max():
                break
            centre = _unit(np.stack([own[side == k].sum(axis=0) for k in range(2)]))
        if len(own) < 2 or side.min() == side.max():
            done.append(members)
            continue
        open_cells += [members[side == 0], members[side == 1]]
    if not len(unit):
        return np.zeros((1, vectors.shape[1]))
    centres = _unit(np.stack([unit[c].sum(axis=0) for c in [*done, *open_cells]]))
    for _ in range(LAST_ROUNDS if len(centres) > 1 else 0):
        total = np.zeros_like(centres)
        np.add.at(total, Cells(centres).nearest(unit, 1)[:, 0], unit)
        moved = _unit(total)
        centres = np.where(total.any(axis=1, keepdims=True), moved, centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """The centres of the cells, one row each."""

    centres: np.ndarray

    def nearest(self, vectors: np.ndarray, number: int) -> np.ndarray:
        """The `number` most similar cells of each vector, the best first; ties by number of the cell."""
        out = np.zeros((len(vectors), number), np.int64)
        for start in range(0, len(vectors), 1024):
            near = np.round(_unit(vectors[start : start + 1024]) @ self.centres.T, R.DIGITS)
            if number == 1:  # the first of equal ones, without ordering the others
                out[start : start + 1024, 0] = near.argmax(axis=1)
            else:
                out[start : start + 1024] = np.argsort(-near, axis=1, kind="stable")[:, :number]
        return out

    @property
    def probes(self) -> int:
        """Cells that a question looks into by default."""
        return min(len(self.centres), max(2, math.ceil(PROBED * len(self.centres))))


def fit_cells(chunks: DataFrame, cells: int | None = None, vector: str = "embedding", key: str = "chunk_key") -> Cells:
    """Cells from the vectors of a sample: the first in the order of a hash of the key, within the bounds above.

    By default four times the root of the number of chunks.
    """
    total, dims = chunks.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    dims = max(dims or 1, 1)
    most = min(SAMPLE_VECTORS, SAMPLE_BYTES // (4 * dims))
    wanted = min(4 * math.isqrt(total) if cells is None else cells, most // PER_CELL)
    place = F.xxhash64(key)
    rows = chunks.filter(F.size(vector) == dims).select(place.alias("place"), F.col(vector).cast("array<float>").alias("v"))
    if total > 2 * most:  # about twice the sample comes this far
        rows = rows.filter(F.pmod("place", F.lit(1 << 30)) < int(2 * most / total * (1 << 30)))
    sample = rows.orderBy("place", "v").limit(most)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.stack(b["v"].to_numpy()) for b in batches if len(b)]
        if parts:
            yield pd.DataFrame({"v": list(split_cells(np.concatenate(parts), max(wanted, 1)))})

    found = materialize(sample, "cell-sample").coalesce(1).mapInPandas(fit, "v array<double>").toPandas()  # bounded by the sample
    return Cells(np.stack(found["v"].to_numpy()) if len(found) else np.zeros((1, dims)))


def with_cell(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CELL, IntegerType())])


def add_cells(chunks: DataFrame, cells: Cells, vector: str = "embedding") -> DataFrame:
    """The chunks with the number of their cell; vectors that are absent or of another length are in cell 0."""
    schema = with_cell(chunks.schema)
    dims, shared = cells.centres.shape[1], chunks.sparkSession.sparkContext.broadcast(cells)  # bounded by the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector)
            usable = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            cell = np.zeros(batch.num_rows, np.int64)
            rows = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
            if len(rows):
                values = lists.filter(usable).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                cell[rows] = shared.value.nearest(values.reshape(len(rows), dims), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, to_arrow_type(IntegerType()))], names=[*batch.schema.names, CELL])

    return chunks.mapInArrow(assign, schema)


def write_index(chunks: DataFrame, cells: Cells, path: str, vector: str = "embedding", key: str = "chunk_key") -> None:
    """Every chunk in the partition of its cell. Rows are dealt by ranges of (cell, key), so that a large cell is
    written by several tasks and a task writes few cells."""
    placed = materialize(add_cells(chunks, cells, vector), "cell-rows")
    placed.repartitionByRange(CELL, key).write.partitionBy(CELL).parquet(path)


def read_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A written index; `schema` is that of the chunks."""
    return spark.read.schema(with_cell(schema)).parquet(path)


def approx_topk(
    questions: DataFrame, index: DataFrame, cells: Cells, n: Column | None = None, limit: int | None = None,
    probes: int | None = None, exact_fallback: bool = True,
) -> DataFrame:
    """As `retrieval.vector_topk` over a stored index (`write_index`), but a question meets the chunks of its `probes` nearest
    cells only. Questions that end up with fewer than `n` hits are answered by the exact search, unless `exact_fallback` is off.
    """
    n = R.overfetch(F.col("k_results")) if n is None else n
    number = min(probes or cells.probes, len(cells.centres))
    result = None
    for block in R.question_blocks(questions):
        best = materialize(R._topk_block(block, index, n, limit, lambda v: cells.nearest(v, number)), "approx")
        if exact_fallback:
            asked = block.select("query_id", F.least(n, F.lit(limit)).alias("n") if limit else n.alias("n"))
            full = best.groupBy("query_id").agg(F.count("*").alias("found")).join(asked, "query_id").filter("found >= n")
            short = block.join(full.select("query_id"), "query_id", "left_anti")
            best = best.join(full.select("query_id"), "query_id", "left_semi").unionByName(
                R.vector_topk(short, index, n, limit, one_block=True)
            )
        result = best if result is None else result.unionByName(best)
    return result


def scored_pairs(questions: DataFrame, index: DataFrame, cells: Cells, probes: int | None = None) -> DataFrame:
    """(query_id, scored, chunks): how many chunks each question is compared with, and how many there are."""
    number = min(probes or cells.probes, len(cells.centres))
    sizes = index.groupBy(CELL).agg(F.count(F.lit(1)).alias("size"))
    total = index.agg(F.count(F.lit(1)).alias("chunks"))
    asked = add_cells_of(questions, cells, number)
    met = asked.join(sizes, CELL, "left").groupBy("query_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("scored"))
    return met.join(F.broadcast(total))  # one row


def add_cells_of(questions: DataFrame, cells: Cells, number: int) -> DataFrame:
    """(query_id, cell) for the cells that each question looks into."""
    kind = dict(questions.dtypes)["query_id"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = cells.nearest(np.stack(batch["embedding"].to_numpy()).astype(np.float64), number)
                yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), number), CELL: found.ravel()})

    return questions.select("query_id", "embedding").mapInPandas(probe, f"query_id {kind}, {CELL} int")


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, exact_hits, recall): share of the exact hits among the found ones."""
    marked = exact.select("query_id", "chunk_key").join(
        found.select("query_id", "chunk_key", F.lit(1.0).alias("hit")), ["query_id", "chunk_key"], "left"
    )
    return marked.groupBy("query_id").agg(
        F.count("*").alias("exact_hits"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")
    )
