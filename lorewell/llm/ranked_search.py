"""Ranked lexical search: term-at-a-time over an inverted index, with a limit on accumulators that loses no result.

Index: the texts of a few megabytes make a segment, one row with the segment's terms and, per term, its postings (row, occurrences).
Each of its columns is one binary value, numbers in as few bytes as the largest needs. A segment is a Parquet page per column, and few
segments are read at a time, so a task holds the same share of the index however large the table or a split is.
Segments are made where the documents are read, so postings are never shuffled; the documents are cut into words once for any
number of questions. Corpus figures (documents, words, documents holding a term) are sums over all segments.

Search: questions go to all segments, in blocks of a bounded number of terms. Within a segment an item's terms are taken one at a
time, rarest first. As long as what the remaining terms can give at most reaches the k-th best partial score (or the k-th best score of
the segments that the task has done before), every posting makes or feeds an accumulator. From then on no document without an
accumulator can be among the best k, so none is made any more; accumulators that can still reach the k-th score are fed
exactly to the end. What a term gives at most is its weight times the greatest share in the segment. Items whose terms
together cannot reach the k-th score of the task skip the segment. A task emits its best k rows per item once; those of all tasks are
ranked per item in Spark.

A term's weight is floor(1000 ln((2N + 2) / (2df + 1))), its share of a row with n terms (10^9 tf) div (1000 tf + 8 m) with
m = 10 + (90 n N) div L, all in whole numbers; a score is the sum of weight times share.

Edge cases: a NULL text has no terms; rows without terms count nowhere; rows with equal ids are rows of their own; equal scores
are ranked by id, NULL ids last; rows of items with equal ids make one item of all their terms; an item without
terms, or whose terms are in no document, has no rows; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import words as W
from lorewell.llm.common import arrow_pass
from lorewell.llm.placing import placed
from lorewell.operators.skew import top_per_key
from lorewell.session import materialize

BLOCK_TERMS = 500_000  # terms of the items that are searched for at a time
TASK_POSTINGS = 1 << 23  # postings of the index that one task searches
SEGMENT_BYTES = 2 << 20  # text of one segment; a longer text is a segment of its own
#: Texts and segments are large rows: few of them at a time between Spark and Python.
INDEXING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8MB", "spark.sql.parquet.columnarReaderBatchSize": "512"}
SEARCHING = {"spark.sql.execution.arrow.maxBytesPerBatch": "2MB", "spark.sql.parquet.columnarReaderBatchSize": "1"}
#: Of the written segments: without these, Parquet looks at the size of pages and row groups after every hundredth row only.
WRITING = {
    "parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.row.count.limit": 1, "parquet.enable.dictionary": "false",
}
SEGMENT = (
    "ids binary, unknown binary, sizes binary, terms binary, lengths binary, counts binary, rows binary, occurrences binary, "
    "n_docs bigint, n_words bigint, n_terms bigint, n_postings bigint"
)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while the passes inside run to their end."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpacked(batch: pa.RecordBatch, row: int, column: str, count: str) -> np.ndarray:
    """The numbers of a segment's `column`, of which its column `count` says how many there are."""
    values = batch.column(column)[row].as_buffer()
    return np.frombuffer(values, f"u{len(values) // batch.column(count)[row].as_py()}")


def _terms(batch: pa.RecordBatch, row: int, kind: pa.DataType) -> pa.Array:
    """The terms of a segment."""
    ends = np.cumsum(_unpacked(batch, row, "lengths", "n_terms"), dtype=np.int64)
    offsets = pa.py_buffer(np.concatenate(([0], ends)))
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, offsets, batch.column("terms")[row].as_buffer()]).cast(kind)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of `docs`, written. Per segment: ids and sizes of the rows that have terms; the terms, their numbers of postings and
    the postings, one term after the other, each by row."""
    names = [part.split()[0] for part in SEGMENT.split(", ")]

    def segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batch, "text", SEGMENT_BYTES):
            words = W.split(texts, W.ALPHANUMERIC, lower=True)
            sizes = np.diff(words.first)
            if not len(words.starts):
                continue
            place = np.cumsum(sizes > 0) - 1  # rows without terms are left out
            pairs, occurrences = np.unique(words.codes.astype(np.int64) * len(sizes) + place[words.text], return_counts=True)
            codes = pairs // len(sizes)
            ids = part.column("key").filter(pa.array(sizes > 0))
            terms, ends = W.text_bytes(words.distinct.cast(pa.large_string()))
            columns = [
                ids.fill_null(0).to_numpy().tobytes(), _packed(ids.is_null().to_numpy(zero_copy_only=False)), _packed(sizes[sizes > 0]),
                terms.tobytes(), _packed(np.diff(ends)), _packed(np.bincount(codes, minlength=len(words.distinct))),
                _packed(pairs % len(sizes)), _packed(occurrences),
            ]
            totals = [len(ids), int(sizes.sum()), len(words.distinct), len(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns] + [pa.array([t], pa.int64()) for t in totals], names=names)

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    with settings(docs.sparkSession, INDEXING):
        return materialize(arrow_pass(rows, segments, SEGMENT), "search-index", options=WRITING)


@dataclass(frozen=True)
class Corpus:
    """Figures of the whole corpus."""

    n_docs: int
    n_words: int


@dataclass
class Questions:
    """A block of items: their terms as numbers into `terms`, rarest first, one item after the other."""

    terms: pa.Array
    weights: np.ndarray
    first: np.ndarray
    codes: np.ndarray


class _Segment:
    """The postings of one segment for the terms of a block of questions."""

    def __init__(self, batch: pa.RecordBatch, row: int, asked: Questions, corpus: Corpus):
        unknown = _unpacked(batch, row, "unknown", "n_docs").astype(bool)
        self.ids = pa.array(np.frombuffer(batch.column("ids")[row].as_buffer(), np.int64), mask=unknown)
        sizes = _unpacked(batch, row, "sizes", "n_docs").astype(np.int64)
        counts = _unpacked(batch, row, "counts", "n_terms").astype(np.int64)
        number = pc.index_in(_terms(batch, row, asked.terms.type), value_set=asked.terms)
        known = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        self.local = np.full(len(asked.terms), -1)
        self.local[number.take(pa.array(known)).to_numpy()] = np.arange(len(known))
        start = np.cumsum(counts) - counts
        length = counts[known]
        self.first = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat(start[known] - self.first[:-1], length) + np.arange(self.first[-1])
        self.rows = _unpacked(batch, row, "rows", "n_postings")[at].astype(np.int64)
        tf = _unpacked(batch, row, "occurrences", "n_postings")[at].astype(np.int64)
        m = 10 + (90 * sizes * corpus.n_docs) // corpus.n_words
        self.share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.rows])
        self.most = np.maximum.reduceat(self.share, self.first[:-1]) if len(known) else np.zeros(0, np.int64)
        self.sums = np.zeros(len(self.ids), np.int64)

    def bounds(self, asked: Questions) -> np.ndarray:
        """What each item can score at most in this segment."""
        local = self.local[asked.codes]
        most = np.where(local >= 0, np.append(self.most, 0)[local], 0) * asked.weights[asked.codes]
        total = np.concatenate(([0], np.cumsum(most)))
        return total[asked.first[1:]] - total[asked.first[:-1]]

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of this segment's rows that may be among the best k, given that k rows with `least` are known."""
        local = self.local[codes]
        given = (local >= 0) & (weights[codes] > 0)
        local, weight = local[given], weights[codes][given]
        left = np.append(np.cumsum((weight * self.most[local])[::-1])[::-1], 0)  # what the terms from here on give at most
        sums, threshold, j = self.sums, least, 0
        while j < len(local):
            if k <= len(sums):
                threshold = max(threshold, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
            if left[j] < threshold:
                break
            part = slice(self.first[local[j]], self.first[local[j] + 1])
            sums[self.rows[part]] += weight[j] * self.share[part]
            j += 1
        rows = np.flatnonzero(sums)
        scores = sums[rows]
        sums[rows] = 0  # for the next item
        while j < len(local) and len(rows):
            alive = scores + left[j] >= threshold
            rows, scores = rows[alive], scores[alive]
            part = slice(self.first[local[j]], self.first[local[j] + 1])
            listed = self.rows[part]
            at = np.minimum(np.searchsorted(listed, rows), len(listed) - 1)
            scores = scores + np.where(listed[at] == rows, weight[j] * self.share[part][at], 0)
            j += 1
        return rows, scores


class _Best:
    """The best k rows of every item that a task has seen."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [None] * items
        self.least = np.zeros(items, np.int64)  # the k-th score; 0 while there are fewer rows

    def add(self, item: int, ids: pa.Array, scores: np.ndarray) -> None:
        unknown = ids.is_null().to_numpy(zero_copy_only=False)
        rows = (scores, unknown, ids.fill_null(0).to_numpy())
        if self.rows[item] is not None:
            rows = tuple(np.concatenate(pair) for pair in zip(self.rows[item], rows))
        order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
        self.rows[item] = tuple(column[order] for column in rows)
        if len(order) == self.k:
            self.least[item] = self.rows[item][0][-1]

    def batch(self) -> Iterator[pa.RecordBatch]:
        kept = [(i, rows) for i, rows in enumerate(self.rows) if rows is not None and len(rows[0])]
        if kept:
            scores, unknown, ids = (np.concatenate([rows[c] for _, rows in kept]) for c in range(3))
            item = np.repeat([i for i, _ in kept], [len(rows[0]) for _, rows in kept])
            columns = [pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=unknown), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])


def _document_counts(segments: DataFrame, terms: pa.Array) -> np.ndarray:
    """In how many documents each of the terms is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                number = pc.index_in(_terms(batch, row, terms.type), value_set=terms)
                known = number.is_valid().to_numpy(zero_copy_only=False)
                total[number.drop_null().to_numpy()] += _unpacked(batch, row, "counts", "n_terms")[known]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    columns = ["terms", "lengths", "counts", "n_terms"]
    found = segments.select(*columns).mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(terms), np.int64)
    for row in found.toLocalIterator():  # at most one row per asked term
        out[row["term"]] = row["df"]
    return out


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, terms): the distinct terms of each item."""
    lower = F.translate(F.col(f"`{text}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.col(f"`{item}`").alias("item"), F.explode(found).alias("term"))
    return rows.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _questions(rows: list, segments: DataFrame, corpus: Corpus) -> Questions:
    """The items of a block with their terms numbered and put in order, rarest first."""
    terms = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    column = pa.array(terms, pa.string())
    df = _document_counts(segments, column)
    weights = np.array([math.floor(1000 * math.log((2 * corpus.n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    weights[df == 0] = 0
    codes = []
    for r in rows:
        own = np.array([number[t] for t in r["terms"]], np.int64)
        codes.append(own[np.lexsort((own, df[own]))])
    first = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    return Questions(column, weights, first, np.concatenate(codes))


def _search_block(segments: DataFrame, asked: Questions, corpus: Corpus, k: int, tasks: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(asked.first) - 1, k)
        for batch in batches:
            for row in range(batch.num_rows):
                segment = _Segment(batch, row, asked, corpus)
                bounds = segment.bounds(asked)
                for item in np.flatnonzero((bounds > 0) & (bounds >= best.least)):
                    codes = asked.codes[asked.first[item] : asked.first[item + 1]]
                    rows, scores = segment.best(codes, asked.weights, k, int(best.least[item]))
                    enough = scores >= max(1, best.least[item])
                    rows, scores = rows[enough], scores[enough]
                    if len(rows):
                        best.add(int(item), segment.ids.take(pa.array(rows)), scores)
        yield from best.batch()

    columns = [part.split()[0] for part in SEGMENT.split(", ")]
    return segments.select(*columns).coalesce(tasks).mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def search(segments: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): the best `k` documents of each item. `segments` as from `index`."""
    spark = segments.sparkSession
    n_docs, n_words, postings = segments.agg(F.sum("n_docs"), F.sum("n_words"), F.sum("n_postings")).first()
    kind = dict(items.dtypes)[item]
    empty = spark.createDataFrame([], f"item {kind}, rank int, doc_id bigint, score bigint")
    if not n_docs:
        return empty
    corpus = Corpus(n_docs, n_words)
    tasks = max(spark.sparkContext.defaultParallelism, -(-postings // TASK_POSTINGS))
    terms = materialize(item_terms(items, item, text).withColumn("all", F.lit(0)), "search-items")
    order = materialize(placed(terms, "all", ["item"], F.size("terms"), name="search-order"), "search-blocks")
    blocks = (order.agg(F.max("before")).first()[0] or 0) // block_terms + 1
    found = []
    for block in range(blocks):
        own = order.filter(F.expr(f"before div {block_terms}") == block)
        rows = own.select("position", "item", "terms").orderBy("position").collect()
        if not rows:  # at most `block_terms` terms and those of one item
            continue
        with settings(spark, SEARCHING):
            asked = _questions(rows, segments, corpus)
            names = own.select((F.col("position") - rows[0]["position"]).alias("number"), "item")
            hits = _search_block(segments, asked, corpus, k, tasks)
            ranked = top_per_key(hits, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, "rank")
            named = ranked.withColumnRenamed("item", "number").join(names, "number")
            found.append(materialize(named.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-found"))
    return reduce(DataFrame.unionByName, found) if found else empty
