"""Filtered vector search over a chunk table, reranking, context expansion and formatting.

Questions come as a table: query_id, query, user_id, date_from, source_filter, doc_type, k_results,
embedding. Chunks: chunk_key, source, user_id, filename, chunk_index, chunk_type, doc_type, created_at,
content, embedding. The chunk table is the large side and is never shuffled as a whole: questions are taken in
blocks of a checked size, and the hits of one block are a few rows per question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions import text as T
from lorewell.functions.dates import strict_date
from lorewell.functions.vectors import cosine
from lorewell.operators.admission import download_path
from lorewell.operators.skew import top_per_key
from lorewell.session import shared_dir

BLOCK_QUESTIONS = 4096
DIGITS = 9  # similarities are compared after rounding, so that equal vectors tie everywhere
QUESTION_SLICE = 256  # questions scored at a time against one batch of chunks
BM25_K1, BM25_B = 1.2, 0.75
QUESTION_COLUMNS = [
    "query_id", "query", "user_id", "date_from", "source_filter", "doc_type", "k_results", "embedding"
]


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add `error` (NULL when the request can run) and fill in the default number of results."""
    k = F.coalesce("k_results", F.lit(K.K_DEFAULT)).cast("bigint")
    error = F.when(T.is_blank(F.col("query")), F.lit(K.EMPTY_QUERY_ERROR)).when(
        ~k.between(K.K_MIN, K.K_MAX), F.lit(f"{K.ERROR_PREFIX} k_results must be between {K.K_MIN} and {K.K_MAX}.")
    )
    return requests.withColumn("k_results", k).withColumn("error", error)


def metadata_filter(
    date_from: str | None = None,
    source_filter: str | None = None,
    user_id: str | None = None,
    doc_type: str | None = None,
) -> Column | None:
    """Filter of one request on the chunk table; absent parts and an invalid date are left out, none gives None.

    A plain predicate, so it reaches the file scan.
    """
    parts = []
    if date_from and not pd.isna(pd.to_datetime(date_from, format="%Y-%m-%d", errors="coerce")):
        parts.append(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if source_filter:
        parts.append((F.col("source") == source_filter) | (F.col("filename") == source_filter))
    if user_id:
        parts.append(F.col("user_id") == user_id)
    if doc_type:
        parts.append(F.col("doc_type") == doc_type)
    combined = None
    for part in parts:
        combined = part if combined is None else combined & part
    return combined


def overfetch(k: Column) -> Column:
    """Number of candidates for `k` results."""
    return F.floor(F.lit(K.OVERFETCH) * k)


def question_blocks(questions: DataFrame, limit: int = BLOCK_QUESTIONS) -> list[DataFrame]:
    """The questions in hash blocks, each checked to hold at most `limit` rows; every question needs an id of its own."""
    n, ids = questions.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if ids < n:
        raise ValueError("query_id must be unique and not NULL")
    blocks = -(-n // limit)
    while blocks > 1:  # distinct ids spread over more and more blocks
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        largest = questions.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0]
        if largest <= limit:
            return [questions.filter(block == b) for b in range(blocks)]
        blocks *= 2
    return [questions]


def _scan_filter(rows: list) -> Column | None:
    """What every question of a block demands, as a predicate for the file scan."""
    users = {r["user_id"] for r in rows}
    dates = {r["from_us"] for r in rows}
    parts = []
    if users and None not in users:
        parts.append(F.col("user_id").isin(sorted(users)))
    if dates and None not in dates:
        parts.append(F.col("created_at") >= F.timestamp_micros(F.lit(min(dates))))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


class _Scorer:
    """Scores Arrow batches of chunks against one block of questions; a task keeps the best rows and emits them once."""

    def __init__(self, rows: list):
        matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
        self.unit = self._normal(matrix)
        self.rows = [
            (r["query_id"], r["user_id"], r["from_us"], r["source_filter"], r["doc_type"], int(r["n"])) for r in rows
        ]
        self.slice = QUESTION_SLICE

    @staticmethod
    def _normal(matrix: np.ndarray) -> np.ndarray:
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)

    def _best(self, similarity: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        candidates = np.arange(len(similarity))
        if len(similarity) > n:
            threshold = np.partition(similarity, len(similarity) - n)[len(similarity) - n]
            candidates = np.flatnonzero(similarity >= threshold)
        order = np.lexsort((keys[candidates], -similarity[candidates]))
        return candidates[order[:n]]

    def _score(self, batch: pd.DataFrame, questions: np.ndarray, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Adds the batch to what is `held` per question, at most its n best rows; only the numbered questions ask."""
        chunk_unit = self._normal(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
        codes = {}
        for name in ("user_id", "source", "filename", "doc_type"):
            numbers, values = pd.factorize(batch[name])
            codes[name] = (numbers, {v: i for i, v in enumerate(values)})
        created = batch["created_us"].to_numpy()
        keys = batch["chunk_key"].to_numpy()
        if keys.dtype == object:
            keys = keys.astype(str)

        def equals(name: str, value) -> np.ndarray:
            numbers, known = codes[name]
            return numbers == known.get(value, -2)

        for start in range(0, len(questions), self.slice):
            part = questions[start : start + self.slice]
            scores = np.round(self.unit[part] @ chunk_unit.T, DIGITS)
            for j, number in enumerate(part):
                _, user, since, source, doc_type, n = self.rows[number]
                if user is None and since is None and source is None and doc_type is None:
                    best = self._best(scores[j], keys, n)
                else:
                    allowed = np.ones(len(batch), dtype=bool)
                    if user is not None:
                        allowed &= equals("user_id", user)
                    if since is not None:
                        allowed &= created >= since
                    if source is not None:
                        allowed &= equals("source", source) | equals("filename", source)
                    if doc_type is not None:
                        allowed &= equals("doc_type", doc_type)
                    rows = np.flatnonzero(allowed)
                    best = rows[self._best(scores[j, rows], keys[rows], n)]
                values, found = scores[j, best], keys[best]
                if number in held:
                    values, found = np.concatenate((held[number][0], values)), np.concatenate((held[number][1], found))
                    order = np.lexsort((found, -values))[:n]
                    values, found = values[order], found[order]
                if len(values):
                    held[number] = (values, found)

    def _batch(self, batch: pd.DataFrame, held: dict) -> None:
        self._score(batch, np.arange(len(self.rows)), held)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if len(batch):
                self._batch(batch, held)
        for number in sorted(held):
            values, found = held[number]
            yield pd.DataFrame({"query_id": [self.rows[number][0]] * len(values), "chunk_key": found, "similarity": values})


class _CellScorer(_Scorer):
    """As `_Scorer`, but a question meets only the chunks of its own cells; `cells` has a row of cells per question."""

    def __init__(self, rows: list, cells: np.ndarray):
        super().__init__(rows)
        order = np.argsort(cells.ravel(), kind="stable")
        self.cells, first = np.unique(cells.ravel()[order], return_index=True)
        self.asking = np.split(order // cells.shape[1], first[1:])

    def _batch(self, batch: pd.DataFrame, held: dict) -> None:
        for cell, part in batch.groupby("cell"):
            at = np.searchsorted(self.cells, cell)
            if at < len(self.cells) and self.cells[at] == cell:
                self._score(part, self.asking[at], held)


def _topk_block(
    block: DataFrame, chunks: DataFrame, n: Column, limit: int | None, probe: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """Best rows of one block of questions. `probe` gives the cells of each question's vector; then `chunks` have a column
    `cell`, only the partitions of asked cells are read, and a question meets the chunks of its own cells alone."""
    as_key = block.select(
        *QUESTION_COLUMNS[:6], F.unix_micros(strict_date(F.col("date_from"))).alias("from_us"),
        n.alias("n"), "embedding",
    )
    blank_free = lambda c: F.when(F.length(c) > 0, F.col(c)).alias(c)
    rows = as_key.select(
        "query_id", "from_us", "n", "embedding", blank_free("user_id"), blank_free("source_filter"),
        blank_free("doc_type"),
    ).collect()  # at most BLOCK_QUESTIONS rows, checked by question_blocks
    types = dict(block.dtypes), dict(chunks.dtypes)
    schema = f"query_id {types[0]['query_id']}, chunk_key {types[1]['chunk_key']}, similarity double"
    if not rows:
        return block.sparkSession.createDataFrame([], schema + ", vector_rank bigint")
    limit = max(int(r["n"]) for r in rows) if limit is None else limit
    wanted = _scan_filter(rows)
    scanned = chunks if wanted is None else chunks.filter(wanted)
    columns = ["chunk_key", "user_id", "source", "filename", "doc_type", F.unix_micros("created_at").alias("created_us"), "embedding"]
    if probe is None:
        scorer = _Scorer(rows)
    else:
        scorer = _CellScorer(rows, probe(np.array([r["embedding"] for r in rows], dtype=np.float64)))
        scanned, columns = scanned.filter(F.col("cell").isin(scorer.cells.tolist())), [*columns, "cell"]
    scored = scanned.select(*columns).mapInPandas(scorer, schema)
    ranked = top_per_key(
        scored, ["query_id"], [F.col("similarity").desc(), F.col("chunk_key")], limit, "vector_rank"
    )
    per_question = block.sparkSession.createDataFrame(
        [(r["query_id"], int(r["n"])) for r in rows], f"query_id {types[0]['query_id']}, n bigint"
    )
    return (
        ranked.join(F.broadcast(per_question), "query_id")  # one block of questions
        .filter(F.col("vector_rank") <= F.col("n"))
        .drop("n")
    )


def vector_topk(
    questions: DataFrame,
    chunks: DataFrame,
    n: Column | None = None,
    limit: int | None = None,
    one_block: bool = False,
) -> DataFrame:
    """The `n` most similar allowed chunks per question, ties by chunk key; `limit` caps `n` if it is given.

    Exact. Each block of questions goes to the tasks as one matrix; a task multiplies it with its own
    chunks and keeps each question's best rows, so the shuffle carries questions x tasks x n small rows.
    Output: query_id, chunk_key, similarity, vector_rank. `one_block`: the caller has checked the size.
    """
    n = overfetch(F.col("k_results")) if n is None else n
    blocks = [questions] if one_block else question_blocks(questions)
    if len(blocks) == 1:
        return _topk_block(blocks[0], chunks, n, limit)
    # one block after the other into one written table, so the driver holds one block at a time
    path = shared_dir(questions.sparkSession, "topk")
    for number, block in enumerate(blocks):
        part = _topk_block(block, chunks, n, limit)
        part.write.parquet(f"{path}/block={number}")
    return questions.sparkSession.read.schema(part.schema).parquet(path)


def attach_chunks(hits: DataFrame, chunks: DataFrame, bounded: bool = False) -> DataFrame:
    """Hits with their chunk's columns. `bounded` states that the hits are those of one question block."""
    payload = chunks.drop("embedding")
    return payload.join(_side(hits, bounded), "chunk_key")


def _side(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def simple_search(questions: DataFrame, chunks: DataFrame, k: int = K.K_SIMPLE) -> DataFrame:
    """User-scoped search without other filters: the `k` best contents per question."""
    user_only = questions.select(
        "query_id", "query", "user_id",
        *[F.lit(None).cast("string").alias(c) for c in ("date_from", "source_filter", "doc_type")],
        "k_results", "embedding",
    )
    hits = vector_topk(user_only, chunks, F.lit(k), k)
    return attach_chunks(hits, chunks).select("query_id", F.col("vector_rank").alias("rank"), "content")


# --- reranking --------------------------------------------------------------

def snippet(content: Column, chars: int | None = None) -> Column:
    """Chunk text on one line; `chars` shortens it for a model that reads only so much."""
    flat = F.replace(content, F.lit("\n"), F.lit(" "))
    return flat if chars is None else F.substring(flat, 1, chars)


@dataclass(frozen=True)
class IndexStatistics:
    """What BM25 needs to know of a chunk table: its size, mean length, and chunks per term (term, df)."""

    n_chunks: int
    mean_words: float
    frequency: DataFrame


def index_statistics(chunks: DataFrame, terms: DataFrame | None = None) -> IndexStatistics:
    """Statistics of the whole vocabulary, worth writing next to the index, or of the given terms only.

    Counts are combined before the shuffle, so a word that stands in every chunk is one row per task.
    """
    words = T.words(snippet(F.col("content")))
    totals = chunks.agg(F.count("*"), F.avg(F.size(words))).first()
    held = chunks.select(F.explode(F.array_distinct(words)).alias("term"))
    if terms is not None:
        held = held.join(terms.select("term").distinct(), "term", "left_semi")
    return IndexStatistics(totals[0], totals[1] or 0.0, held.groupBy("term").agg(F.count("*").alias("df")))


def bm25_scores(
    candidates: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    bounded: bool = False,
    snippet_chars: int | None = None,
    statistics: IndexStatistics | None = None,
) -> DataFrame:
    """Candidates (query_id, content, ...) with `score`, the BM25 weight of their text for the question.

    `statistics` kept with the index save the two scans of the chunk texts that compute them here.
    """
    terms = questions.select("query_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))
    known = statistics or index_statistics(chunks, terms)
    n, mean_words = F.lit(known.n_chunks), F.lit(known.mean_words)
    rarity = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per_question = (
        known.frequency.join(_side(terms, bounded), "term")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", rarity.alias("idf")))).alias("terms"))
    )
    joined = candidates.join(_side(per_question, bounded), "query_id", "left")
    words = T.words(snippet(F.col("content"), snippet_chars))

    def weight(term: Column) -> Column:
        tf = F.size(F.filter(F.col("__w"), lambda w: w == term["term"]))
        length = F.size("__w") / mean_words
        return term["idf"] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length))

    total = F.aggregate(F.transform("terms", weight), F.lit(0.0), lambda acc, x: acc + x)
    return (
        joined.withColumn("__w", words)
        .withColumn("score", F.coalesce(F.round(total, DIGITS), F.lit(0.0)))
        .drop("__w", "terms")
    )


def rank_scored(scored: DataFrame, k: Column) -> DataFrame:
    """Keep the relevant candidates (score > 0), best first, at most `k`; ties by vector rank.

    A question whose scores are all NULL could not be judged and falls back to vector order; a question
    that was judged and has no relevant candidate stays empty. Candidate sets are bounded per question.
    """
    per_question = Window.partitionBy("query_id")
    flagged = scored.withColumn("failed", F.max(F.col("score").isNotNull()).over(per_question) == F.lit(False))
    kept = flagged.filter(F.col("failed") | (F.col("score") > 0))
    order = per_question.orderBy(F.col("score").desc_nulls_last(), F.col("vector_rank"))
    return (
        kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).drop("failed")
    )


# --- context ----------------------------------------------------------------

def expand_adjacent(hits: DataFrame, chunks: DataFrame, bounded: bool = False) -> DataFrame:
    """(query_id, rank, expanded): chunks index-1, index, index+1 of the hit's user and source, in order.

    Hits without source or index, and hits whose window is empty, are absent: they keep their own text.
    """
    wanted = hits.select(
        "query_id", "rank", F.coalesce("query_user", "user_id").alias("user_id"), "source",
        F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index"), F.col("chunk_index") + 1)).alias("chunk_index"),
    )
    around = chunks.select("chunk_key", "user_id", "source", "chunk_index", "content").join(
        _side(wanted, bounded), ["user_id", "source", "chunk_index"]
    )
    return _joined_text(around, "\n")


def expand_document(
    hits: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = K.DOCUMENT_CONTEXT_CHUNKS, bounded: bool = False
) -> DataFrame:
    """(query_id, rank, expanded): the `k` chunks of the hit's source nearest to the question, in index order."""
    wanted = hits.select("query_id", "rank", F.coalesce("query_user", "user_id").alias("user_id"), "source")
    vectors = wanted.join(questions.select("query_id", F.col("embedding").alias("query_vector")), "query_id")
    same = chunks.select("chunk_key", "user_id", "source", "chunk_index", "content", "embedding").join(
        _side(vectors, bounded), ["user_id", "source"]
    )
    similarity = F.round(F.coalesce(cosine(F.col("embedding"), F.col("query_vector")), F.lit(0.0)), DIGITS)
    scored = same.select("query_id", "rank", "chunk_key", "chunk_index", "content", similarity.alias("similarity"))
    best = top_per_key(scored, ["query_id", "rank"], [F.col("similarity").desc(), F.col("chunk_key")], k, "nth")
    return _joined_text(best.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0))), "\n\n")


def _joined_text(rows: DataFrame, separator: str) -> DataFrame:
    """Texts of a hit's few chunks in index order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_key", "content")))
    return rows.groupBy("query_id", "rank").agg(
        F.array_join(F.transform(ordered, lambda r: r["content"]), separator).alias("expanded")
    )


def expand_hits(hits: DataFrame, chunks: DataFrame, questions: DataFrame, bounded: bool = False) -> DataFrame:
    """Hits with `context`: by document for `agentic` chunks, by neighbours for the others."""
    agentic = F.coalesce("chunk_type", F.lit("markdown")) == "agentic"
    near = expand_adjacent(
        hits.filter(~agentic & F.col("chunk_index").isNotNull() & F.col("source").isNotNull()), chunks, bounded
    )
    whole = expand_document(hits.filter(agentic), chunks, questions, bounded=bounded)
    joined = hits.join(near.unionByName(whole), ["query_id", "rank"], "left")
    own = F.when(~agentic, F.col("content"))
    return joined.withColumn("context", F.coalesce(F.when(F.length("expanded") > 0, F.col("expanded")), own)).drop("expanded")


def dedup_hits(hits: DataFrame) -> DataFrame:
    """Drop blank contexts, repeated chunks and repeated `agentic` sources of a question; best rank stays."""
    kept = hits.filter(~T.is_blank(F.col("context")))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    kept = kept.withColumn("__n", best("query_id", "source", "chunk_index")).filter("__n = 1")
    agentic = F.coalesce("chunk_type", F.lit("markdown")) == "agentic"
    kept = kept.withColumn("__n", best("query_id", "source", agentic))
    return kept.filter(~agentic | (F.col("__n") == 1)).drop("__n")


def format_hit(url_base: str | None = None) -> Column:
    """`Fuente: [name](url) (Tipo: type)` over the hit's context; without a base the link is `#`."""
    source = F.coalesce("source", F.lit("desconocido"))
    path = download_path(source, F.coalesce("query_user", "user_id"))
    url = F.lit("#") if url_base is None else F.concat(F.lit(url_base), path)
    return F.concat(
        F.lit("Fuente: ["), F.coalesce("filename", source), F.lit("]("), url, F.lit(") (Tipo: "),
        F.coalesce("doc_type", F.lit("general")), F.lit(")\n"), F.col("context"),
    )


def format_context(hits: DataFrame, url_base: str | None = None) -> DataFrame:
    """(query_id, context): a question's formatted hits in rank order; at most seven per question."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", format_hit(url_base).alias("block"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda b: b["block"]), K.CONTEXT_SEPARATOR).alias("context")
    )


def empty_result_marker(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every question with its context, or the fixed text when nothing was found."""
    return questions.select("query_id").join(contexts, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(K.NOTHING_FOUND)).alias("context")
    )
