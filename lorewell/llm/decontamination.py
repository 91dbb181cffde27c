"""Benchmark decontamination: shared n-grams seed candidate passages, Smith-Waterman alignment scores them.

1. Test items are cut in passages of at most `PASSAGE` words (overlapping by half; most items are one passage). Passages
   are handled in blocks of a bounded number of words; a block is what is broadcast, whatever the number of items.
2. Every n-gram of a passage is a seed, however many documents hold it, so what is found in a document depends on that
   document and the item alone. (Rare seeds only, or the rarest of every stretch, would lose links: at a threshold of one half a third
   of the words, evenly spread, may be replaced, and then no stretch longer than a seed is sure to survive.)
3. One pass joins document passages with test passages on the seeds, by diagonals. An alignment that reaches the threshold holds that
   share of the passage's words and has a bounded number of gaps (`slack`). So a joined pair's window reaches that far to both
   sides, and pairs whose window holds too few of the passage's words are dropped unaligned: common seeds such as "one of
   the" meet many passages, but few windows hold half the words of one.
4. The pairs left are aligned in the task that holds the text: match 2, mismatch and gap -1, on words. `score` is the
   alignment's share of a full match, so that edited or paraphrased copies are found as well as exact ones. It equals plain
   Smith-Waterman on the whole text wherever that reaches the threshold and the two share a seed.

Words are runs of letters and digits, lower-cased (A-Z). Edge cases: NULL and empty texts match nothing; items with fewer
than `NGRAM` words are too short to be evidence and match nothing, items below `SHORT` words count only as full
copies; repeated rows and NULL ids give rows like any other, one per (doc_id, item_id).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import words
from lorewell.llm.common import per_text
from lorewell.session import materialize

NGRAM = 3
PASSAGE = 128
#: Words of one broadcast block of passages; also keeps n-gram keys below 2**63.
BLOCK_WORDS = 500_000
THRESHOLD = 0.5
SHORT = 8
#: Joined pairs share one window per this many diagonals.
BAND = 32
MATCH, MISMATCH, GAP = 2, -1, -1
ALIGN_STEP = 2048
#: (window, word) marks held at once.
WORD_STEP = 1 << 24
#: Joined places held at once (one n-gram's places may be more).
JOIN_STEP = 1 << 20


@dataclass
class Passages:
    """A block of passages: its vocabulary, word ids, and n-gram keys with their places."""

    vocabulary: pa.Array
    ids: np.ndarray
    first: np.ndarray
    item: np.ndarray
    grams: np.ndarray
    post_first: np.ndarray
    post_passage: np.ndarray
    post_at: np.ndarray

    @classmethod
    def build(cls, items: list[int], texts: list[str]) -> Passages:
        w = words.split(words.text_column(pa.array(texts, pa.string())), words.ALPHANUMERIC, lower=True)
        ids = w.codes.astype(np.int64)
        size = max(len(w.distinct), 1)
        at = words.windows(w.first, NGRAM)
        passage = w.text[at]
        key = _keys(ids, at, size)
        order = np.argsort(key, kind="stable")
        grams, start = np.unique(key[order], return_index=True)
        return cls(w.distinct, ids, w.first, np.array(items), grams, np.append(start, len(order)), passage[order],
                   (at - w.first[passage])[order])

    def word_ids(self, w: words.Words) -> np.ndarray:
        """For each word its id in the vocabulary, or -1."""
        known = pc.fill_null(pc.index_in(w.distinct, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        return known.astype(np.int64)[w.codes] if len(known) else np.zeros(0, np.int64)

    def occurrences(self, w: words.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, gram) of every n-gram of the texts that is one of the block's."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = words.windows(w.first, NGRAM)
        known = ids >= 0
        for i in range(NGRAM):
            inside = inside[known[inside + i]]
        key = _keys(ids, inside, max(len(self.vocabulary), 1))
        place = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        found = self.grams[place] == key
        return inside[found], place[found]


def _keys(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    key = np.zeros(len(at), np.int64)
    for i in range(NGRAM):
        key = key * size + ids[at + i]
    return key


def slack(length: int, threshold: float) -> int:
    """The most gaps of an alignment that reaches the threshold: every word matched, and the rest of the score spent on gaps."""
    return int(np.floor(MATCH * (1 - threshold) * length / -GAP + 1e-9))


def _enough_words(query: np.ndarray, window: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether at least `least` words of each query row are in the same row of `window`. An alignment matches no more words than that."""
    size = int(query.max(initial=0)) + 1
    step = max(1, WORD_STEP // size)
    enough = np.zeros(len(query), bool)
    for a in range(0, len(query), step):
        q, w = query[a : a + step], window[a : a + step]
        row = np.arange(len(q))[:, None] * size
        held = np.zeros(len(q) * size, bool)
        held[(row + w)[w >= 0]] = True
        enough[a : a + step] = (held[np.where(q >= 0, row + q, 0)] & (q >= 0)).sum(axis=1) >= least[a : a + step]
    return enough


def _local(query: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, query) with small word numbers: those of the queries' words; other words of the windows are padding."""
    known = np.unique(query[query >= 0])
    place = np.minimum(np.searchsorted(known, window), len(known) - 1)
    return np.where(known[place] == window, place, -2), np.where(query >= 0, np.searchsorted(known, query), -1)


def align(query: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of `query` with the same row of `window` (negative ids: padding).

    Row by row over the queries; a gap along the window is a running maximum, so rows stay vectorised.
    """
    n, width = window.shape
    slope = np.arange(width, dtype=np.int16) * np.int16(-GAP)
    row = np.zeros((n, width), np.int16)
    best = np.zeros(n, np.int16)
    for i in range(query.shape[1]):
        word = query[:, i : i + 1]
        diagonal = np.where((window == word) & (word >= 0), np.int16(MATCH), np.int16(MISMATCH))
        diagonal[:, 1:] += row[:, :-1]
        top = np.maximum(np.maximum(diagonal, row + np.int16(GAP)), 0)
        row = np.maximum.accumulate(top + slope, axis=1) - slope
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _candidates(block: Passages, w: words.Words, ids: np.ndarray):
    """(text, passage, first diagonal of the band) of the joined pairs, without repeats."""
    at, gram = block.occurrences(w, ids)
    n = np.diff(block.post_first)[gram]
    total = np.concatenate(([0], np.cumsum(n)))
    lowest = -(-PASSAGE // BAND)
    bands = int(np.diff(w.first).max(initial=0)) // BAND + 1 + lowest
    found, a = [np.zeros(0, np.int64)], 0
    while a < len(at):
        b = max(int(np.searchsorted(total, total[a] + JOIN_STEP, "right")) - 1, a + 1)
        part, size = at[a:b], n[a:b]
        post = np.repeat(block.post_first[:-1][gram[a:b]] - (total[a:b] - total[a]), size) + np.arange(total[b] - total[a])
        part = np.repeat(part, size)
        text, passage = w.text[part], block.post_passage[post]
        band = (part - w.first[text] - block.post_at[post]) // BAND
        found.append(np.unique((text * len(block.first) + passage) * bands + band + lowest))
        a = b
    keys = np.unique(np.concatenate(found))
    pair, band = keys // bands, keys % bands - lowest
    return pair // len(block.first), pair % len(block.first), band * BAND


def hits(block: Passages, texts: pa.Array, threshold: float) -> list:
    """Joins the texts with the seeds of the block and aligns; per text the items (places in the block's list) and their best scores."""
    w = words.split(texts, words.ALPHANUMERIC, lower=True)
    ids = block.word_ids(w)
    text, passage, begin = _candidates(block, w, ids)
    size = np.diff(block.first)
    order = np.argsort(size[passage], kind="stable")
    text, passage, begin = text[order], passage[order], begin[order]
    score = np.zeros(len(text))
    for k in range(0, len(text), ALIGN_STEP):
        part = np.arange(k, min(k + ALIGN_STEP, len(text)))
        length = size[passage[part]]
        longest = int(length.max())
        row = np.arange(longest)
        query = np.where(
            row < length[:, None], block.ids[np.minimum(block.first[passage[part]][:, None] + row, len(block.ids) - 1)], -1
        )
        wide = slack(longest, threshold)
        column = (begin[part] - wide)[:, None] + np.arange(longest + BAND + 2 * wide)
        start, stop = w.first[text[part]][:, None], w.first[text[part] + 1][:, None]
        inside = (column >= 0) & (start + column < stop)
        window = np.where(inside, ids[np.clip(start + column, 0, len(ids) - 1)], -2)
        own, query = _local(query, window)
        least = np.where(length < SHORT, length, np.ceil(threshold * length - 1e-9))
        left = _enough_words(query, own, least)
        score[part[left]] = align(query[left], own[left]) / (MATCH * length[left])
    hit = score >= np.where(size[passage] < SHORT, 1.0, threshold)
    item = block.item[passage[hit]]
    text, score = text[hit], score[hit]
    order = np.lexsort((-score, item, text))
    text, item, score = text[order], item[order], score[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    offsets = pa.array(np.searchsorted(text[new], np.arange(len(texts) + 1)), pa.int32())
    return [
        pa.ListArray.from_arrays(offsets, pa.array(item[new], pa.int64())),
        pa.ListArray.from_arrays(offsets, pa.array(score[new], pa.float64())),
    ]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS):
    """Yields (rows of item_id and number, passages) of bounded blocks, each collected by itself.

    A passage is collected once, however many items have it; the items stay in Spark, under the passage's number.
    """

    def cut(texts: pa.Array) -> list:
        w = words.split(texts, words.ALPHANUMERIC, lower=True)
        out = []
        for i in range(len(texts)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            starts = range(a, max(b - PASSAGE // 2, a + 1), PASSAGE // 2)
            out.append([
                b" ".join(w.data[w.starts[k] : w.ends[k]].tobytes() for k in range(s, min(s + PASSAGE, b))).decode()
                for s in starts
            ] if b - a >= NGRAM else [])
        return [out]

    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    passages = per_text(items, "text", cut, "passages array<string>", ["item_id"])
    passages = passages.select("row.item_id", F.explode("passages").alias("passage")).distinct()
    passages = materialize(passages, "benchmark-passages")
    spark, once = passages.sparkSession, passages.select("passage").distinct()
    n_words = once.agg(F.sum(F.size(F.split("passage", " ")))).first()[0] or 0
    n_blocks = -(-2 * n_words // block_words)
    for k in range(n_blocks):
        mine = F.pmod(F.xxhash64("passage"), F.lit(n_blocks)) == k
        texts = [r["passage"] for r in once.filter(mine).orderBy("passage").collect()]  # about half a block's bound
        numbers = spark.createDataFrame(list(enumerate(texts)), "number bigint, passage string")
        named = passages.filter(mine).join(F.broadcast(numbers), "passage").select("item_id", "number")
        yield named, Passages.build(list(range(len(texts))), texts)


def marked(docs: DataFrame, text: str, block: Passages, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """The documents as struct `row` with arrays `items` (numbers of the block's passages) and `scores`."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS places
    return per_text(docs, text, lambda t: hits(shared.value, t, threshold), "items array<bigint>, scores array<double>", keep)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per (doc_id, item_id) whose alignment reaches the threshold, with the best score."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = benchmark.select(F.col(f"`{item_id}`")).schema[0].dataType.simpleString()
    out = spark.createDataFrame([], f"{narrow.schema['doc_id'].simpleString().replace(':', ' ')}, item_id {kind}, score double")
    for names, block in blocks(benchmark, item_id, item_text, block_words):
        found = marked(narrow, "text", block, threshold, ["doc_id"]).filter(F.size("items") > 0)
        pairs = found.select("row.doc_id", F.explode(F.arrays_zip("items", "scores")).alias("p"))
        if names.limit(block_words + 1).count() <= block_words:
            names = F.broadcast(names)  # no more rows than a block has words; repeated passages may have more
        named = pairs.join(names, F.col("p.items") == F.col("number"))
        out = out.unionByName(named.select("doc_id", "item_id", F.col("p.scores").alias("score")))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without any aligned passage of the benchmark, with their own columns."""
    out = docs
    for _, block in blocks(benchmark, "item_id", "text", block_words):
        out = marked(out, text, block, threshold).filter(F.size("items") == 0).select("row.*")
    return out
