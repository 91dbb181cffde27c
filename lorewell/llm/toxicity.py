"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, and pairs with one word left out. Training reads
a bounded sample of labelled ids (`MAX_ROWS`, the first in the order of a hash of the id) with one text each, so it runs in
one task;
per-coordinate learning rates and L1 keep few weights, which are broadcast. Scoring covers every whole text.

Words are runs of letters and digits, lower-cased (A-Z). Edge cases: NULL and empty texts get the score of the intercept;
without any labelled row every score is the prior 0.25; a document labelled twice counts as toxic if any label says so,
a NULL label is no label; of the texts of a repeated id the first in byte order is learned from; for scoring, repeated rows
and NULL ids are rows like any other; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm import words
from lorewell.llm.common import per_text

BITS = 20
#: Bound of the training sample, in documents.
MAX_ROWS = 40_000
#: Documents whose gradients are summed before an update, and passes over the sample.
BATCH, EPOCHS = 64, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.5
#: Features of fewer sampled documents are not learned.
LEAST_DOCS = 3
#: Features looked up at once, so that no wide copy of all of them is made.
STEP = 1 << 22
SKIPS = (1, 2)

_MULTIPLIER = np.uint64(0xFF51AFD7ED558CCD)


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    """A well-mixed hash of 64-bit values in `bits` bits."""
    x = (x ^ (x >> np.uint64(33))) * _MULTIPLIER
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def occurrences(w: words.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, pair and skip-gram."""
    digest = xxhash.xxh64_intdigest
    of_distinct = np.fromiter((digest(b) for b in w.distinct.to_pylist()), np.uint64, len(w.distinct))
    h = of_distinct[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    text, feature = [w.text], [_bucket(h, bits)]
    for skip in SKIPS:
        same = w.text[:-skip] == w.text[skip:]
        pair = h[:-skip] * np.uint64(0x9E3779B97F4A7C15 + 2 * skip) + h[skip:]
        text.append(w.text[:-skip][same])
        feature.append(_bucket(pair[same], bits))
    return np.concatenate(text), np.concatenate(feature)


def distinct_features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, features) of the distinct features of each text."""
    text, feature = occurrences(words.split(texts, words.ALPHANUMERIC, lower=True), bits)
    both = np.unique((text << bits) | feature)
    return np.searchsorted(both >> bits, np.arange(len(texts) + 1)), both & ((1 << bits) - 1)


@dataclass
class Model:
    """Sparse weights and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int = BITS

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = words.split(texts, words.ALPHANUMERIC, lower=True)
        text, feature = occurrences(w, self.bits)
        counted = self.dense[feature] != 0
        both = np.unique((text[counted] << self.bits) | feature[counted])
        total = np.bincount(both >> self.bits, self.dense[both & ((1 << self.bits) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30)))


def _counts(features: np.ndarray, bits: int) -> np.ndarray:
    """The number of documents with each feature."""
    out = np.zeros(1 << bits, np.int64)
    for a in range(0, len(features), STEP):
        out += np.bincount(features[a : a + STEP], minlength=1 << bits)
    return out


def train(offsets: np.ndarray, features: np.ndarray, label: np.ndarray, bits: int = BITS) -> Model:
    """FTRL-proximal over the documents in the given order."""
    n_docs = len(label)
    prior = (label.sum() + 0.5) / (n_docs + 2)
    intercept, drift = float(np.log(prior / (1 - prior))), 1.0
    common = _counts(features, bits) >= LEAST_DOCS
    kept = np.empty(len(features), bool)
    for a in range(0, len(features), STEP):
        kept[a : a + STEP] = common[features[a : a + STEP]]
    if not kept.all():
        offsets, features = np.concatenate(([0], np.cumsum(kept)))[offsets], features[kept]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        return np.where(
            np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        )

    for _ in range(EPOCHS):
        for start in range(0, n_docs, BATCH):
            end = min(start + BATCH, n_docs)
            a, b = offsets[start], offsets[end]
            doc = np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1]))
            used, place = np.unique(features[a:b], return_inverse=True)
            w = weights(used)
            score = np.bincount(doc, w[place], end - start) + intercept
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[start:end]
            # each document is one example: squares of its own gradients feed the per-coordinate rates
            each = error[doc]
            gradient = np.bincount(place, each, len(used))
            grown = n[used] + np.bincount(place, each * each, len(used))
            z[used] += gradient - (np.sqrt(grown) - np.sqrt(n[used])) / ALPHA * w
            n[used] = grown
            drift += float((error * error).sum())
            intercept -= ALPHA * float(error.sum()) / (BETA + drift**0.5)
    index = np.flatnonzero(np.abs(z) > L1)
    return Model(index, weights(index).astype(np.float32), intercept, bits)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", max_rows: int = MAX_ROWS,
) -> Model:
    """A model of the labelled documents for which `learn` (over the id, named doc_id) holds."""
    asked = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    asked = asked.filter(learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    sample = asked.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = narrow.join(F.broadcast(sample), "doc_id")  # at most max_rows ids
    # one text per id, combined before the shuffle
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(texts: pa.Array) -> list:
        offsets, found = distinct_features(texts)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))]

    packed = per_text(rows, "text", features, "features array<int>", ["doc_id", "label"])
    ordered = packed.select(F.xxhash64("row.doc_id").alias("place"), "row.label", "features").repartition(1)

    def learn_all(batches):
        flat, sizes, labels = [], [], [np.zeros(0)]
        count = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            lists = batch.column("features")
            found = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            count += _counts(found, BITS)
            flat.append(found)
            sizes.append(lists.value_lengths().to_numpy(zero_copy_only=False))
            labels.append(batch.column("label").to_numpy(zero_copy_only=False))
        common, offsets = count >= LEAST_DOCS, [np.zeros(1, np.int64)]
        for i, (found, size) in enumerate(zip(flat, sizes)):  # rare features go before anything is put together
            kept = common[found]
            flat[i] = found[kept]
            offsets.append(offsets[-1][-1] + np.concatenate(([0], np.cumsum(kept)))[np.cumsum(size)])
        features = np.empty(int(offsets[-1][-1]), np.int32)
        for end in offsets[:0:-1]:  # a part is let go once it is put in its place
            found = flat.pop()
            features[end[-1] - len(found) : end[-1]] = found
        model = train(np.concatenate(offsets), features, np.concatenate(labels).astype(float))
        index = np.append(model.index, -1)  # the intercept under -1
        weight = np.append(model.weight.astype(float), model.intercept)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(weight)], names=["i", "w"])

    found = ordered.sortWithinPartitions("place", "label").mapInArrow(learn_all, "i bigint, w double").toPandas()
    index, weight = found["i"].to_numpy(np.int64), found["w"].to_numpy()
    own = index >= 0
    intercept = float(weight[~own][0]) if (~own).any() else float(np.log(1 / 3))
    return Model(index[own], weight[own].astype(np.float32), intercept)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns `keep`) as struct `row`, with their score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, text, lambda t: [shared.value.scores(t)], "score double", keep)
