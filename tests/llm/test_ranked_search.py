import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from lorewell.llm import ranked_search as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def plain_scores(docs, items):
    """{item: [(doc position, score)]} of all documents with a score above 0."""
    bags = [Counter(terms_of(text)) for _, text in docs]
    n_docs, n_words = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = {}
    for item, terms in asked.items():
        found = []
        for i, bag in enumerate(bags):
            score = 0
            for t in terms & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // n_words
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((i, score))
        out[item] = found
    return out


def plain_search(docs, items, k=10):
    rows = []
    for item, found in plain_scores(docs, items).items():
        order = sorted(((-s, docs[i][0] is None, docs[i][0] or 0) for i, s in found))[:k]
        rows += [(item, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(order, 1)]
    return sorted(rows, key=repr)


def found(spark, docs, items, k=10, parts=3, **settings):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    asked = spark.createDataFrame(items, "item_id string, text string")
    return sorted(map(tuple, R.search(R.index(frame), asked, k, **settings).collect()), key=repr)


def corpus(n, seed, words=400):
    """Words of falling frequency, groups of copies, and one word that is nearly everywhere."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    texts = []
    for i in range(n):
        if i % 3 == 2:
            texts.append(texts[rng.randrange(len(texts))])
        else:
            texts.append("The " + " ".join(f"w{j}" for j in rng.choices(range(words), weights, k=rng.randrange(1, 60))))
    return [(i, t) for i, t in enumerate(texts)]


def questions(n, seed, words=400):
    rng = random.Random(seed)
    return [(f"q{i}", "the " + " ".join(f"W{rng.randrange(words)}" for _ in range(rng.randrange(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("k, parts, block_terms", [(10, 1, 500_000), (10, 7, 40), (1, 3, 500_000), (400, 2, 500_000)])
def test_equals_scoring_every_document(spark, k, parts, block_terms):
    docs, items = corpus(500, 3), questions(40, 4)
    assert found(spark, docs, items, k, parts, block_terms=block_terms) == plain_search(docs, items, k)


def test_large_group_of_copies_is_ranked_by_id(spark):
    docs = [(1000 - i, "alpha beta gamma") for i in range(300)] + [(2000 + i, f"alpha delta{i}") for i in range(300)]
    items = [("a", "alpha beta"), ("b", "beta"), ("c", "delta7 alpha"), ("d", "nowhere"), ("e", None), ("f", " .,")]
    rows = found(spark, docs, items)
    assert rows == plain_search(docs, items)
    assert sorted(r[2] for r in rows if r[0] == "b") == list(range(701, 711)) and len(rows) == 21  # alpha, being in all documents, weighs 0


def test_fewer_accumulators_than_documents(spark):
    """Rare terms decide; the documents that only share the common word are never scored."""
    docs = [(i, f"common rare{i % 50} rare{i % 49}") for i in range(2000)]
    segments = R.index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))
    batch = segments.toArrow().combine_chunks().to_batches()[0]
    n_docs, n_words = sum(batch.column("n_docs").to_pylist()), sum(batch.column("n_words").to_pylist())
    rows = [{"terms": ["common", "rare1", "rare2"]}]
    asked = R._questions(rows, segments, R.Corpus(n_docs, n_words))
    asked.weights[asked.weights == 0] = 1  # so that the common word counts
    segment = R._Segment(batch, 0, asked, R.Corpus(n_docs, n_words))
    kept, scores = segment.best(asked.codes, asked.weights, 10, 0)
    assert 10 <= len(kept) < 200 and not segment.sums.any()
    exact = np.zeros(len(segment.ids), np.int64)
    for code in asked.codes:
        part = slice(segment.first[segment.local[code]], segment.first[segment.local[code] + 1])
        exact[segment.rows[part]] += asked.weights[code] * segment.share[part]
    assert (scores == exact[kept]).all() and set(np.argsort(-exact, kind="stable")[:10]) <= set(kept)


def test_odd_documents(spark, odd_documents, empty_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    items = [("x", "one wort3 wort5"), ("x", "漢字 TEXT"), (None, "c d line"), ("y", "x" * 5000), ("z", "")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    rows = sorted(map(tuple, R.search(R.index(odd_documents), asked).collect()), key=repr)
    assert rows == plain_search(docs, items)
    assert R.search(R.index(empty_documents), asked).count() == 0
    assert R.search(R.index(odd_documents), asked.limit(0)).count() == 0
    assert R.search(R.index(odd_documents.selectExpr("doc_id", "cast(null as string) as text")), asked).count() == 0


def test_best_keeps_ties_by_id():
    best = R._Best(1, 2)
    best.add(0, pa.array([7, None, 9]), np.array([5, 5, 5]))
    best.add(0, pa.array([3]), np.array([5]))
    assert best.least[0] == 5
    assert [b.to_pydict() for b in best.batch()] == [{"item": [0, 0], "doc_id": [3, 7], "score": [5, 5]}]


def test_index_is_written_and_read_a_few_segments_at_a_time(spark, monkeypatch):
    """Some 150 segments of 128 KB from one task: neither a row group nor a batch for Python nor one of the Parquet reader holds them all."""
    monkeypatch.setattr(R, "SEGMENT_BYTES", 128 << 10)
    docs = spark.range(0, 6400, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 500), j -> hex(id * 500 + j))) as text")
    segments = R.index(docs)
    assert segments.count() > 120
    groups = []
    for file in segments.inputFiles():
        found = pq.ParquetFile(file.removeprefix("file://")).metadata
        groups += [sum(found.row_group(i).column(c).total_compressed_size for c in range(found.num_columns)) for i in range(found.num_row_groups)]
    assert max(groups) < 6 << 20

    batches, reader, search_block = [], [], R._search_block

    def watched(segments, *rest):
        def sizes(parts):
            for part in parts:
                yield pa.RecordBatch.from_arrays([pa.array([part.nbytes], pa.int64())], names=["n"])

        batches.extend(r["n"] for r in segments.mapInArrow(sizes, "n bigint").collect())
        reader.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
        return search_block(segments, *rest)

    monkeypatch.setattr(R, "_search_block", watched)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    rows = R.search(segments, spark.createDataFrame([("a", f"{500 * 77 + 1:x} nowhere")], "item_id string, text string")).collect()
    assert [(r["item"], r["rank"], r["doc_id"]) for r in rows] == [("a", 1, 77)]
    assert len(batches) > 4 and max(batches) < 4 << 20 and reader == [1]
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before


def test_items_need_no_python_rows(spark, monkeypatch):
    """The items are named from the table they came from; rows made by the driver would start a second set of Python workers."""
    docs, items = corpus(60, 5), questions(6, 6)
    segments = R.index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    asked = spark.createDataFrame(items, "item_id string, text string")
    made, create = [], SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **b: made.append(len(data)) or create(self, data, *a, **b))
    rows = sorted(map(tuple, R.search(segments, asked, block_terms=20).collect()), key=repr)
    assert rows == plain_search(docs, items) and not any(made)


def test_numbers_of_every_width(spark):
    """Row numbers, counts and lengths beyond one and two bytes, negative and NULL ids."""
    docs = [(-(i + 1) if i % 7 else None, "a") for i in range(70_000)] + [(5, "b " * 70_000 + "c" * 300), (-9, "c" * 300 + " b"), (None, "c" * 300)]
    items = [("x", "b"), ("y", "C" * 300), ("z", "a b")]
    assert found(spark, docs, items, k=4, parts=1) == plain_search(docs, items, 4)
