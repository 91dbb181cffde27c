import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorewell.llm import toxicity as T
from lorewell.llm.queries import QUERIES
from lorewell.llm.words import text_column


def test_features_are_words_pairs_and_skip_grams():
    texts = text_column(pa.array(["A b, a b c", "", "a b a b c", "c b a", "b"], pa.string()))
    offsets, found = T.distinct_features(texts)
    sets = [set(found[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    # words a b c; pairs ab ba bc; one word left out: aa bb ac
    assert len(sets[0]) == 9 and sets[0] == sets[2] and sets[1] == set()
    assert len(sets[3]) == 6 and len(sets[4]) == 1 and sets[4] < sets[0]


def plain_ftrl(docs, label, intercept):
    """One document at a time with dictionaries."""
    z, n, drift = {}, {}, 1.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= T.L1 else -(z[i] - np.sign(z[i]) * T.L1) / ((T.BETA + n[i] ** 0.5) / T.ALPHA + T.L2)
    for _ in range(T.EPOCHS):
        for features, y in zip(docs, label):
            w = {i: weight(i) for i in features}
            error = 1 / (1 + np.exp(-np.clip(sum(w.values()) + intercept, -30, 30))) - y
            for i in features:
                grown = n.get(i, 0.0) + error**2
                z[i] = z.get(i, 0.0) + error - (grown**0.5 - n.get(i, 0.0) ** 0.5) / T.ALPHA * w[i]
                n[i] = grown
            drift += error**2
            intercept -= T.ALPHA * error / (T.BETA + drift**0.5)
    return {i: weight(i) for i in z if abs(z[i]) > T.L1}, intercept


def test_training_equals_the_plain_recurrence(monkeypatch):
    monkeypatch.setattr(T, "BATCH", 1)
    monkeypatch.setattr(T, "L1", 0.5)
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    label = np.array([float(3 in d) for d in docs])
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    model = T.train(offsets, np.concatenate(docs), label, 8)
    prior = (label.sum() + 0.5) / (len(label) + 2)
    wanted, intercept = plain_ftrl([d.tolist() for d in docs], label, np.log(prior / (1 - prior)))
    assert np.isclose(model.intercept, intercept)
    assert set(model.index.tolist()) == set(wanted)
    assert np.allclose(model.weight, [wanted[i] for i in model.index.tolist()], atol=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = rows.join(labels, "doc_id").filter("held_out").select("score", "toxic", "predicted").toPandas()
    toxic, clean = judged[judged.toxic == 1], judged[judged.toxic == 0]
    above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
    assert above > 0.97
    assert (clean.predicted == 0).mean() > 0.99 and (toxic.predicted == 1).mean() > 0.75
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_wording_beyond_the_first_16_000_ids_is_learned(spark):
    order = spark.range(24_000).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r["doc_id"] for r in order.collect()]
    toxic = set(ids[16_000::80])
    rows = [(i, f"word{i % 50} word{i % 7}" + " wording" * (i in toxic), int(i in toxic)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    model = T.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    with_it, without = model.scores(text_column(pa.array(["word1 wording", "word1 word2"], pa.string())))
    assert with_it > 0.5 > without


def test_one_text_per_sampled_id(spark):
    rows = [(i, f"word{i % 9} word{i % 4}" + " nasty" * (i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    texts = [(i, t) for i, t, _ in rows]
    models = [
        T.fit(spark.createDataFrame(given, "doc_id bigint, text string").repartition(3), labels, F.lit(True))
        for given in (texts, texts + texts[:1] * 400 + [(1, "x" + texts[1][1]), (2, None)])
    ]
    assert len(models[0].index) and models[0].index.tolist() == models[1].index.tolist()
    assert models[0].weight.tolist() == models[1].weight.tolist() and models[0].intercept == models[1].intercept


def test_odd_rows(spark, odd_documents, empty_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (7, None), (10, 1)], "doc_id bigint, toxic int")
    model = T.fit(odd_documents, labels, F.lit(True))
    rows = T.score(odd_documents, model, keep=["doc_id"]).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    for docs, marks in ((odd_documents, labels.limit(0)), (empty_documents, labels)):
        model = T.fit(docs, marks, F.lit(True))
        assert len(model.index) == 0
        assert all(abs(r["score"] - 0.25) < 1e-9 for r in T.score(odd_documents, model, keep=[]).collect())
    assert T.score(empty_documents, model).collect() == []
