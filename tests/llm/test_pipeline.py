import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_decontamination import smith_waterman, word_list
from test_quality_rules import brute as measures
from test_simhash_dedup import brute_classes, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from lorewell.llm import decontamination, quality_rules, secret_scan

SF = "/root/testdata/sf0.001"


def keeps_quality(text):
    n, chars, symbols, _, _, repeated, letters, capitals = measures(text)
    return n >= 50 and 2 * repeated <= n and 10 * symbols <= n and 10 * capitals <= 7 * letters and chars >= 2 * n


def keep_one(rows):
    root = brute_classes({brute_print(t) for _, t in rows})
    best = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, brute_print(t := r[1]) - (2**64 if brute_print(t) >= 2**63 else 0), t)):
        best.setdefault(root[brute_print(t)], (i, t))
    return list(best.values())


def clean(text, items):
    here = word_list(text)
    counts = Counter(here)
    for item in items:
        least = decontamination.THRESHOLD if len(item) >= decontamination.SHORT else 1
        most = 2 * sum(min(n, counts[w]) for w, n in Counter(item).items())
        if most >= 2 * least * len(item) and smith_waterman(item, here) >= 2 * least * len(item):
            return False
    return True


def redacted(text):
    for rule in secret_scan.RULES:
        text = re.sub(rule.pattern, lambda m, r=rule: secret_scan.MARK if len(m[r.group]) >= r.least else m[0], text)
    return text


@pytest.fixture(scope="module")
def stages(spark):
    """The result of every stage on the small shared tables, in order."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_every_stage_equals_plain_code(spark, stages):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    rows = [(i, t) for i, t in pairs(documents) if keeps_quality(t)]
    assert pairs(stages[0]) == rows
    rows = sorted(keep_one(rows))
    assert pairs(stages[1]) == rows
    items = [word_list(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if clean(t, items)]
    assert pairs(stages[2]) == rows
    rows = [(i, redacted(t)) for i, t in rows]
    assert pairs(stages[3]) == rows
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        wanted.append((i, len(ids), digest, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in stages[4].collect()) == wanted
    for df in stages[:4]:
        assert df.columns == documents.columns
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == wanted


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_take_odd_and_empty_tables(spark, odd_documents, empty_documents, kind):
    docs = odd_documents if kind == "odd" else empty_documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count()
        if name != "bpe":
            assert out.columns == docs.columns


def test_repeated_rows_leave_one(spark, odd_documents):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    found = corpus_pipeline.near_duplicates(spark, odd_documents, SF).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in found) == Counter(keep_one(rows))


def test_policy_is_the_one_compared():
    assert quality_rules.POLICIES["v1"] == 0b101111
