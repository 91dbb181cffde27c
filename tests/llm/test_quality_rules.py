import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from lorewell.llm import quality_rules as Q
from lorewell.llm.words import text_column


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = set()
    for i, g in enumerate(zip(ws, ws[1:], ws[2:])):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)),
        len(covered), len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text)),
    ]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab A\n\t#é\x0b漢", max_size=40), max_size=6))
def test_measures_equal_brute_force(texts):
    found = Q.measure(text_column(pa.array(texts, pa.string())))
    assert [[int(c[i]) for c in found] for i in range(len(texts))] == [brute(t) for t in texts]


def test_ledger_on_odd_rows(odd_documents, empty_documents):
    rows = Q.ledger(odd_documents, "text", ["doc_id", "text"]).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert [r[n] for n in Q.NAMES] == brute(r["row"]["text"])
        assert bool(r["failed"] & Q.BIT["few_words"]) == (r["n_words"] < 50)
    assert Q.ledger(empty_documents).count() == 0
    kept = Q.keep_good(odd_documents, "base")
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == []


def test_policies_and_ablation(spark):
    good = " ".join(f"wort{i}" for i in range(60))
    rows = [(1, good), (2, "short"), (3, good + " #" * 40), (4, "a b c " * 30), (5, good + " ## $$")]
    ledger = Q.ledger(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", ["doc_id"])
    kept = {r[0] for r in ledger.filter(Q.verdict("v1")).select("row.doc_id").collect()}
    assert kept == {1, 5}
    found = {(r["policy"], r["rule"]): r for r in Q.ablation(ledger).collect()}
    assert found["base", "few_words"]["n_docs"] == 5 and found["base", "few_words"]["n_kept"] == 3
    assert found["base", "few_words"]["n_kept_without"] == 4
    assert found["v1", "symbols"]["n_kept"] == 2 and found["v1", "symbols"]["n_kept_without"] == 3
    masks = [r["failed"] for r in ledger.collect()]
    for (policy, rule), r in found.items():
        mask = Q.POLICIES[policy]
        assert r["n_failed"] == sum(m & Q.BIT[rule] != 0 for m in masks)
        assert r["n_kept_without"] == sum(m & mask & ~Q.BIT[rule] == 0 for m in masks)
