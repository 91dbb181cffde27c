import hashlib
import random
import re

import numpy as np

from lorewell.llm import pii_spans as P
from lorewell.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def brute(text):
    """Base spans as the contract words them."""
    text, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 5 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0])):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(only(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def texts(n=1500):
    rng = random.Random(6)
    pieces = ["a@b.com", "x.y+z@mail5.example.com", "@", "a@", ".", "..", "10.0.0.1", "300.1.2.3", "1.2.3.4.5.6.7.8", "001.02.3.255", "4785380592391139",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+44 20 7946 0958", "+", "-", " ", "(", "12", "7", "é漢🙂",
              "call ", "card ", "123-45-6789", "(555) 123-4567", "DE89 3704 0044 0532 0130 00", "000000000000000000", "\n", "٣"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_base_spans_equal_the_patterns():
    for text in [*texts(), "1" * 5000, "@" * 3000, "a@b." * 500, "1 " * 4000, "a" * 200_000 + "@", "1." * 3000, "9" * 100_000]:
        found = P.candidates(text, "@" in text, bool(re.search("[0-9]", text)))
        base = sorted((P.RANK[k], a, b) for k, a, b in found if k in P.BASE_KINDS)
        if len(text) <= 20_000:
            assert base == sorted(brute(text)), text[:80]


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.8, 0.7, 0.55]
    ballots = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 for r in right], axis=1)
    pattern = ballots @ np.array([27, 9, 3, 1])
    shown, n = np.unique(pattern, return_counts=True)
    found, share = P.estimate(np.full(len(shown), 2), shown, n.astype(float))
    assert np.allclose([share[k, 1, 2] for k in range(4)], right, atol=0.06)
    assert np.allclose([share[k, 0, 0] for k in range(4)], right, atol=0.06)
    assert ((found[np.searchsorted(shown, pattern)] > 0.5) == truth).mean() > 0.93


def test_query(spark, odd_documents, empty_documents, tmp_path):
    wide = spark.createDataFrame([(i, t) for i, t in enumerate(texts(400))], "doc_id bigint, text string")
    for docs in (wide, odd_documents, empty_documents):
        folder = f"{tmp_path}/{docs.count()}"
        docs.write.parquet(f"{folder}/documents.parquet")
        rows = QUERIES["op3_pii_spans"](spark, folder).collect()
        assert len(rows) == docs.count()
        wanted = {}
        for r in docs.collect():
            base = sorted(brute(r["text"]))
            joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
            counts = [sum(s[0] == k for s in base) for k in range(4)]
            wanted.setdefault(r["doc_id"], set()).add((*counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
        for r in rows:
            mine = [w for w in wanted[r["doc_id"]] if tuple(r)[1:6] == w[:5]]
            assert mine
            assert any(r["spans"].startswith(w[5]) for w in mine)  # base spans stay; others follow by kind


def test_added_spans_are_the_credible_ones(spark):
    good = [f"please call ({a}) 123-45{b} now" for a in range(201, 260) for b in range(10, 14)]
    plain = [f"write to u{i}@site{i % 7}.org or call +1 ({200 + i}) 555-{1000 + i}" for i in range(300)]
    bad = [f"order number 77{i % 10} 4111-1111-1111-11{i:02d}" for i in range(10, 99)]
    docs = spark.createDataFrame(list(enumerate(good + plain + bad)), "doc_id bigint, text string")
    rows = P.spans(docs, keep=["doc_id"]).select("row.doc_id", P.spans_text(P.F.col("spans")).alias("s")).collect()
    found = {r["doc_id"]: r["s"] for r in rows}
    assert np.mean(["phone_like" in found[i] for i in range(len(good))]) > 0.95
    assert not any("card_like" in s for s in found.values())
