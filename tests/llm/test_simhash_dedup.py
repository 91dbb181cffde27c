import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import simhash_dedup as S
from lorewell.llm.words import text_column


def brute_print(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(ws[i : i + k]) for i in range(max(len(ws) - k + 1, 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(codes, limit=4):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = sorted(root)
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab C\n\té漢", max_size=30), max_size=6))
def test_fingerprints_equal_brute_force(texts):
    found = S.fingerprint_values(text_column(pa.array(texts, pa.string())))
    assert [int(x) for x in found] == [brute_print(t) for t in texts]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def planted(seed, n=300):
    """Random codes, chains of near codes, and a dense ball around one code."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for code in rng.sample(sorted(out), 20):
        for _ in range(5):
            for bit in rng.sample(range(64), rng.choice((1, 2, 3, 4, 5, 6))):
                code ^= 1 << bit
            out.add(code)
    centre = rng.getrandbits(64)
    for _ in range(n):
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 5, 7)))))
    return sorted(out | {0, 2**64 - 1, 2**63})


@pytest.mark.parametrize("block", [2048, 40])
def test_components_equal_brute_force(spark, block):
    codes = planted(block)
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp bigint").repartition(5)
    found = S.components(S.edges(df, 4, block))
    joined = {r["node"] % 2**64: r["root"] % 2**64 for r in found.collect()}
    groups, wanted = {}, {}
    for c in codes:
        groups.setdefault(joined.get(c, c), set()).add(c)
    for c, r in brute_classes(codes).items():
        wanted.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_links_prune_and_find_all():
    rng = np.random.default_rng(5)
    groups = [rng.integers(0, 2**63, 200, dtype=np.uint64) & np.uint64(0xFFFF), rng.integers(0, 2**63, 3, dtype=np.uint64)]
    codes, count = np.concatenate(groups), np.array([200, 3])
    found = {(int(i), int(j)) for a, b in S.links(codes, count, 4) for i, j in zip(a, b)}
    wanted = {
        (i, j) for lo, hi in ((0, 200), (200, 203)) for i in range(lo, hi) for j in range(i + 1, hi)
        if (int(codes[i]) ^ int(codes[j])).bit_count() <= 4
    }
    assert found == wanted


def test_documents(spark, odd_documents, empty_documents):
    rows = S.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = {(r["doc_id"], r["text"]) for r in odd_documents.collect()}
    assert {(r["doc_id"], r["fp"] % 2**64) for r in rows} == {(i, brute_print(t)) for i, t in texts}
    classes = brute_classes({brute_print(t) for _, t in texts})
    smallest = {}
    for i, t in texts:
        root = classes[brute_print(t)]
        smallest[root] = min(smallest.get(root, 10**9), 10**9 if i is None else i)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, smallest[classes[brute_print(t)]]) for i, t in texts}
    assert S.near_duplicates(empty_documents).collect() == []
