import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest

from lorewell.llm import mixing
from lorewell.llm.mixing import Settings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, most):
    """Targets of sources in order, in fractions: the most exceeding ones are capped until none is above."""
    weight = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    total, capped = Fraction(sum(sizes)), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        free = sum(w for i, w in enumerate(weight) if i not in capped)
        target = [Fraction(most * s) if i in capped else rest * weight[i] / free for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if target[i] > most * sizes[i]}
        if not above:
            return target
        capped |= above


def plain_slots(sizes, targets, s):
    """[(source, shard, k, block)] by the rule of the docstring, one slot after the other."""
    n = [ceil(x / s.block) for x in sizes]
    expected = [float(t) * b / x if x else 0.0 for t, b, x in zip(targets, n, sizes)]
    total = round(sum(expected))
    shards = max(1, -(-total // s.shard))
    fixed = [floor(e / shards) for e in expected]
    part = [floor((e / shards - f) * mixing.FRACTION) for e, f in zip(expected, fixed)]
    drawn = total - shards * sum(fixed)
    offset = int(mixing.scramble(np.array([s.seed], np.uint64))[0] >> np.uint64(11)) / 2**53
    points, out, before = [(x + offset) * sum(part) / max(drawn, 1) for x in range(drawn)], [], 0
    one = lambda i, m, key: int(mixing.permute(np.array([i]), np.array([m]), np.array([key], np.uint64))[0])
    for no in range(len(sizes)):
        mine = [x for x, at in enumerate(points) if before <= at < before + part[no]]
        before += part[no]
        dealt = [k // fixed[no] for k in range(fixed[no] * shards)] + [one(x, drawn, s.seed) % shards for x in mine]
        for k, shard in enumerate(dealt):
            if k < s.most * n[no]:
                key = mixing.scramble(mixing.scramble(np.array([no + s.seed], np.uint64)) + np.uint64(k // n[no]))[0]
                out.append((no, shard, k, one(k % n[no], n[no], key)))
    return out


def plain_mix(rows, s):
    """{row: words taken} and Counter of (shard, source, k, text); rows are (key, source, text)."""
    names = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    streams, owner = defaultdict(list), defaultdict(list)
    for i, (key, source, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0)):
        words = WORD.findall(text or "")
        streams[source] += words
        owner[source] += [i] * len(words)
    sizes = [len(streams[x]) for x in names]
    targets = plain_targets(sizes, s.weights, s.most)
    taken, texts = Counter(), Counter()
    for no, shard, k, block in plain_slots(sizes, targets, s):
        cut = slice(block * s.block, (block + 1) * s.block)
        taken.update(owner[names[no]][cut])
        texts[shard, names[no], k, " ".join(streams[names[no]][cut])] += 1
    return names, sizes, targets, taken, texts


def sample(n, sources):
    return [(i, sources[i * i % len(sources)], " ".join(f"w{i}.{j}" for j in range(i * 37 % 91))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(n):
    seen = set()
    for key in (1, 2, 2**63 + 5):
        found = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(found) == list(range(n))
        seen.add(tuple(found))
    assert n < 7 or len(seen) == 3


@pytest.mark.parametrize("settings", [Settings(), Settings(block=16, shard=64), Settings(weights=(1, 50), most=2, block=5, shard=40, seed=9)])
def test_equals_plain_packing_and_drawing(spark, settings):
    rows = sample(160, ["b", "a", None, "c", "é", ""])
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    names, sizes, targets, taken, texts = plain_mix(rows, settings)
    found = {r["key"]: r for r in mixing.taken(docs, settings).collect()}
    assert len(found) == len(rows)
    for i, (_, source, text) in enumerate(rows):
        no = names.index(source)
        assert (found[i]["size"], found[i]["source_size"], found[i]["taken"]) == (len(WORD.findall(text)), sizes[no], taken[i])
        assert found[i]["target"] == pytest.approx(float(targets[no]), rel=1e-12)
    mixed = mixing.mix(docs, settings).collect()
    assert Counter((r["shard"], r["source"], r["k"], r["text"]) for r in mixed) == texts


def test_shares_and_limits(spark):
    settings = Settings(block=8, shard=128)
    rows = sample(400, ["big"] * 7 + ["tiny"]) + [(1000 + i, "empty", None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = mixing.taken(docs, settings).toPandas().merge(docs.select("doc_id", "source").toPandas(), left_on="key", right_on="doc_id")
    assert (found["taken"] <= settings.most * found["size"]).all()
    for _, group in found.groupby("source"):
        target = group["target"].iloc[0]
        assert target <= settings.most * group["source_size"].iloc[0]
        assert abs(group["taken"].sum() - target) <= 4 * settings.block
    again = mixing.taken(docs.repartition(7), settings).toPandas()
    assert dict(zip(again["key"], again["taken"])) == dict(zip(found["key"], found["taken"]))


def test_shards_are_full_and_drawn_apart(spark):
    settings = Settings(block=2, shard=50)
    docs = spark.createDataFrame(sample(300, ["a", "b", "c", "d", "e"]), "doc_id bigint, source string, text string")
    sources = mixing.shares(mixing.measured(docs), settings)
    sizes, counts = Counter(), defaultdict(Counter)
    for r in mixing.slots(sources, settings).collect():
        sizes[r["shard"]] += 1
        counts[r["no"]][r["shard"]] += 1
    assert len(sizes) > 50 and max(sizes.values()) - min(sizes.values()) <= 1 and max(sizes.values()) <= settings.shard
    assert any(len(set(c.values())) > 1 for c in counts.values())


def test_odd_documents(spark, odd_documents, empty_documents):
    found = mixing.taken(odd_documents).collect()
    assert len(found) == odd_documents.count()
    assert all(r["source_size"] == r["target"] for r in found)  # one source
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert sum(r["taken"] for r in found) == pytest.approx(found[0]["target"], abs=64)
    assert mixing.taken(empty_documents).count() == 0 and mixing.mix(empty_documents).count() == 0
    blank = odd_documents.selectExpr("doc_id", "source", "cast(null as string) as text")
    assert {tuple(r)[1:] for r in mixing.taken(blank).collect()} == {(0, 0, 0.0, 0)}
