import random
import re

import numpy as np

from lorewell.llm import decontamination as D


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def word_list(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for width in (1, 5, 40):
        query, window = rng.integers(0, 4, (30, 12)), rng.integers(0, 4, (30, width))
        query[:, 9:] = -1
        window[::2, width // 2 :] = -2
        found = D.align(query, window)
        for q, w, s in zip(query, window, found):
            assert s == smith_waterman([x for x in q if x >= 0], [x if x >= 0 else object() for x in w])


def corpus():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("the", "of", "on", "an", "er", "ti", "re") for b in ("", "at", "he", "nd", "in", "ly", "st", "ou")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(12)] + [text(500), text(5), text(2)]
    docs, planted = [], set()
    for i in range(150):
        words = text(rng.randint(0, 200))
        kind = i % 5
        if kind in (1, 2, 3):
            k = rng.randrange(len(items) - 1)
            piece = list(items[k])
            if kind == 2:  # every eighth word replaced
                piece[3::8] = ["other"] * len(piece[3::8])
            if kind == 3:  # words left out and put in
                piece = [w for n, w in enumerate(piece) if n % 9 != 4]
                piece.insert(len(piece) // 2, "extra")
            if kind == 1 or len(piece) > 8:
                planted.add((i, k))
            at = rng.randint(0, len(words))
            words[at:at] = piece
        docs.append((i, " ".join(words).capitalize().replace(" the ", ", The\n")))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], planted


def test_finds_exact_and_edited_copies(spark):
    docs, items, planted = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contamination(df, bench).collect()}
    assert planted <= set(found), planted - set(found)
    for (d, k), score in found.items():
        a, b = word_list(items[k][1]), word_list(docs[d][1])
        if len(a) <= D.PASSAGE:
            full = smith_waterman(a, b) / (2 * len(a))
            assert D.THRESHOLD <= score <= full
            if (d, k) in planted:
                assert score == full
    brute = {
        (d, k) for d, t in docs for k, i in items[:12]
        if smith_waterman(word_list(i), word_list(t)) >= 2 * D.THRESHOLD * len(word_list(i))
    }
    assert brute == {p for p in found if p[1] < 12}
    several = {(r["doc_id"], r["item_id"]) for r in D.contamination(df, bench, block_words=200).collect()}
    assert several == set(found)
    kept = {r["doc_id"] for r in D.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_edited_passages_are_found_however_many_documents_hold_them(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    edited, half = ([rng.choice(vocabulary) for _ in range(40)] for _ in range(2))
    docs = []
    for i in range(400):
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for _ in range(2))
        if i < 200:  # every fifth word replaced
            piece = [f"x{i}" if n % 5 == 4 else word for n, word in enumerate(edited)]
        else:  # one half alone
            piece = half[:20]
        docs.append((i, " ".join([*before, *piece, *after])))
    items = [(1, " ".join(edited)), (2, " ".join(half))]
    plain = {}
    for d, t in docs:
        for k, i in items:
            score = smith_waterman(i.split(), t.split()) / (2 * len(i.split()))
            if score >= D.THRESHOLD:
                plain[d, k] = score
    assert len(plain) == 400
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contamination(df, bench).collect()}
    assert found == plain
    assert D.drop_contaminated(df, bench).count() == 0


def test_a_passage_of_many_items_is_collected_once(spark):
    rng = random.Random(5)
    one, other = (" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(30)) for _ in range(2))
    bench = spark.createDataFrame([(i, one if i % 30 else f"{other} {i}") for i in range(300)], "item_id bigint, text string")
    held = list(D.blocks(bench, "item_id", "text"))
    assert [len(block.first) - 1 for _, block in held] == [11] and held[0][0].count() == 300
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, "nothing of it"), (3, other)], "doc_id bigint, text string")
    wanted = {(1, i) for i in range(300) if i % 30} | {(3, i) for i in range(0, 300, 30)}
    for words in (D.BLOCK_WORDS, 150):  # also with more items than are broadcast
        assert {(r["doc_id"], r["item_id"]) for r in D.contamination(docs, bench, block_words=words).collect()} == wanted


def test_odd_rows(spark, odd_documents, empty_documents):
    bench = spark.createDataFrame(
        [(1, "wort5 wort6 wort7 wort8 wort9 wort10 wort11 wort12 wort13"), (2, None), (3, ""), (None, "ünï çødé 漢字 🙂 text"), (4, "one")],
        "item_id bigint, text string",
    )
    rows = sorted((tuple(r) for r in D.contamination(odd_documents, bench).collect()), key=repr)
    assert rows == [(10, 1, 1.0), (11, 1, 1.0), (5, None, 1.0)]
    assert D.contamination(empty_documents, bench).collect() == []
    assert D.contamination(odd_documents, bench.limit(0)).collect() == []
    kept = D.drop_contaminated(odd_documents, bench)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 3


def broken_copies(n, rng, parts, longest):
    """Texts with an item in `parts` pieces, up to `longest` other words between them, and some words replaced."""
    item = [f"q{rng.randrange(400)}" for _ in range(100)]
    cuts = [0, *sorted(rng.sample(range(10, 90), parts - 1)), 100]
    docs = []
    for i in range(n):
        words = [f"x{rng.randrange(900)}" for _ in range(rng.randrange(80))]
        for a, b in zip(cuts, cuts[1:]):
            words += [w if rng.random() > 0.04 else "other" for w in item[a:b]]
            words += [f"x{rng.randrange(900)}" for _ in range(rng.randrange(longest + 1))]
        docs.append((i, " ".join(words)))
    return " ".join(item), docs


def test_long_insertions_lose_nothing(spark):
    rng = random.Random(8)
    for n, parts, longest in ((1, 3, 40), (30, 2, 100), (400, 3, 45), (60, 4, 30)):
        item, docs = broken_copies(n, rng, parts, longest)
        number = {}
        ids = lambda words: np.array([[number.setdefault(w, len(number)) for w in words]])
        query = ids(word_list(item))
        full = {i: int(D.align(query, ids(word_list(t)))[0]) / 200 for i, t in docs}
        wanted = {i: s for i, s in full.items() if s >= D.THRESHOLD}
        found = D.contamination(
            spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
        )
        assert {r["doc_id"]: r["score"] for r in found.collect()} == wanted
        assert n < 30 or 0 < len(wanted)


def test_common_phrases_are_not_aligned(monkeypatch):
    """Alignments grow with the copies in a text, not with the items that share a phrase of common words with it."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(20_000)]
    phrase = ["one", "of", "the"]

    def text(n):
        return [w for _ in range(n) for w in (phrase if rng.random() < 0.01 else [rng.choice(vocabulary)])]

    items = [[*text(20), *phrase, *text(20)] for _ in range(4000)]
    doc = text(2000) + items[3] + text(2000)
    aligned, plain = [], D.align
    monkeypatch.setattr(D, "align", lambda q, w: aligned.append(len(q)) or plain(q, w))
    counts = []
    for n in (500, 4000):
        aligned.clear()
        block = D.Passages.build(list(range(n)), [" ".join(i) for i in items[:n]])
        found, scores = D.hits(block, D.words.text_column(D.pa.array([" ".join(doc)])), D.THRESHOLD)
        assert found.to_pylist() == [[3]] and scores.to_pylist() == [[1.0]]
        counts.append(sum(aligned))
    assert counts[1] < 2 * counts[0] + 20, counts
