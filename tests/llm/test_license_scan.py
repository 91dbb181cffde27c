import random
import re

import numpy as np
import pyarrow as pa

from lorewell.llm import license_scan as L
from lorewell.llm.queries import QUERIES
from lorewell.llm.words import text_column


def word_list(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    ws, places, base = word_list(text), [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, score, matches = set(base), float(bool(places)), []
    for n, line in enumerate((text or "").split("\n")):
        here = set(word_list(line))
        hits = []
        for t, (_, words) in enumerate(templates):
            wanted = set(words.split())
            if len(wanted & here) >= threshold * len(wanted) - 1e-9:
                hits.append(t)
                matches.append((n, t, len(wanted & here) / len(wanted)))
        sets = [set(w.split()) for _, w in templates]
        labels |= {templates[t][0] for t in hits if not any(sets[t] < sets[o] for o in hits)}
    score = max([score, *[m[2] for m in matches]])
    ends = (min(places), max(places)) if places else (None, None)
    return len(ws), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, matches


def texts():
    rng = random.Random(8)
    notices = [w for _, w in L.TEMPLATES] + ["MIT License", "the Apache\nLicense", "GNU General Public-License!", "Licensed under CC BY-NC 4.0."]
    out = [None, "", "mit license mit license", "MIT\nlicense", "mit é license"]
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(0, 5)):
            ws = rng.choice(notices).split(" ")
            if rng.random() < 0.6:
                ws = [w for w in ws if rng.random() < 0.88] + rng.choices(["the", "of", "x", "ñandú"], k=rng.randint(0, 4))
                rng.shuffle(ws)
            lines.append(rng.choice([" ", ", ", "-"]).join(ws).title())
        out.append("\n".join(lines))
    return out


def as_rows(columns, n):
    plain = [c.to_pylist() if isinstance(c, pa.Array) else [x.item() if hasattr(x, "item") else x for x in c] for c in columns]
    return [(*[c[i] for c in plain[:7]], list(zip(*[c[i] for c in plain[7:]]))) for i in range(n)]


def test_equals_brute_force_in_any_order_of_frequency():
    for seed in range(4):
        library = L.Library(list(L.TEMPLATES), L.THRESHOLD)
        library.counts = np.random.default_rng(seed).integers(0, 5, len(library.vocabulary))
        found = as_rows(L.scan_texts(library, text_column(pa.array(texts(), pa.string()))), len(texts()))
        for text, row in zip(texts(), found):
            assert row == brute(text), text


def test_documents(spark, odd_documents, empty_documents):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = L.scan(docs, keep=["doc_id"]).collect()
    assert {r["row"]["doc_id"]: tuple(r)[1:8] for r in found} == {i: brute(t)[:7] for i, t in rows}
    library = L.Library(list(L.TEMPLATES), L.THRESHOLD)
    counts = L.frequencies(docs, library)
    every = [w for _, t in rows for w in word_list(t)]
    assert counts.tolist() == [every.count(w) for w in library.vocabulary]
    assert L.scan(odd_documents).count() == odd_documents.count()
    assert L.scan(empty_documents).collect() == []


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided that",
    "isc": "Permission to use, copy, modify, and/or distribute this\n * software for any purpose with or without fee\n * is hereby granted, provided",
    "gpl": "This program is free software: you can redistribute\nit and/or modify it under the terms of\nthe GNU General Public\nLicense as published",
    "lgpl": "Licensed under the GNU Lesser General\nPublic License",
    "cc0": "To the extent possible under law, the author\nhas waived all copyright and related\nrights to this work.",
    "mpl": "This Source Code Form is subject to the terms\nof the Mozilla Public License",
}


def test_wrapped_notices_get_their_labels_in_the_query(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choices(["the", "and", "some", "other", "code", "files", "here"], k=n))
    rows = []
    for label, notice in WRAPPED.items():
        rows += [(f"{label} {n}", f"{prose(n)}\n{notice} {prose(30)}") for n in (0, 3, 17, 50)]
    rows.append(("scattered", " ".join(f"{word} {prose(40)}" for word in ("licensed", "under", "cc", "by", "4", "0"))))
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    for doc_id, _ in rows[:-1]:
        label = doc_id.split()[0]
        on_one_line = brute(" ".join(word_list(WRAPPED[label])))
        assert label in on_one_line[5].split(",") and found[doc_id][0] == on_one_line[5] and found[doc_id][1] >= on_one_line[6]
    assert found["scattered"] == ("", 0.0)


def test_every_run_of_a_template_is_in_a_window():
    """No run of a notice's length with enough of its words is missed, at any place and across line breaks."""
    rng = random.Random(6)
    library = L.Library(list(L.TEMPLATES), L.THRESHOLD)
    library.counts = np.arange(len(library.vocabulary))
    made = [re.sub(" ", lambda _: rng.choice([" ", "\n"]), t or "") for t in texts()]
    found = as_rows(L.scan_texts(library, text_column(pa.array(made, pa.string())), windows=True), len(made))
    n_runs = 0
    for text, row in zip(made, found):
        ws = word_list(text)
        matched = {t for _, t, _ in row[-1]}
        for t, (_, notice) in enumerate(L.TEMPLATES):
            wanted, n = set(notice.split()), len(notice.split())
            if any(len(wanted & set(ws[i : i + n])) >= L.THRESHOLD * len(wanted) - 1e-9 for i in range(len(ws))):
                assert t in matched, (text, notice)
                n_runs += 1
        for at, t, share in row[-1]:
            wanted = set(L.TEMPLATES[t][1].split())
            wide = next(n for n, own, _ in library.families if t in own)
            block = ws[at : at + 2 * wide] if at else ws[: 2 * wide]
            assert len(wanted & set(block)) / len(wanted) >= share >= L.THRESHOLD - 1e-9
    assert n_runs > 300
