"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A template is a set of words. A block is a line of a text or, with `windows` (as the query has it), a window of its words,
independent of line breaks: wrapped notices match, words scattered over a long line do not. Windows are twice as long as the
template (or the longest of templates that are parts of each other) and overlap by half, so every run of words of the
template's length lies in one. A block matches a template if it holds at least `THRESHOLD` of the template's words. The join is exact and uses the filters of set-similarity joins:

* tokens are ordered by their frequency in the whole corpus (first pass), rarest first;
* prefix: with o = ceil(threshold * size), a match must hold one of the template's first size - o + 1 tokens;
* length: a block with fewer than o words of the templates' vocabulary cannot match;
* positions: after a first common token at places i and j only min(size - i, length - j) more can be common.

Only words of the templates' vocabulary can count towards containment, so blocks are reduced to them. Templates are a
bounded library (`MOST_TOKENS`) and are broadcast; the token counts of their vocabulary are the only thing collected.

Words are runs of ASCII letters and digits and of anything beyond ASCII, lower-cased (A-Z). Edge cases: NULL and empty
texts have no words, no labels and score 0; repeated rows and NULL ids are rows like any other; other columns are
not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import words
from lorewell.llm.bpe import gather
from lorewell.llm.common import per_text

THRESHOLD = 0.8
MOST_TOKENS = 1_000_000

# The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: (label, words of a notice as licenses ask for it, lower case without punctuation).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def base_phrase_words() -> list[list[str]]:
    return [p.split() for p, _ in PHRASES]


@dataclass
class Library:
    """Templates over a vocabulary, ordered by corpus frequency once `counts` is known."""

    templates: list[tuple[str, str]]
    threshold: float
    counts: np.ndarray | None = None

    @cached_property
    def vocabulary(self) -> list[str]:
        listed = [w for _, t in self.templates for w in t.split()] + [w for p in base_phrase_words() for w in p]
        assert len(listed) <= MOST_TOKENS, "more templates than one broadcast may hold"
        return sorted(set(listed))

    @cached_property
    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.vocabulary)}

    @cached_property
    def rank(self) -> np.ndarray:
        """Place of each word in the order of frequency, rarest first; ties by the word."""
        out = np.empty(len(self.vocabulary), np.int64)
        out[np.lexsort((np.arange(len(out)), self.counts))] = np.arange(len(out))
        return out

    @cached_property
    def sets(self) -> list[np.ndarray]:
        """The ranks of each template's words, in order."""
        return [np.unique(self.rank[[self.place[w] for w in t.split()]]) for _, t in self.templates]

    @cached_property
    def needed(self) -> np.ndarray:
        """Words a block must share with each template."""
        return np.array([math.ceil(self.threshold * len(s) - 1e-9) for s in self.sets])

    @cached_property
    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By rank the templates whose prefix holds it: (offsets, template, place in the template)."""
        entries = sorted(
            (int(r), t, i) for t, s in enumerate(self.sets) for i, r in enumerate(s[: len(s) - self.needed[t] + 1])
        )
        ranks, templates, places = (np.array(x, np.int64) for x in zip(*entries)) if entries else [np.zeros(0, np.int64)] * 3
        return np.searchsorted(ranks, np.arange(len(self.vocabulary) + 1)), templates, places

    @cached_property
    def member(self) -> np.ndarray:
        out = np.zeros((len(self.sets), len(self.vocabulary)), bool)
        for t, s in enumerate(self.sets):
            out[t, s] = True
        return out

    @cached_property
    def within(self) -> np.ndarray:
        """within[a, b]: template a's words are a proper part of template b's."""
        sets = [set(s.tolist()) for s in self.sets]
        return np.array([[a < b for b in sets] for a in sets])

    @cached_property
    def families(self) -> list[tuple[int, np.ndarray, Library]]:
        """(most words, templates, library of them with the same counts) of templates whose windows are alike.

        Templates that are parts of each other are together, and so are those of the same length.
        """
        length = np.array([len(t.split()) for _, t in self.templates])
        while True:
            joined = [max(length[o] for o in range(len(length)) if o == t or self.within[t, o] or self.within[o, t]) for t in range(len(length))]
            if (length == joined).all():
                break
            length = np.array(joined)
        out = []
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            part = Library([self.templates[t] for t in own], self.threshold)
            part.counts = self.counts[[self.place[w] for w in part.vocabulary]]
            out.append((n, own, part))
        return out

    def word_ids(self, w: words.Words) -> np.ndarray:
        listed = pa.array([v.encode() for v in self.vocabulary], pa.large_binary())
        known = pc.fill_null(pc.index_in(w.distinct, value_set=listed), -1).to_numpy(zero_copy_only=False)
        return known.astype(np.int64)[w.codes] if len(known) else np.zeros(0, np.int64)

    def join(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, containment) of all matches, given (block, rank) pairs sorted and without repeats."""
        blocks, begin, length = np.unique(block, return_index=True, return_counts=True)
        offsets, templates, places = self.prefixes
        n = (offsets[1:] - offsets[:-1])[rank]
        entry = np.repeat(offsets[:-1][rank] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        token = np.repeat(np.arange(len(rank)), n)  # the pair whose rank is in the template's prefix
        b, t = np.repeat(np.repeat(np.arange(len(blocks)), length), n), templates[entry]
        # of several common prefix tokens the first one counts
        _, first = np.unique(b * len(self.sets) + t, return_index=True)
        b, t, i, j = b[first], t[first], places[entry][first], (token - begin[np.repeat(np.arange(len(blocks)), length)[token]])[first]
        size = np.array([len(s) for s in self.sets])[t]
        fits = (length[b] >= self.needed[t]) & (np.minimum(size - i, length[b] - j) >= self.needed[t])
        b, t, size = b[fits], t[fits], size[fits]
        at, ranks = gather(np.append(begin, len(rank)), rank, b)
        common = np.concatenate(([0], np.cumsum(self.member[np.repeat(t, np.diff(at)), ranks])))
        overlap = common[at[1:]] - common[at[:-1]]
        hit = overlap >= self.needed[t]
        return blocks[b[hit]], t[hit], overlap[hit] / size[hit]


def _lines(w: words.Words) -> np.ndarray:
    """A number for the line of each word, growing over the texts of the slice."""
    breaks = np.flatnonzero(w.data == 10)
    edges = np.sort(np.concatenate((breaks, w.offsets[:-1])))
    return np.searchsorted(edges, w.starts, "right")


def _phrases(library: Library, w: words.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of all places of base phrases."""
    starts, which = [], []
    for k, phrase in enumerate(base_phrase_words()):
        at = words.windows(w.first, len(phrase))
        for i, word in enumerate(phrase):
            at = at[ids[at + i] == library.place[word]]
        starts.append(at)
        which.append(np.full(len(at), k))
    return np.concatenate(starts), np.concatenate(which)


def _told(library: Library, block: np.ndarray, template: np.ndarray, reach: int) -> np.ndarray:
    """Which matches say something of their own: a notice that is part of a longer one matching here does not."""
    by_block: dict[int, set[int]] = {}
    for b, t in zip(block.tolist(), template.tolist()):
        by_block.setdefault(b, set()).add(t)
    near = lambda b: (o for x in range(b - reach, b + reach + 1) for o in by_block.get(x, ()))
    return np.array([not any(library.within[t, o] for o in near(b)) for b, t in zip(block.tolist(), template.tolist())], bool)


def _by_line(library: Library, w: words.Words, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, line, template, containment, whether it gives a label) of the lines that match."""
    known = ids >= 0
    line = _lines(w)
    size = len(library.vocabulary)
    pairs = np.unique(line[known] * size + library.rank[ids[known]])
    block, template, containment = library.join(pairs // size, pairs % size)
    text_of_line = np.zeros(int(line[-1]) + 1 if len(line) else 1, np.int64)
    text_of_line[line] = w.text
    text = text_of_line[block] if len(block) else np.zeros(0, np.int64)
    line_of = block - np.searchsorted(np.sort(np.concatenate((np.flatnonzero(w.data == 10), w.offsets[:-1]))),
                                      w.offsets[:-1][text], "right")
    return text, line_of, template, containment, _told(library, block, template, 0)


def _by_window(library: Library, w: words.Words, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word of the window, template, containment, whether it gives a label) of the windows that match."""
    out = [[np.zeros(0, kind)] for kind in (np.int64, np.int64, np.int64, float, bool)]
    for n, own, part in library.families:
        size = len(part.vocabulary)
        rank = np.full(len(library.vocabulary) + 1, -1)  # the last one is for unknown words, -1
        rank[[library.place[v] for v in part.vocabulary]] = part.rank
        rank = rank[ids]
        known = np.flatnonzero(rank >= 0)
        text = w.text[known]
        # each text's windows begin at word -n, 0, n, ...; numbers left out between texts keep them apart
        base = np.concatenate(([0], np.cumsum(np.diff(w.first) // n + 3)))
        window = base[text] + (known - w.first[text]) // n + 1
        pairs = np.unique(np.concatenate((window, window - 1)) * size + np.tile(rank[known], 2))
        block, template, containment = part.join(pairs // size, pairs % size)
        text = np.searchsorted(base, block, "right") - 1
        first = np.maximum(block - base[text] - 1, 0) * n
        found = text, first, own[template], containment, _told(part, block, template, 1)
        for columns, column in zip(out, found):
            columns.append(column)
    return tuple(np.concatenate(columns) for columns in out)


def scan_texts(library: Library, texts: pa.Array, windows: bool = False) -> list:
    """The columns of `scan` for a slice of texts."""
    w = words.split(texts, words.ALPHANUMERIC, lower=True)
    ids = library.word_ids(w)
    n = len(texts)
    starts, which = _phrases(library, w, ids)
    base_text = w.text[starts]
    n_base = np.bincount(base_text, minlength=n)
    first = np.full(n, np.iinfo(np.int64).max)
    last = np.full(n, -1)
    np.minimum.at(first, base_text, starts - w.first[base_text])
    np.maximum.at(last, base_text, starts - w.first[base_text])
    base_labels: list[set[str]] = [set() for _ in range(n)]
    for text, k in zip(base_text.tolist(), which.tolist()):
        base_labels[text].add(PHRASES[k][1])

    text, block, template, containment, told = (_by_window if windows else _by_line)(library, w, ids)
    score = (n_base > 0).astype(float)
    np.maximum.at(score, text, containment)
    labels = [set(s) for s in base_labels]
    for i, t in zip(text[told].tolist(), template[told].tolist()):
        labels[i].add(library.templates[t][0])
    order = np.lexsort((template, block, text))
    offsets = pa.array(np.searchsorted(text[order], np.arange(n + 1)), pa.int32())
    matches = [
        pa.ListArray.from_arrays(offsets, pa.array(a[order], kind))
        for a, kind in ((block, pa.int64()), (template, pa.int64()), (containment, pa.float64()))
    ]
    has = n_base > 0
    return [
        np.diff(w.first), n_base, pa.array(first, pa.int64(), mask=~has), pa.array(last, pa.int64(), mask=~has),
        [",".join(sorted(s)) for s in base_labels], [",".join(sorted(s)) for s in labels], score, *matches,
    ]


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "lines array<bigint>, templates array<bigint>, containments array<double>"
)


def frequencies(docs: DataFrame, library: Library, text: str = "text") -> np.ndarray:
    """How often each word of the templates' vocabulary occurs in all texts."""

    def count(texts: pa.Array) -> list:
        w = words.split(texts, words.ALPHANUMERIC, lower=True)
        ids = library.word_ids(w)
        found = np.bincount(ids[ids >= 0], minlength=len(library.vocabulary))
        empty = np.zeros(len(found), np.int64)
        return [[found] + [empty[:0]] * (len(texts) - 1)]  # a slice's counts travel with its first row

    counted = per_text(docs, text, count, "n array<bigint>", [])
    rows = counted.select(F.posexplode("n").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(library.vocabulary), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def scan(
    docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
    keep: list[str] | None = None, windows: bool = False,
) -> DataFrame:
    """The documents (or their columns `keep`) as struct `row`, with base phrases, labels, score and all matches.

    `lines`, `templates` and `containments` list every (line, template) that meets the threshold; with `windows` the blocks are
    windows, and `lines` has their first words.
    """
    library = Library(list(templates), threshold)
    library.counts = frequencies(docs, library, text)
    shared = docs.sparkSession.sparkContext.broadcast(library)
    return per_text(docs, text, lambda t: scan_texts(shared.value, t, windows), SCHEMA, keep)
