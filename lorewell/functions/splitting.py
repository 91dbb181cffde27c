"""Heading-first recursive text splitting, row by row inside Arrow batches."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column

from lorewell.functions.rows import by_row

# Where a text may be cut, strongest boundary first. A piece keeps its boundary at the front.
BOUNDARIES = [
    r"\n#{1,6} ",
    r"```\n",
    r"\n\*\*\*+\n",
    r"\n---+\n",
    r"\n___+\n",
    r"\n\n",
    r"\n",
    r" ",
]
_PATTERNS = [re.compile(p) for p in BOUNDARIES]


def _pieces(text: str, level: int) -> list[str]:
    starts = [m.start() for m in _PATTERNS[level].finditer(text)]
    edges = [0, *starts, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if a < b]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Fill windows of at most `size` code points; whole trailing pieces of up to `overlap` are repeated."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def _cut(text: str, size: int, overlap: int) -> Iterator[str]:
    """Windows of `size` code points over a text without boundaries, each repeating the last `overlap`."""
    overlap = min(overlap, size - 1)
    for start in range(0, max(len(text) - overlap, 1), size - overlap):
        yield text[start : start + size]


def _split(text: str, level: int, size: int, overlap: int) -> Iterator[str]:
    while level < len(_PATTERNS) and not _PATTERNS[level].search(text):
        level += 1
    if level == len(_PATTERNS):
        yield from _cut(text, size, overlap) if text else ()
        return
    fitting: list[str] = []
    for piece in _pieces(text, level):
        if len(piece) < size:
            fitting.append(piece)
            continue
        yield from _pack(fitting, size, overlap)
        fitting = []
        yield from _split(piece, level + 1, size, overlap)
    yield from _pack(fitting, size, overlap)


def split_text(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Chunks of at most `size` code points, blank ends removed, blank chunks dropped."""
    if overlap > size:
        raise ValueError("overlap must not exceed size")
    return [c for c in (part.strip() for part in _split(text, 0, size, overlap)) if c]


def split_structured(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """ARRAY<STRING> of chunks; NULL text gives NULL."""

    return by_row(lambda t: None if t is None else split_text(t, size, overlap), "array<string>", text)
