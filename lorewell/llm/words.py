"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A text is cut at bytes, never at code points: all separators used here are ASCII and UTF-8 keeps ASCII bytes out
of longer characters. NULL texts count as empty. Work goes in slices of a few megabytes of text (one text may be
longer than a slice and is then a slice of its own), so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words are runs of anything but white space.
NON_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Words are runs of ASCII digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: First bytes of a code point.
POINT_START = (_BYTES & 0xC0) != 0x80


def text_column(column: pa.Array) -> pa.Array:
    """The column as a plain string array without NULLs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large string array; offsets[i] to offsets[i + 1] is text i."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive parts of the batch with about `limit` bytes of text each, and their texts."""
    texts = text_column(batch.column(text))
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end


@dataclass
class Words:
    """The words of a slice of texts, in order.

    `starts` and `ends` are byte positions in `data`; `first[i]` to `first[i + 1]` are the words of text i.
    """

    data: np.ndarray
    offsets: np.ndarray
    mask: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @cached_property
    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each word, the distinct words by code)."""
        return dictionary(self.data[self.mask], np.concatenate(([0], np.cumsum(self.ends - self.starts))))

    @property
    def codes(self) -> np.ndarray:
        return self.encoded[0]

    @property
    def distinct(self) -> pa.Array:
        return self.encoded[1]

    @cached_property
    def text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def dictionary(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of the byte strings between consecutive offsets."""
    array = pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(values))],
    )
    encoded = array.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def split(texts: pa.Array, member: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """The words of each text: runs of bytes for which `member` holds."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    mask = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never goes on in the next text
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return Words(data, offsets, mask, starts, ends, np.searchsorted(starts, offsets))


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (one per word) by text; `first` as in Words."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def repeats(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each element, its number of equal (group, code) elements before it (0: the first), stable in order."""
    order = np.lexsort((code, group))
    g, c = group[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - begin
    return out


def windows(first: np.ndarray, n: int) -> np.ndarray:
    """The words at which a window of n words of one text begins."""
    count = int(first[-1])
    inside = np.zeros(count, bool)
    if count >= n:
        inside[: count - n + 1] = True
    for text_end in (first[1:],):
        for back in range(1, n):
            at = text_end - back
            inside[at[at >= 0]] = False
    return np.flatnonzero(inside)
