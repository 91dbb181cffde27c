"""Byte-level BPE encoding and decoding in numpy, many words at a time.

Texts are cut in units (a word with the blank before it, or white space) by their bytes; distinct units of a slice
are split into pieces by the tokenizer's pattern, and distinct pieces are merged together: their symbols lie in one flat
array, pairs find their rank by binary search over the sorted pair keys, each round merges every word's lowest-rank pair
and looks up the pairs beside it, and words without a mergeable pair leave the array. In long words each round merges every
pair that no lower rank can reach. Results go back to the units by gathering.

The vocabulary file is read once on the driver and broadcast; its size is bounded by the vocabulary. Ids are those of the
public library for the same file without special tokens added; a special token's string within a text is its id.

Edge cases: NULL and empty texts have no ids and decode to the empty text. Undecodable byte sequences of arbitrary ids
become U+FFFD. Repeated rows and NULL ids are rows like any other; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import words
from lorewell.llm.common import per_text

# Fixed value: the pattern by which byte-level BPE files of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII: texts with it are cut by the pattern itself.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NONE = np.int32(2**31 - 1)
#: An odd factor that spreads the keys of pairs.
HASH = np.int64(-7046029254386353131)
#: Bytes of a word beyond which many of its pairs merge in one round.
LONG = 400


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: printable Latin-1 bytes for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the lists `index` of a ragged array."""
    size = (offsets[1:] - offsets[:-1])[index]
    out = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(offsets[:-1][index] - out[:-1], size)
    at += np.arange(int(out[-1]))
    return out, values[at]


@dataclass
class Tokenizer:
    """The tables of one vocabulary."""

    token_bytes: list[bytes]
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    pair_result: np.ndarray
    byte_id: np.ndarray
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """Read a tokenizers JSON file of a byte-level BPE model."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], _byte_letters()
        assert model["type"] == "BPE" and data["pre_tokenizer"]["type"] == "ByteLevel" and not model["ignore_merges"]
        assert data["normalizer"] is None and not data["pre_tokenizer"]["add_prefix_space"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocabulary = model["vocab"]
        size = max([*vocabulary.values(), *special.values()]) + 1
        token_bytes = [b""] * size
        for token, i in vocabulary.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        result = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        born = np.full(size, -1)
        born[result] = np.arange(len(pairs))
        # a pair's parts are older than the pair, so merging one rank at a time never misses a lower one
        assert (np.maximum(born[left], born[right]) < np.arange(len(pairs))).all()
        keys = left * size + right
        order = np.argsort(keys)
        byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            byte_id[b] = vocabulary[letter]
        return cls(token_bytes, keys[order], order.astype(np.int32), result[order], byte_id, special)

    @cached_property
    def _decoding(self) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.token_bytes])))
        return offsets, np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _ranks(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places `at`; NONE where the pair is no merge or spans two words."""
        key = symbol[at].astype(np.int64) * len(self.token_bytes) + symbol[at + 1]
        slots, keys, ranks = self._slots
        place = ((key * HASH).view(np.uint64) >> slots).view(np.int64)
        found = keys[place]
        rank = np.where(found == key, ranks[place], NONE)
        asked = np.arange(len(key))
        while True:  # where another pair is, the next slot is looked at
            on = np.flatnonzero((found != key) & (found >= 0))
            if not len(on):
                break
            asked, key, place = asked[on], key[on], (place[on] + 1) & (len(keys) - 1)
            found = keys[place]
            rank[asked] = np.where(found == key, ranks[place], NONE)
        rank[word[at] != word[at + 1]] = NONE
        return rank

    @cached_property
    def _slots(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """(shift, keys, ranks): the pairs by a hash of their key, in the first free slot from there on; free ones have key -1."""
        bits = max(int(4 * len(self.pair_keys)).bit_length(), 4)
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        left, place = np.arange(len(self.pair_keys)), (self.pair_keys * HASH).view(np.uint64) >> np.uint64(64 - bits)
        while len(left):
            free = keys[place] < 0
            taken, first = np.unique(place[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            keys[taken], ranks[taken] = self.pair_keys[left[chosen]], self.pair_rank[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, place = left[rest], (place[rest] + np.uint64(1)) & np.uint64(len(keys) - 1)
        return np.uint64(64 - bits), keys, ranks

    def _merged(self, symbol, word, rank, at):
        """The arrays after merging the pairs at the (ascending, disjoint) places `at`; only the pairs beside them get new ranks."""
        symbol = symbol.copy()
        symbol[at] = self.result_of_rank[rank[at]]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, word = symbol[keep], word[keep]
        keep[at + 1], keep[at] = True, False  # the pair that began at the merged symbol's right part begins at its left now
        rank = rank[keep]
        changed = at - np.arange(len(at))
        changed = np.concatenate((changed, changed[changed > 0] - 1))
        inside = changed[changed < len(symbol) - 1]
        rank[inside] = self._ranks(symbol, word, inside)
        return symbol, word, rank

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of byte strings given as one flat array."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        symbol, word = self.byte_id[data], np.repeat(np.arange(n), sizes)
        is_long = np.repeat(sizes > LONG, sizes)
        done = [self._merge_long(data[is_long], symbol[is_long], word[is_long])]
        symbol, word = symbol[~is_long], word[~is_long]
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self._ranks(symbol, word, np.arange(max(len(symbol) - 1, 0)))
        while len(symbol):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(symbol))))
            ended = lowest == NONE
            if ended.any():
                done.append((symbol[ended], word[ended]))
                going = ~ended
                symbol, word, rank, lowest = symbol[going], word[going], rank[going], lowest[going]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == lowest)
            # in a run of overlapping equal pairs every other one merges, from the left
            new = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            symbol, word, rank = self._merged(symbol, word, rank, at[(np.arange(len(at)) - run) % 2 == 0])
        symbol, word = (np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(n + 1)), symbol[order]

    def _merge_long(self, data: np.ndarray, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, words) of long words, many merges of a word in each round.

        A pair may merge once no pair within `width` symbols has a lower rank, if every token made by lower ranks has at most `width`
        bytes: another token with one of its two symbols would begin with a pair in that reach. Ranks are taken in bands,
        from those that make short tokens on, so that most rounds look at few neighbours.
        """
        if not len(symbol):
            return symbol, word
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self._ranks(symbol, word, np.arange(len(symbol) - 1))
        offsets, letters = self._decoding
        strange = np.concatenate(([0], np.cumsum(~np.isin(letters, data))))
        able = strange[offsets[1:]] == strange[offsets[:-1]]  # tokens of bytes that occur here
        reach = np.maximum.accumulate(np.where(able, np.diff(offsets), 0)[self.result_of_rank])
        width = 2
        while width < 2 * max(int(reach[-1]), 2):
            limit = np.searchsorted(reach, width, "right")
            while True:
                within = np.where(rank < limit, rank, NONE)
                low = np.concatenate((np.full(width, NONE), within, np.full(width, NONE)))
                span = 1
                while span <= width:  # the least of each place and the `width` after it
                    step = min(span, width + 1 - span)
                    low = np.minimum(low[:-step], low[step:])
                    span += step
                low = np.minimum(low[: len(within)], low[width:])
                at = np.flatnonzero((within == low) & (within != NONE))
                if not len(at):
                    break
                # as above, but a run of equal pairs must be seen from its beginning
                new = np.concatenate(([True], np.diff(at) != 1))
                run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                first = at[run]
                whole = (first == 0) | (rank[first - 1] != rank[first]) | (word[first - 1] != word[first])
                symbol, word, rank = self._merged(symbol, word, rank, at[whole & ((np.arange(len(at)) - run) % 2 == 0)])
            width *= 2
        return symbol, word

    @cached_property
    def result_of_rank(self) -> np.ndarray:
        out = np.zeros(len(self.pair_rank), np.int32)
        out[self.pair_rank] = self.pair_result
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a large string array without NULLs."""
        data, offsets = words.text_bytes(texts)
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        starts = self._units(texts, data, offsets)
        codes, distinct = words.dictionary(data, np.append(starts, len(data)))
        unit_offsets, unit_ids = self._unit_ids(distinct)
        out, ids = gather(unit_offsets, unit_ids, codes)
        return out[np.searchsorted(starts, offsets)], ids

    def _units(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units begin; a unit never spans two pieces of the pattern's split in a way that changes them."""
        edge = np.zeros(len(data) + 1, bool)  # a text, or a part of one beside a special token, begins
        edge[offsets] = True
        whole = data.tobytes()
        for token in self.special:
            mark = token.encode()
            at = whole.find(mark)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(mark) - 1, "right"):
                    edge[[at, at + len(mark)]] = True
                at = whole.find(mark, at + 1)
        word = words.NON_SPACE[data]
        before = np.concatenate(([False], word[:-1]))
        blank = np.concatenate(([False], data[:-1] == 32))
        first = edge[:-1]
        begins = word & (first | ~before)
        joins = begins & ~first & blank  # the blank before belongs to the word
        mark = first | (begins & ~joins) | (~word & (first | before))
        mark[np.flatnonzero(joins) - 1] = True
        lone = begins & ~first & ~blank  # other white space before a word stands by itself
        mark[np.flatnonzero(lone) - 1] = True
        odd = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            a, b = int(offsets[i]), int(offsets[i + 1])
            inner = [a, *(a + np.flatnonzero(edge[a + 1 : b]) + 1).tolist(), b]
            mark[a:b] = False
            for x, y in zip(inner, inner[1:]):
                at = x
                for piece in self._pieces(whole[x:y].decode()):
                    mark[at] = True
                    at += len(piece.encode())
        return np.flatnonzero(mark)

    def _pieces(self, unit: str) -> list[str]:
        return [unit] if unit in self.special else self._pattern.findall(unit)

    @cached_property
    def _pattern(self):
        return regex.compile(PATTERN)

    @cached_property
    def _kinds(self) -> np.ndarray:
        """0 white space or apostrophe, 1 letter, 2 number, 3 other, of each code point of one or two bytes."""
        kinds = np.full(0x800, 3, np.uint8)
        for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (0, r"[\s']")):
            kinds[[ord(c) for c in regex.findall(pattern, "".join(map(chr, range(0x800))))]] = kind
        return kinds

    def _split(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(plain, number of pieces of each plain unit, offsets of their pieces, the pieces' bytes). Plain units are those of code points of
        one or two bytes, without apostrophes or white space but for one blank before them: their pieces are runs of a kind, the first with the blank."""
        data, offsets = words.text_bytes(units)
        kind = self._kinds[data & 0x7F]
        lead = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
        kind[lead] = kind[lead + 1] = self._kinds[((data[lead] & 0x1F).astype(np.int32) << 6) | (data[lead + 1] & 0x3F)]
        sizes = np.diff(offsets)
        first = offsets[:-1][sizes > 1]
        first = first[(data[first] == 32)]
        kind[first] = kind[first + 1]
        bad = np.concatenate(([0], np.cumsum((kind == 0) | (data >= 0xE0))))
        plain = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0)
        plain &= ~pc.is_in(units, value_set=pa.array([t.encode() for t in self.special], units.type)).to_numpy(zero_copy_only=False)
        mark = np.ones(len(data) + 1, bool)
        mark[1:-1] = kind[1:] != kind[:-1]
        mark[offsets] = True
        held = np.repeat(plain, sizes)
        starts = np.flatnonzero(mark[:-1] & held)
        count = np.searchsorted(starts, offsets)
        kept = np.concatenate(([0], np.cumsum(held)))
        return plain, np.diff(count)[plain], np.append(kept[starts], kept[-1]), data[held]

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of units given as large binary."""
        plain, count, piece_offsets, data = self._split(units)
        pieces: list[bytes] = []
        others = []
        for unit in units.filter(pa.array(~plain)).to_pylist():
            found = self._pieces(unit.decode())
            others.append(len(found))
            pieces += [x.encode() for x in found]
        buffers = [None, pa.py_buffer(np.ascontiguousarray(piece_offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        all_pieces = pa.Array.from_buffers(pa.large_binary(), len(piece_offsets) - 1, buffers)
        if pieces:
            all_pieces = pa.concat_arrays([all_pieces, pa.array(pieces, pa.large_binary())])
        encoded = all_pieces.dictionary_encode()
        codes, distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
        data, offsets = words.text_bytes(distinct)
        piece_offsets, piece_ids = self.merge(data, offsets)
        for token, number in self.special.items():
            at = pc.index(distinct, pa.scalar(token.encode(), pa.large_binary())).as_py()
            if at >= 0:  # its own bytes were merged like any other's
                rest = piece_offsets[at + 1] - piece_offsets[at]
                piece_ids = np.concatenate(
                    (piece_ids[: piece_offsets[at]], [np.int32(number)], piece_ids[piece_offsets[at + 1] :])
                ).astype(np.int32)
                piece_offsets = piece_offsets.copy()
                piece_offsets[at + 1 :] -= rest - 1
        out, ids = gather(piece_offsets, piece_ids, codes)
        at = out[np.concatenate(([0], np.cumsum(np.concatenate((count, np.array(others, np.int64))))))]
        if not others:
            return at, ids
        order = np.empty(len(units), np.int64)  # the plain units came first
        order[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(units))
        return gather(at, ids, order)

    def decode_bytes(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of the texts that lists of ids stand for."""
        out, data = gather(*self._decoding, ids)
        return out[offsets], data


def _decoded(offsets: np.ndarray, data: np.ndarray) -> list[str]:
    whole = data.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns `keep`) as struct `row`, with their `ids`."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer.load(path))

    def step(texts: pa.Array) -> list:
        offsets, ids = shared.value.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return per_text(docs, text, step, "ids array<int>", keep)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows as struct `row`, with the text that the list `ids` stands for; a NULL list is an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Tokenizer.load(path))
    packed = rows.select(F.struct("*").alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    schema = T.StructType([packed.schema["row"], T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            texts = _decoded(*shared.value.decode_bytes(offsets.astype(np.int64), flat))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", out])

    return packed.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents as struct `row`, encoded and decoded again: number of ids and digests of both results.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer.load(path))

    def step(texts: pa.Array) -> list:
        tokenizer = shared.value
        offsets, ids = tokenizer.encode(texts)
        flat = memoryview(ids.astype("<u4").tobytes())
        id_hashes = [hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        text_hashes = [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(*tokenizer.decode_bytes(offsets, ids))]
        return [np.diff(offsets), id_hashes, text_hashes]

    return per_text(docs, text, step, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep)
