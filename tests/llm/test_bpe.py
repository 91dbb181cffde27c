import hashlib
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from lorewell.llm import bpe
from lorewell.llm.words import text_column

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.Tokenizer.load(PATH), Library.from_file(PATH)


def check(texts):
    offsets, ids = OURS.encode(text_column(pa.array(texts, pa.string())))
    decoded = bpe._decoded(*OURS.decode_bytes(offsets, ids))
    for i, t in enumerate(texts):
        mine = ids[offsets[i] : offsets[i + 1]].tolist()
        wanted = THEIRS.encode(t or "", add_special_tokens=False).ids
        assert mine == wanted, (t, mine, wanted)
        assert decoded[i] == THEIRS.decode(wanted, skip_special_tokens=False)


LETTERS = st.text(alphabet="aeT'sll \n\t\r  　é漢🙂1²٣!?._<|>\x00\x1c\x85", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=5))
def test_equals_the_library(texts):
    check(texts)


def test_special_strings_and_long_words():
    mark = "<|endoftext|>"
    check([mark, f"a {mark} b", f" {mark}{mark}\n", "<|endof", "text|>", f"x  {mark}   y", f"it's{mark}'s", None, ""])
    check(["a" * 5001, "ab" * 3000, "é" * 1000, " " * 3000 + "x", "\n" * 999, "1" * 2000 + "!" * 2000, "the " * 4000])


def test_plain_words_are_split_without_the_pattern(monkeypatch):
    plain = [" ", " dass,", " über!!", " 12ab3", "a", " x²٣", "(a)", " naïve_9"]
    check(plain)
    asked = []
    pieces = OURS._pieces
    monkeypatch.setattr(OURS, "_pieces", lambda unit: asked.append(unit) or pieces(unit))
    check(plain)
    assert set(asked) <= {" "}
    check(["it's a—b 漢字"])
    assert "it's" in asked


def test_slots_hold_every_pair():
    symbol = np.stack((OURS.pair_keys // len(OURS.token_bytes), OURS.pair_keys % len(OURS.token_bytes)), axis=1).ravel().astype(np.int32)
    word = np.zeros(len(symbol), np.int64)
    assert (OURS._ranks(symbol, word, np.arange(0, len(symbol), 2)) == OURS.pair_rank).all()
    at = np.arange(1, len(symbol) - 1, 2)
    known = dict(zip(OURS.pair_keys.tolist(), OURS.pair_rank.tolist()))
    keys = symbol[at].astype(np.int64) * len(OURS.token_bytes) + symbol[at + 1]
    assert OURS._ranks(symbol, word, at).tolist() == [known.get(k, bpe.NONE) for k in keys.tolist()]
    word[1::2] = 1
    assert (OURS._ranks(symbol, word, np.arange(0, len(symbol), 2)) == bpe.NONE).all()


def test_long_pieces_merge_many_pairs_a_round(monkeypatch):
    rng = np.random.default_rng(5)
    alphabets = ["ab", "aaab", "etaoin", "abcdefghij", "aB\u00e9\u6f22", "-=", "the"]
    monkeypatch.setattr(bpe, "LONG", 3)  # so that nearly every piece takes that way
    for k in range(120):
        check(["".join(rng.choice(list(alphabets[(k + i) % len(alphabets)]), rng.integers(1, 80))) for i in range(20)])
    monkeypatch.undo()
    check(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzXYZ"), n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 30_000)] + ["q" * 70_001])


def test_a_megabyte_without_blanks():
    text = "".join(np.random.default_rng(6).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1_000_000))
    begin = time.process_time()
    check([text])
    assert time.process_time() - begin < 20


def test_every_code_point():
    for low in range(0, 0x30000, 0x800):
        points = [chr(c) for c in range(low, low + 0x800) if not 0xD800 <= c < 0xE000]
        if points:
            check([f"a{c}b {c}{c} 1" for c in points])


def test_arbitrary_ids_decode_like_the_library():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50257, 3000).astype(np.int32)
    offsets = np.concatenate((np.arange(0, 3000, 7), [3000]))
    for i, text in enumerate(bpe._decoded(*OURS.decode_bytes(offsets, ids))):
        assert text == THEIRS.decode(ids[offsets[i] : offsets[i + 1]].tolist(), skip_special_tokens=False)


def test_documents(spark, odd_documents, empty_documents):
    rows = bpe.digests(odd_documents, PATH, "text", ["doc_id", "text"]).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        text = r["row"]["text"] or ""
        ids = THEIRS.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(empty_documents, PATH).collect() == []
    encoded = bpe.encode(odd_documents, PATH, keep=["doc_id", "text"]).select("row.*", "ids")
    back = bpe.decode(encoded, PATH).select("row.text", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


def test_files_of_another_kind_are_refused():
    with pytest.raises(AssertionError):
        bpe.Tokenizer.load(public_tokenizers.path("word_bpe_49k.json"))
