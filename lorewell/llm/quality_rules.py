"""Quality rules as a ledger of bitmasks.

Every text is measured once and every rule evaluated once on the measurements; the ledger keeps the measurements
and one bit per failed rule. A policy is a version name and a mask of rules: its verdict is a bitwise `and`. Ablations
(how many documents each rule alone rejects) need only the number of documents per bitmask.

Edge cases: a NULL or empty text has no words and fails `few_words`; a NULL id and repeated rows are rows like any
other; an empty table gives an empty ledger; extra columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm import words
from lorewell.llm.common import per_text

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, " \
    "n_repeat_words bigint, n_letters bigint, n_capitals bigint"
NAMES = [part.split()[0] for part in MEASURES.split(", ")]

#: (rule, SQL condition of failure over the measurements); the position is the bit. Append only: bits are stored.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "10 * n_capitals > 7 * n_letters"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask_of(*rules: str) -> int:
    return sum(BIT[r] for r in rules)


#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of("few_words", "repeated_windows", "symbols", "capitals", "short_words"),
    "all": mask_of(*BIT),
}
PRODUCTION = "v1"

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BYTE = np.arange(256)
_CAPITAL = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _CAPITAL | ((_BYTE >= 97) & (_BYTE <= 122))


def _count_bytes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(member[data])
    return np.diff(np.searchsorted(at, offsets))


def _duplicate_lines(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line of the text) by text."""
    lines = words.split(_as_texts(w), member=np.arange(256) != 10)
    with_word = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    text, code = lines.text[with_word], lines.codes[with_word]
    again = words.repeats(text, code) > 0
    size = len(w.first) - 1
    return np.bincount(text, minlength=size), np.bincount(text[again], minlength=size)


def _as_texts(w: words.Words) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_string(), len(w.offsets) - 1, [None, pa.py_buffer(w.offsets), pa.py_buffer(w.data)]
    )


def _repeated_words(w: words.Words) -> np.ndarray:
    """Words, by text, that lie in a window of three words found twice or more in the text."""
    at = words.windows(w.first, 3)
    covered = np.zeros(len(w.starts) + 1, bool)
    if len(at):
        wide = w.codes.astype(np.int64)
        size = np.int64(len(w.distinct))
        pair = wide[at] * size + wide[at + 1]  # a slice has far fewer than 2**31 distinct words
        _, pair = np.unique(pair, return_inverse=True)
        window = pair.astype(np.int64) * size + wide[at + 2]
        text = w.text[at]
        order = np.lexsort((window, text))
        same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            covered[at[twice] + i] = True
    return words.per_text(w.first, covered[:-1])


def measure(texts: pa.Array) -> list:
    """The measurements of a slice of texts."""
    w = words.split(texts)
    n_lines, n_dup = _duplicate_lines(w)
    points = np.concatenate(([0], np.cumsum(words.POINT_START[w.data] & w.mask)))
    return [
        np.diff(w.first), points[w.offsets[1:]] - points[w.offsets[:-1]], _count_bytes(w.data, w.offsets, _SYMBOL),
        n_lines, n_dup, _repeated_words(w), _count_bytes(w.data, w.offsets, _LETTER),
        _count_bytes(w.data, w.offsets, _CAPITAL),
    ]


def failures() -> Column:
    """The bitmask of failed rules over the measurement columns."""
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0) for name, condition in RULES]
    out = F.lit(0)
    for bit in bits:
        out = out.bitwiseOR(bit)
    return out.cast("bigint")


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: its columns (or those of `keep`) as struct `row`, the measurements, and `failed`."""
    return per_text(docs, text, measure, MEASURES, keep).withColumn("failed", failures())


def verdict(policy: str, failed: str = "failed") -> Column:
    """Whether the policy keeps the row."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents, kept, failing the rule, and kept once the rule is left out.

    Only the bitmasks are grouped, so that at most 2**rules rows are shuffled per task.
    """
    asked = [
        (version, mask, name, BIT[name])
        for version, mask in (policies or POLICIES).items()
        for name in BIT
        if mask & BIT[name]
    ]
    entries = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).alias("mask"), F.lit(r).alias("rule"),
                                 F.lit(b).alias("bit")) for v, m, r, b in asked])
    per_mask = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    asked_rows = per_mask.select("failed", "n", F.explode(entries).alias("a")).select("failed", "n", "a.*")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return asked_rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit == 0).alias("n_kept"),
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    return ledger(docs, text).filter(verdict(policy)).select("row.*")
