"""Text column functions. All stay inside the JVM; none needs Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's str.strip() treats as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class, and the letters/digits/underscore class.
BLANK_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CLASS = r"\p{L}\p{N}_"

LIST_ITEM = r"\n([ \t]*(?:[-*+]|[0-9]+[.)]))[ \t]"
SENTENCE_END = rf"([.!?])[{BLANK_CLASS}]+"
STRUCTURE_LINE = r"(\A|\n)(#{1,6} |[ \t]*([-*+]|[0-9]+[.)])[ \t]|[ \t]*\|)"


def strip(c: Column) -> Column:
    """Drop blanks at both ends only."""
    return F.trim(c, F.lit(BLANKS))


def leading(c: Column, chars: int | None) -> Column:
    """The first `chars` characters; the whole text if that is None."""
    return c if chars is None else F.substring(c, 1, chars)


def is_blank(c: Column) -> Column:
    """True for NULL, empty and all-blank text."""
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def clean_text(c: Column) -> Column:
    """NULL becomes empty; blanks are removed at the ends; inner layout is kept."""
    return strip(F.coalesce(c, F.lit("")))


def words(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD_CLASS}]+"), F.lit(0))


def slugify(title: Column, limit: int = 60) -> Column:
    """A file-name-safe form of a title."""
    kept = F.regexp_replace(strip(F.lower(title)), f"[^{WORD_CLASS}{BLANK_CLASS}-]", "")
    return F.substring(F.regexp_replace(kept, f"[{BLANK_CLASS}_-]+", "_"), 1, limit)


def strip_code_fence(c: Column) -> Column:
    """Remove one leading ```json or ``` and one trailing ```."""
    body = strip(c)
    opened = (
        F.when(F.startswith(body, F.lit("```json")), F.substring(body, 8, 2147483647))
        .when(F.startswith(body, F.lit("```")), F.substring(body, 4, 2147483647))
        .otherwise(body)
    )
    closed = F.when(
        F.endswith(opened, F.lit("```")), F.left(opened, F.length(opened) - 3)
    ).otherwise(opened)
    return strip(closed)


def fenced_block(c: Column) -> Column:
    """The text between the first fence pair, else the stripped text (reply parsing of the reranker)."""
    body = strip(c)
    after_json = F.split(body, "```json", -1)
    after_any = F.split(body, "```", -1)
    return (
        F.when(F.contains(body, F.lit("```json")), strip(F.split(after_json[1], "```", -1)[0]))
        .when(F.contains(body, F.lit("```")), strip(after_any[1]))
        .otherwise(body)
    )


def _broken(c: Column) -> Column:
    """One statement per line; line breaks and blanks inside a list are held as control characters.

    Texts that hold these characters themselves get them spelled out first; `_statements` takes that back.
    """
    spelled = c
    for mark, letter in (("\x03", "C"), ("\x01", "A"), ("\x02", "B")):
        spelled = F.replace(spelled, F.lit(mark), F.lit("\x03" + letter))
    plain = F.when(F.rlike(c, F.lit("[\x01-\x03]")), spelled).otherwise(c)
    held = F.regexp_replace(plain, LIST_ITEM, "\x01$1\x02")
    return F.regexp_replace(held, SENTENCE_END, "$1\n")


def _statements(lines: Column) -> Column:
    def restored(s: Column) -> Column:
        out = strip(F.translate(s, "\x01\x02", "\n "))
        again = out
        for mark, letter in (("\x01", "A"), ("\x02", "B"), ("\x03", "C")):
            again = F.replace(again, F.lit("\x03" + letter), F.lit(mark))
        return F.when(F.contains(out, F.lit("\x03")), again).otherwise(out)

    return F.filter(F.transform(lines, restored), lambda s: F.length(s) > 0)


def sentences(c: Column) -> Column:
    """Statements of one paragraph: split after `.!?` + blank and at newlines.

    Consecutive list items stay with the line that leads into them.
    """
    return _statements(F.split(_broken(c), "\n", -1))


def first_sentences(c: Column, n: int, chars: int = 512) -> Column:
    """The first `n` statements of a text, without taking the rest of it apart if its first `chars` characters hold them."""
    pieces = F.split(_broken(F.substring(c, 1, chars)), "\n", -1)
    # what the cut changes is the last piece, and whether it belongs to the one before it
    begun = _statements(F.slice(pieces, 1, F.greatest(F.size(pieces) - 2, F.lit(0))))
    return F.slice(F.when(F.size(begun) >= n, begun).otherwise(_statements(F.split(_broken(c), "\n", -1))), 1, n)


def propositions(c: Column) -> Column:
    """Statements of a whole text: blank-line paragraphs first, then sentences; blank paragraphs skipped."""
    paragraphs = F.filter(F.split(c, "\n\n", -1), lambda p: ~is_blank(p))
    return F.flatten(F.transform(paragraphs, sentences))


def has_structure(c: Column) -> Column:
    """True if any line is a heading, a list item or a table row."""
    return F.rlike(c, F.lit(STRUCTURE_LINE))


def contains_any(c: Column, needles: list[str]) -> Column:
    """True if the text holds at least one of the given strings."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def mentions_any(c: Column, terms: Column) -> Column:
    """True if any term of the array occurs in the text, ignoring case."""
    lowered = F.lower(c)
    return F.exists(terms, lambda t: F.contains(lowered, F.lower(t)))


def raw_extension(name: Column) -> Column:
    """Last extension with its dot, case kept; '' if none. Leading dots do not start an extension."""
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    return F.regexp_extract(base, r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


def file_extension(name: Column) -> Column:
    """Last extension with its dot, lower-cased."""
    return F.lower(raw_extension(name))


def metric_file_type(name: Column) -> Column:
    """Text after the last dot with its case kept, `unknown` when there is no dot."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("unknown")
