"""Paragraph text of HTML pages with the standard-library parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without an end tag, and elements whose text is not page text.
VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
SILENT = {"script", "style", "template", "rt", "rp"}


class _Paragraphs(HTMLParser):
    """Collects, for each <p> in document order, its text runs with blanks stripped from each run.

    An end tag closes everything opened since its start tag; a stray end tag is ignored; an unclosed <p>
    therefore also holds the paragraphs after it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list | None]] = []
        self.paragraphs: list[list[str]] = []
        self.run: list[str] = []

    def _flush(self):
        text = "".join(self.run).strip()
        self.run = []
        if text and not (self.open and self.open[-1][0] in SILENT):
            for _, parts in self.open:
                if parts is not None:
                    parts.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in VOID:
            return
        parts = None
        if tag == "p":
            parts = []
            self.paragraphs.append(parts)
        self.open.append((tag, parts))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self) -> str:
        self._flush()
        joined = ("".join(parts) for parts in self.paragraphs)
        return " ".join(t for t in joined if t)


def paragraph_text(html: str) -> str:
    parser = _Paragraphs()
    parser.feed(html)
    parser.close()
    return parser.text()


def paragraphs(html: Column, limit: int | None = None) -> Column:
    """Text of the <p> elements joined by one blank, '' if there is none; the first `limit` characters."""

    def read_batch(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: "" if page is None else paragraph_text(page)[:limit])

    return F.pandas_udf(read_batch, "string")(html)
