"""Names for SQL users: slugify(title), strip_code_fence(text) and the table function split_structured."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorewell.functions.splitting import split_text
from lorewell.functions.text import BLANK_CLASS, BLANKS, WORD_CLASS


@F.udtf(returnType="position int, content string")
class SplitStructured:
    """SELECT ... FROM docs, LATERAL split_structured(text, 1000, 200)"""

    def eval(self, text: str, size: int, overlap: int):
        if text is not None:
            for position, content in enumerate(split_text(text, size, overlap)):
                yield position, content


def _literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


def register(spark: SparkSession) -> None:
    """Add the three names to the session. The scalar ones are SQL functions, inlined by the optimizer."""
    blanks = _literal(BLANKS)
    kept = f"regexp_replace(trim(BOTH {blanks} FROM lower(title)), r'[^{WORD_CLASS}{BLANK_CLASS}-]', '')"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION slugify(title STRING) RETURNS STRING
        RETURN substring(regexp_replace({kept}, r'[{BLANK_CLASS}_-]+', '_'), 1, 60)"""
    )
    strip = lambda expr: f"trim(BOTH {blanks} FROM {expr})"
    body = strip("reply")
    opened = (
        f"CASE WHEN startswith({body}, '```json') THEN substring({body}, 8) "
        f"WHEN startswith({body}, '```') THEN substring({body}, 4) ELSE {body} END"
    )
    closed = strip(f"CASE WHEN endswith({opened}, '```') THEN left({opened}, length({opened}) - 3) ELSE {opened} END")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION strip_code_fence(reply STRING) RETURNS STRING RETURN {closed}"
    )
    spark.udtf.register("split_structured", SplitStructured)
