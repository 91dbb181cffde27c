"""Tables of fetched pages and of web search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions.html import paragraphs
from lorewell.functions.text import leading
from lorewell.operators.skew import lookup, top_per_key


def page_paragraphs(pages: DataFrame, html: str = "html", limit: int | None = None) -> DataFrame:
    """Pages (url, html) with `text`, the text of their paragraphs; `limit` shortens it."""
    return pages.withColumn("text", paragraphs(F.col(html), limit)).drop(html)


def assemble_results(
    results: DataFrame, page_texts: DataFrame, questions: DataFrame | None = None, snippet_chars: int | None = None
) -> DataFrame:
    """(query_id, answer): the first four results of each question as one text.

    `results`: query_id, position, title, link, snippet. `page_texts`: url, text, one row per url. The first
    two results show their page's text when there is one, the others their snippet. With `questions`, those
    without any result get the fixed text. `snippet_chars` shortens the snippets.
    """
    few = top_per_key(
        results, ["query_id"], [F.col("position"), F.col("link"), F.col("title")], K.WEB_RESULTS, "nth"
    )
    paged = lookup(few.withColumn("url", F.col("link")), page_texts.select("url", "text"), ["url"])
    has_page = (F.col("nth") <= K.WEB_FULL_PAGES) & (F.length("text") > 0) & (F.col("link") != "#")
    content = F.when(
        has_page, F.concat(F.lit(K.WEB_PAGE_LABEL), "text", F.lit("..."))
    ).otherwise(
        F.concat(
            F.lit(K.WEB_SNIPPET_LABEL), leading(F.coalesce("snippet", F.lit("")), snippet_chars), F.lit("...")
        )
    )
    item = F.concat(
        F.lit("- Título: "), F.coalesce("title", F.lit("Sin título")),
        F.lit("\n  URL: "), F.coalesce("link", F.lit("#")), F.lit("\n  Contenido: "), content,
    )
    items = F.array_sort(F.collect_list(F.struct("nth", "item")))
    answers = (
        paged.withColumn("item", item)
        .groupBy("query_id")
        .agg(F.concat(F.lit(K.WEB_HEADER), F.array_join(F.transform(items, lambda i: i["item"]), "\n\n")).alias("answer"))
    )
    if questions is None:
        return answers
    return questions.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(K.WEB_NOTHING)).alias("answer")
    )
