"""Text preparation, profiling and chunking of documents.

Everything here is row-local: a document's text is read once, split inside its task and exploded, with no
shuffle between the file scan and the chunk rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.functions import dates as D
from lorewell.functions import text as T
from lorewell.functions.grouping import assign_groups, describe, term_counts
from lorewell.functions.rows import by_row
from lorewell.functions.splitting import split_text

# Words that speak for a document type, used when the caller brings no model and no list of their own.
LEXICON: dict[str, list[str]] = {
    "meeting_notes": ["meeting", "minutes", "agenda", "attendees", "reunión", "minuta", "asistentes", "acta"],
    "class_notes": ["lecture", "class", "lesson", "professor", "clase", "apunte", "profesor", "facultad"],
    "project_planning": ["roadmap", "milestone", "sprint", "backlog", "proyecto", "entrega", "planificación"],
    "technical_doc": ["architecture", "api", "deployment", "endpoint", "arquitectura", "servidor", "despliegue"],
    "research_paper": ["abstract", "hypothesis", "methodology", "references", "hipótesis", "metodología"],
    "tutorial_guide": ["tutorial", "guide", "step", "install", "guía", "paso", "instalar"],
    "brainstorming": ["idea", "ideas", "brainstorm", "concept", "borrador", "ocurrencia"],
    "troubleshooting": ["error", "bug", "crash", "fix", "exception", "fallo", "solución", "incidente"],
    "financial_legal": ["invoice", "contract", "payment", "tax", "factura", "contrato", "pago", "impuesto"],
}

DECODED = [".txt", ".md", ".json", ".csv"]


def extract_text(files: DataFrame, content: str = "content", name: str = "filename") -> DataFrame:
    """Add `text`: UTF-8 text files decoded (bad bytes replaced) and cleaned; other types stay NULL.

    HTML goes through `pages.page_paragraphs`; binary formats need a decoder of the caller's choice.
    """
    decoded = F.make_valid_utf8(F.col(content).cast("string"))
    return files.withColumn(
        "text", F.when(T.file_extension(F.col(name)).isin(DECODED), T.clean_text(decoded))
    )


def document_record(docs: DataFrame, as_of: Column, document_date: str = "document_date") -> DataFrame:
    """Add created_at, custom_date and document_date_str. A date that does not parse counts as absent."""
    parsed = D.leading_date(F.col(document_date))
    return (
        docs.withColumn("created_at", F.coalesce(parsed, as_of))
        .withColumn("custom_date", parsed.isNotNull())
        .withColumn("document_date_str", F.when(parsed.isNotNull(), F.substring(document_date, 1, 10)))
    )


def drop_null_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: v.isNotNull())


def lexicon_hits(lowered: Column, lexicon: dict[str, list[str]]) -> Column:
    """ARRAY<INT>: occurrences of each document type's words, in the order of the types."""
    word = f"[{T.WORD_CLASS}]"

    def count(listed: list[str] | None) -> Column:
        if not listed:
            return F.lit(0)
        # a first letter is cheaper to look for than the end of a word; only plain words have one
        first = f"(?=[{''.join(sorted({w[0] for w in listed}))}])" if all(w.isalnum() for w in listed) else ""
        return F.regexp_count(lowered, F.lit(f"{first}(?<!{word})(?:{'|'.join(sorted(listed))})(?!{word})"))

    return F.array(*[count(lexicon.get(t)) for t in K.DOC_TYPES])


def profile_documents(
    docs: DataFrame,
    text: str = "text",
    lexicon: dict[str, list[str]] = LEXICON,
    sample_chars: int | None = None,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add `profile` STRUCT<doc_type, global_summary, document_date, requires_agentic_chunking>.

    doc_type is the type with most lexicon hits (ties: list order; none: `general`); the summary is the
    first two statements, at most 300 characters. `sample_chars` looks at a leading sample only. `model`
    (text column to struct column, e.g. a pandas UDF) replaces these rules.
    """
    seen = F.col(text) if sample_chars is None else F.substring(text, 1, sample_chars)
    if model:
        return docs.withColumn("profile", model(seen))
    # one column per step: each is computed once however often the next one uses it
    staged = docs.withColumn("__hits", lexicon_hits(F.lower(seen), lexicon)).withColumn(
        "__best", F.array_max("__hits")
    )
    types = F.array(*[F.lit(t) for t in K.DOC_TYPES])
    doc_type = F.when(
        F.col("__best") > 0, F.element_at(types, F.array_position("__hits", F.col("__best")).cast("int"))
    ).otherwise("general")
    made = F.struct(
        doc_type.alias("doc_type"),
        F.substring(F.array_join(T.first_sentences(seen, 2), " "), 1, 300).alias("global_summary"),
        F.date_format(D.first_date_in(seen), "yyyy-MM-dd").alias("document_date"),
        (~T.has_structure(seen)).alias("requires_agentic_chunking"),
    )
    return staged.withColumn("profile", made).drop("__hits", "__best")


def route(text: Column, filename: Column, needs_semantic: Column) -> Column:
    """`structured` or `semantic`. Long texts are always structured; then the profile flag decides, if any."""
    looks_structured = (
        F.endswith(F.coalesce(filename, F.lit("")), F.lit(".pdf"))
        | F.endswith(F.coalesce(filename, F.lit("")), F.lit(".docx"))
        | F.startswith(text, F.lit("# "))
        | F.contains(text, F.lit("\n# "))
    )
    semantic = F.coalesce(needs_semantic, ~looks_structured)
    return F.when((F.length(text) <= K.STRUCTURED_OVER_CHARS) & semantic, "semantic").otherwise("structured")


def grouped_statements(statements: Column, numbers: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: the statements of each group number, in order."""
    pairs = F.arrays_zip(statements.alias("s"), numbers.alias("g"))
    count = F.coalesce(F.array_max(numbers), F.lit(-1)) + 1
    groups = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        groups, lambda g: F.transform(F.filter(pairs, lambda p: p["g"] == g), lambda p: p["s"])
    )


def semantic_chunks(groups: Column, descriptions: Column) -> Column:
    """ARRAY<STRUCT<content, chunk_type, title, summary>>: statements joined by one blank."""
    return F.zip_with(
        groups,
        descriptions,
        lambda g, x: F.struct(
            F.array_join(g, " ").alias("content"),
            F.lit("agentic").alias("chunk_type"),
            F.coalesce(x["title"], F.lit(K.DEFAULT_TITLE)).alias("title"),
            F.coalesce(x["summary"], F.lit(K.DEFAULT_SUMMARY)).alias("summary"),
        ),
    )


def drop_blank_chunks(chunks: Column) -> Column:
    """Keep the array's chunks whose content is not blank."""
    return F.filter(chunks, lambda c: ~T.is_blank(c["content"]))


def number_chunks(docs: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per non-blank chunk with a 0-based `chunk_index`. No window: the order is the array's."""
    kept = docs.withColumn(chunks, drop_blank_chunks(F.col(chunks)))
    others = [c for c in docs.columns if c != chunks]
    return kept.select(*others, F.posexplode(chunks).alias("chunk_index", "chunk")).select(
        *others, "chunk_index", "chunk.*"
    )


def prefix_context(content: Column, doc_type: Column, summary: Column) -> Column:
    """Put the document's type and summary in front of a chunk; unchanged without a profile."""
    return F.when(
        doc_type.isNotNull(), F.concat(F.format_string(K.CONTEXT_PREFIX, doc_type, summary), content)
    ).otherwise(content)


def resolve_date(custom: Column, created_at: Column, date_str: Column, profile_date: Column) -> Column:
    """STRUCT<created_at, document_date_str>: manual date, else the profile's if it parses, else ingest time."""
    found = D.leading_date(profile_date)
    use = ~custom & found.isNotNull()
    return F.struct(
        F.when(use, found).otherwise(created_at).alias("created_at"),
        F.when(use, F.substring(profile_date, 1, 10)).otherwise(date_str).alias("document_date_str"),
    )


def merge_metadata(document: Column, chunk: Column, identity: Column) -> Column:
    """Three maps, later ones winning; NULL values removed from the identity first, then from the result."""
    empty = F.create_map().cast("map<string,string>")
    return drop_null_metadata(
        F.map_concat(F.coalesce(document, empty), F.coalesce(chunk, empty), drop_null_metadata(identity))
    )


CHUNK = "array<struct<content:string,chunk_type:string,title:string,summary:string>>"


def chunk_array(statements: Column, text: Column, size: int, overlap: int, threshold: float = 0.25) -> Column:
    """The chunks of a document in one pass over Arrow batches.

    `statements` is set for the semantic route, `text` for the structured one, never both. The result holds
    no blank chunk: statements are not blank and the splitter drops blank pieces.
    """

    def semantic(row) -> list[dict]:
        counted = term_counts(row)
        groups: list[list[str]] = []
        counts: list[list] = []
        for statement, terms, number in zip(row, counted, assign_groups(counted, threshold)):
            if number == len(groups):
                groups.append([])
                counts.append([])
            groups[number].append(statement)
            counts[number].append(terms)
        about = describe(groups, counts, K.DEFAULT_TITLE, K.DEFAULT_SUMMARY)
        return [{"content": " ".join(g), "chunk_type": "agentic", **a} for g, a in zip(groups, about)]

    def structured(row: str) -> list[dict]:
        return [
            {"content": c, "chunk_type": "markdown", "title": None, "summary": None}
            for c in split_text(row, size, overlap)
        ]

    return by_row(lambda s, t: semantic(s) if s is not None else structured(t or ""), CHUNK, statements, text)


def chunk_documents(
    docs: DataFrame,
    as_of: Column,
    lexicon: dict[str, list[str]] = LEXICON,
    size: int = K.CHUNK_CHARS,
    overlap: int = K.CHUNK_OVERLAP,
    profile_model: Callable[[Column], Column] | None = None,
    chunk_model: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Documents (source, user_id, filename, text, document_date) to chunk rows ready for indexing.

    One stage: scan, profile, split and explode happen in the task that read the document. `chunk_model`
    replaces `chunk_array` (statements and text columns to an array of chunk structs).
    """
    prepared = document_record(docs.withColumn("text", T.clean_text(F.col("text"))), as_of)
    profiled = profile_documents(prepared, lexicon=lexicon, model=profile_model)
    routed = profiled.withColumn(
        "route", route(F.col("text"), F.col("filename"), F.col("profile.requires_agentic_chunking"))
    )
    semantic = F.col("route") == "semantic"
    statements, whole = F.when(semantic, T.propositions(F.col("text"))), F.when(~semantic, F.col("text"))
    made = chunk_model(statements, whole) if chunk_model else chunk_array(statements, whole, size, overlap)
    kept = ["source", "user_id", "filename", "created_at", "document_date_str", "custom_date", "profile"]
    rows = routed.select(*kept, F.posexplode(made).alias("chunk_index", "chunk"))
    dated = rows.withColumn(
        "when",
        resolve_date(
            F.col("custom_date"), F.col("created_at"), F.col("document_date_str"), F.col("profile.document_date")
        ),
    )
    return dated.select(
        "source",
        "user_id",
        "filename",
        F.col("when.created_at").alias("created_at"),
        F.col("when.document_date_str").alias("document_date_str"),
        "custom_date",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "chunk.chunk_type",
        F.col("chunk.title").alias("chunk_title"),
        F.col("chunk.summary").alias("chunk_summary"),
        F.col("profile.doc_type").alias("doc_type"),
        prefix_context(
            F.col("chunk.content"), F.col("profile.doc_type"), F.col("profile.global_summary")
        ).alias("content"),
    )
