"""Text preparation, profiling and chunking queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.catalog import views as V
from lorewell.functions import dates as D
from lorewell.functions import text as T
from lorewell.functions.grouping import describe_groups, group_numbers
from lorewell.functions.splitting import split_structured as split_column
from lorewell.operators import chunking as C

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Words that do occur in the shared documents, so that every profile branch is reached.
COMMON_WORDS = {
    "meeting_notes": ["the", "of"],
    "class_notes": ["die", "und", "der"],
    "technical_doc": ["que", "les", "de"],
    "research_paper": ["el", "los", "la"],
}
BLANKS = "'" + T.BLANKS + "'"
AS_OF = "2026-01-01 12:30:00"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def sql_sentences(expr: str) -> str:
    held = rf"regexp_replace({expr}, '{T.LIST_ITEM}', '\x01\1\x02', 'g')".replace(r"\x01", "\x01").replace(
        r"\x02", "\x02"
    )
    broken = rf"string_split(regexp_replace({held}, '{T.SENTENCE_END}', '\1' || chr(10), 'g'), chr(10))"
    return (
        f"list_filter(list_transform({broken}, lambda s: {sql_strip('translate(s, chr(1) || chr(2), chr(10) || chr(32))')}), "
        "lambda s: length(s) > 0)"
    )


def sql_propositions(expr: str) -> str:
    paragraphs = f"list_filter(string_split({expr}, chr(10) || chr(10)), lambda p: length({sql_strip('p')}) > 0)"
    return f"flatten(list_transform({paragraphs}, lambda p: {sql_sentences('p')}))"


def sql_words(expr: str) -> str:
    return rf"regexp_extract_all(lower({expr}), '[{T.WORD_CLASS}]+')"


@query
def extract_text(spark, d):
    files = V.texts(spark, d).withColumn("content", F.col("text").cast("binary"))
    return C.extract_text(files.drop("text")).select("doc_id", "filename", "text")


SQL["extract_text"] = V.with_views(
    "v_texts",
    f"""SELECT doc_id, filename, CASE WHEN doc_id % 8 IN (2, 3, 4, 5) THEN {sql_strip("coalesce(text, '')")} END AS text
FROM v_texts""",
)


@query
def clean_text(spark, d):
    return V.texts(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


SQL["clean_text"] = V.with_views(
    "v_texts", f"SELECT doc_id, {sql_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS text FROM v_texts"
)


@query
def document_record(spark, d):
    as_of = F.lit(AS_OF).cast("timestamp")
    return C.document_record(V.texts(spark, d), as_of).select(
        "doc_id", "created_at", "custom_date", "document_date_str",
        D.unix_seconds(F.col("created_at")).alias("created_at_unix"),
    )


_PARSED = r"""CASE WHEN regexp_matches(substr(document_date, 1, 10), '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$')
  THEN try_strptime(substr(document_date, 1, 10), '%Y-%m-%d') END"""
SQL["document_record"] = V.with_views(
    "v_texts",
    f"""WITH p AS (SELECT *, {_PARSED} AS parsed FROM v_texts)
SELECT doc_id, coalesce(parsed, TIMESTAMP '{AS_OF}') AS created_at, parsed IS NOT NULL AS custom_date,
  CASE WHEN parsed IS NOT NULL THEN substr(document_date, 1, 10) END AS document_date_str,
  epoch_us(coalesce(parsed, TIMESTAMP '{AS_OF}')) / 1000000 AS created_at_unix FROM p""",
)


@query
def drop_null_metadata(spark, d):
    t = V.texts(spark, d)
    metadata = F.create_map(
        F.lit("source"), F.col("source"), F.lit("user_id"), F.col("user_id"), F.lit("date"), F.col("document_date")
    )
    kept = C.drop_null_metadata(metadata)
    return t.select("doc_id", F.explode(kept).alias("key", "value"))


SQL["drop_null_metadata"] = V.with_views(
    "v_texts",
    """SELECT doc_id, key, value FROM (SELECT doc_id, unnest(['source', 'user_id', 'date']) AS key,
  unnest([source, user_id, document_date]) AS value FROM v_texts) WHERE value IS NOT NULL""",
)


@query
def profile_documents(spark, d):
    docs = V.texts(spark, d).withColumn("text", T.clean_text(F.col("text")))
    return C.profile_documents(docs, lexicon=COMMON_WORDS).select(
        "doc_id", "profile.doc_type", "profile.global_summary", "profile.requires_agentic_chunking"
    )


def sql_profile(text: str) -> str:
    """SELECT list entries for the profile of a cleaned text column."""
    words = sql_words(text)
    counts = "[" + ", ".join(
        f"len(list_filter({words}, lambda w: list_contains({V.sql_list(COMMON_WORDS[t])}, w)))" if t in COMMON_WORDS else "0"
        for t in K.DOC_TYPES
    ) + "]"
    best = f"list_max({counts})"
    return rf"""CASE WHEN {best} > 0 THEN {V.sql_list(K.DOC_TYPES)}[list_position({counts}, {best})] ELSE 'general' END AS doc_type,
  substr(array_to_string({sql_sentences(text)}[1:2], ' '), 1, 300) AS global_summary,
  NOT regexp_matches({text}, '{T.STRUCTURE_LINE}') AS requires_agentic_chunking"""


_CLEAN = sql_strip("coalesce(text, '')")
SQL["profile_documents"] = V.with_views(
    "v_texts",
    f"""WITH c AS (SELECT doc_id, {_CLEAN} AS text FROM v_texts) SELECT doc_id, {sql_profile('text')} FROM c""",
)


def _dated(spark, d):
    """Orders as short texts that mention their date in one of several notations."""
    n, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    mention = (
        F.when(n % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(n % 5 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(n % 5 == 2, F.concat(F.lit("31/02/2020, 2020-13-01 o "), F.date_format(day, "yyyy-MM-dd")))
        .when(n % 5 == 3, F.concat(F.lit("01/01/2020 y "), F.date_format(day, "yyyy-MM-dd")))
        .otherwise("sin fecha")
    )
    return V.table(spark, d, "orders").select(
        n.alias("doc_id"), F.concat(F.lit("Pedido "), n.cast("string"), F.lit(" del "), mention).alias("text"),
        F.when(n % 3 == 0, day).alias("manual"),
    )


_DATED = """SELECT o_orderkey AS doc_id, 'Pedido ' || o_orderkey || ' del ' || CASE o_orderkey % 5
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN '31/02/2020, 2020-13-01 o ' || strftime(o_orderdate, '%Y-%m-%d')
  WHEN 3 THEN '01/01/2020 y ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'sin fecha' END AS text,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS manual FROM orders"""
_FOUND = """coalesce(
  list_filter(list_transform(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: try_strptime(x, '%Y-%m-%d')), lambda x: x IS NOT NULL)[1],
  list_filter(list_transform(regexp_extract_all(text, '[0-9]{2}/[0-9]{2}/[0-9]{4}'), lambda x: try_strptime(x, '%d/%m/%Y')), lambda x: x IS NOT NULL)[1])"""


@query
def extract_document_date(spark, d):
    return _dated(spark, d).select("doc_id", D.first_date_in(F.col("text")).alias("found"))


SQL["extract_document_date"] = f"WITH t AS ({_DATED}) SELECT doc_id, {_FOUND} AS found FROM t"


@query
def resolve_document_date(spark, d):
    found = F.date_format(D.first_date_in(F.col("text")), "yyyy-MM-dd")
    resolved = C.resolve_date(
        F.col("manual").isNotNull(),
        F.coalesce("manual", F.lit(AS_OF).cast("timestamp")),
        F.date_format("manual", "yyyy-MM-dd"),
        found,
    )
    return _dated(spark, d).select("doc_id", resolved.alias("r")).select("doc_id", "r.*")


SQL["resolve_document_date"] = f"""WITH t AS (SELECT *, {_FOUND} AS found FROM ({_DATED}))
SELECT doc_id, coalesce(manual, found, TIMESTAMP '{AS_OF}') AS created_at,
  strftime(coalesce(manual, found), '%Y-%m-%d') AS document_date_str FROM t"""


@query
def route_chunking(spark, d):
    t = V.texts(spark, d).withColumn("text", T.clean_text(F.col("text")))
    flag = F.when(F.col("doc_id") % 3 == 0, ~T.has_structure(F.col("text")))
    return t.select("doc_id", C.route(F.col("text"), F.col("filename"), flag).alias("route"))


SQL["route_chunking"] = V.with_views(
    "v_texts",
    rf"""WITH c AS (SELECT doc_id, filename, {_CLEAN} AS text FROM v_texts),
f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NOT regexp_matches(text, '{T.STRUCTURE_LINE}') END AS flag FROM c)
SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'structured'
  WHEN flag IS NOT NULL THEN CASE WHEN flag THEN 'semantic' ELSE 'structured' END
  WHEN filename LIKE '%.pdf' OR filename LIKE '%.docx' OR text LIKE '# %' OR contains(text, chr(10) || '# ') THEN 'structured'
  ELSE 'semantic' END AS route FROM f""",
)


@query
def split_structured(spark, d):
    """Every document split by structure, whatever its route."""
    t = V.texts(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return t.select("doc_id", F.posexplode(split_column(F.col("text"))).alias("pos", "content"))


@query
def split_propositions(spark, d):
    t = V.texts(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return t.select("doc_id", F.posexplode(T.propositions(F.col("text"))).alias("pos", "statement"))


SQL["split_propositions"] = V.with_views(
    "v_texts",
    f"""WITH c AS (SELECT doc_id, {_CLEAN} AS text FROM v_texts), p AS (SELECT doc_id, {sql_propositions('text')} AS ps FROM c)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS pos, unnest(ps) AS statement FROM p""",
)


@query
def group_propositions(spark, d):
    """Statements of all documents with their group number and its stable id."""
    t = V.texts(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))
    grouped = t.select("doc_id", T.propositions(F.col("text")).alias("s")).withColumn("g", group_numbers(F.col("s")))
    rows = grouped.select("doc_id", F.posexplode(F.arrays_zip("s", "g")).alias("pos", "x"))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("x.g").cast("string"))
    return rows.select(
        "doc_id", "pos", F.col("x.s").alias("statement"), F.col("x.g").alias("group_number"),
        F.substring(F.sha2(key, 256), 1, 16).alias("group_id"),
    )


@query
def chunk_title_summary(spark, d):
    """Title and summary of groups; here each line of a document is one group of sentences."""
    t = V.texts(spark, d).select("doc_id", F.split(T.clean_text(F.col("text")), "\n", -1).alias("lines"))
    groups = F.filter(F.transform("lines", T.sentences), lambda g: F.size(g) > 0)
    about = describe_groups(groups, K.DEFAULT_TITLE, K.DEFAULT_SUMMARY)
    return t.select("doc_id", F.posexplode(about).alias("group_number", "a")).select(
        "doc_id", "group_number", "a.title", "a.summary"
    )


SQL["chunk_title_summary"] = V.with_views(
    "v_texts",
    f"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda l: {sql_sentences('l')}), lambda g: len(g) > 0) AS groups FROM v_texts),
g AS (SELECT doc_id, generate_subscripts(groups, 1) - 1 AS grp, unnest(groups) AS ss, len(groups) AS n_groups FROM c),
s AS (SELECT doc_id, grp, n_groups, generate_subscripts(ss, 1) AS seq, unnest(ss) AS statement FROM g),
w AS (SELECT doc_id, grp, n_groups, seq, unnest({sql_words('statement')}) AS term FROM s),
ts AS (SELECT doc_id, grp, seq, term, count(*) AS n FROM w GROUP BY ALL),
tg AS (SELECT doc_id, grp, n_groups, term, count(*) AS n FROM w GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS spread FROM tg GROUP BY ALL),
ranked AS (SELECT tg.doc_id, grp, tg.term, row_number() OVER (PARTITION BY tg.doc_id, grp
    ORDER BY round(n * ln(1 + n_groups / spread), 9) DESC, tg.term) AS rn
  FROM tg JOIN df ON tg.doc_id = df.doc_id AND tg.term = df.term),
titles AS (SELECT doc_id, grp, string_agg(term, ' ' ORDER BY rn) AS title FROM ranked WHERE rn <= 3 GROUP BY ALL),
near AS (SELECT ts.doc_id, ts.grp, seq, round(sum(ts.n * tg.n) / sqrt(sum(ts.n * ts.n)), 9) AS score
  FROM ts JOIN tg ON ts.doc_id = tg.doc_id AND ts.grp = tg.grp AND ts.term = tg.term GROUP BY ALL),
best AS (SELECT s.doc_id, s.grp, statement, row_number() OVER (PARTITION BY s.doc_id, s.grp
   ORDER BY coalesce(score, 0) DESC, s.seq) AS rn FROM s LEFT JOIN near USING (doc_id, grp, seq))
SELECT b.doc_id, b.grp AS group_number, coalesce(title, '{K.DEFAULT_TITLE}') AS title, statement AS summary
FROM best b LEFT JOIN titles t ON b.doc_id = t.doc_id AND b.grp = t.grp WHERE rn = 1""",
)


@query
def semantic_chunk_rows(spark, d):
    """Content of groups; here the group of a statement is its position divided by four."""
    t = V.texts(spark, d).select("doc_id", T.propositions(T.clean_text(F.col("text"))).alias("s"))
    numbers = F.transform("s", lambda x, i: F.floor(i / 4).cast("int"))
    groups = C.grouped_statements(F.col("s"), numbers)
    titles = F.transform(
        groups, lambda g, i: F.struct(F.when(i % 2 == 0, g[0]).alias("title"), F.lit(None).cast("string").alias("summary"))
    )
    rows = t.select("doc_id", F.posexplode(C.semantic_chunks(groups, titles)).alias("group_number", "c"))
    return rows.select("doc_id", "group_number", "c.*")


SQL["semantic_chunk_rows"] = V.with_views(
    "v_texts",
    f"""WITH c AS (SELECT doc_id, {sql_propositions(_CLEAN)} AS ps FROM v_texts),
p AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS s FROM c)
SELECT doc_id, CAST(pos // 4 AS BIGINT) AS group_number, string_agg(s, ' ' ORDER BY pos) AS content, 'agentic' AS chunk_type,
  CASE WHEN (pos // 4) % 2 = 0 THEN arg_min(s, pos) ELSE '{K.DEFAULT_TITLE}' END AS title, '{K.DEFAULT_SUMMARY}' AS summary
FROM p GROUP BY doc_id, pos // 4""",
)


def _line_chunks(spark, d):
    t = V.texts(spark, d)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(x.alias("content")))
    return t.select("doc_id", "user_id", "source", "filename", lines.alias("chunks"))


_LINES_SQL = """SELECT doc_id, user_id, source, filename, generate_subscripts(l, 1) AS pos, unnest(l) AS content
FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM v_texts)"""


@query
def assign_chunk_index(spark, d):
    """Blank chunks dropped, the rest numbered from 0 within their document."""
    return C.number_chunks(_line_chunks(spark, d)).select("doc_id", "chunk_index", "content")


SQL["assign_chunk_index"] = V.with_views(
    "v_texts",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, content
FROM ({_LINES_SQL}) WHERE length({sql_strip('content')}) > 0""",
)


@query
def drop_blank_chunks(spark, d):
    kept = F.size(C.drop_blank_chunks(F.col("chunks")))
    return _line_chunks(spark, d).select("doc_id", F.size("chunks").alias("n_chunks"), kept.alias("n_kept"))


SQL["drop_blank_chunks"] = V.with_views(
    "v_texts",
    f"""SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE length({sql_strip('content')}) > 0) AS n_kept
FROM ({_LINES_SQL}) GROUP BY doc_id""",
)


@query
def prefix_global_context(spark, d):
    t = V.texts(spark, d)
    doc_type = F.when(F.col("doc_id") % 4 != 0, V.pick(K.DOC_TYPES, F.col("doc_id") % 10))
    return t.select("doc_id", C.prefix_context(F.col("text"), doc_type, F.col("filename")).alias("content"))


SQL["prefix_global_context"] = V.with_views(
    "v_texts",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN '[Contexto Global de ' || {V.sql_list(K.DOC_TYPES)}[(doc_id % 10) + 1] || ': ' || filename || ']'
  || chr(10) || chr(10) || text ELSE text END AS content FROM v_texts""",
)


@query
def merge_metadata(spark, d):
    t = V.texts(spark, d)
    document = F.create_map(
        F.lit("source"), F.col("filename"), F.lit("doc_type"), F.lit("general"), F.lit("date"), F.col("document_date")
    )
    chunk = F.when(
        F.col("doc_id") % 2 == 0,
        F.create_map(F.lit("doc_type"), F.lit("chunked"), F.lit("user_id"), F.lit("from chunk")),
    )
    identity = F.create_map(
        F.lit("source"), F.col("source"), F.lit("user_id"), F.col("user_id"), F.lit("filename"), F.col("filename")
    )
    return t.select("doc_id", F.explode(C.merge_metadata(document, chunk, identity)).alias("key", "value"))


SQL["merge_metadata"] = V.with_views(
    "v_texts",
    """SELECT doc_id, key, value FROM (SELECT doc_id, unnest(['source', 'doc_type', 'date', 'user_id', 'filename']) AS key,
  unnest([source, CASE WHEN doc_id % 2 = 0 THEN 'chunked' ELSE 'general' END, document_date,
    coalesce(user_id, CASE WHEN doc_id % 2 = 0 THEN 'from chunk' END), filename]) AS value FROM v_texts) WHERE value IS NOT NULL""",
)


@query
def chunk_documents(spark, d):
    """The whole way from texts to chunk rows."""
    return C.chunk_documents(V.texts(spark, d), F.lit(AS_OF).cast("timestamp"), lexicon=COMMON_WORDS)


@query
def chunk_documents_per_source(spark, d):
    """Per document: what chunking made of it. Checks route, type and date of the whole way."""
    made = C.chunk_documents(V.texts(spark, d), F.lit(AS_OF).cast("timestamp"), lexicon=COMMON_WORDS)
    return made.groupBy("source").agg(
        F.min("chunk_type").alias("chunk_type"),
        F.min("doc_type").alias("doc_type"),
        F.min("created_at").alias("created_at"),
        F.min("document_date_str").alias("document_date_str"),
        (F.max("chunk_index") + 1 == F.count("*")).alias("dense_index"),
    )


SQL["chunk_documents_per_source"] = V.with_views(
    "v_texts",
    rf"""WITH c AS (SELECT * EXCLUDE (text), {_CLEAN} AS text, {_PARSED} AS parsed FROM v_texts WHERE length({_CLEAN}) > 0),
p AS (SELECT *, {sql_profile('text')} FROM c)
SELECT source, CASE WHEN length(text) <= 20000 AND requires_agentic_chunking THEN 'agentic' ELSE 'markdown' END AS chunk_type,
  doc_type, coalesce(parsed, TIMESTAMP '{AS_OF}') AS created_at,
  CASE WHEN parsed IS NOT NULL THEN substr(document_date, 1, 10) END AS document_date_str, true AS dense_index FROM p""",
)


@query
def slugify(spark, d):
    """Every document's text as a title."""
    return V.texts(spark, d).select("doc_id", T.slugify(F.col("text")).alias("slug"))


SQL["slugify"] = V.with_views(
    "v_texts",
    rf"""SELECT doc_id, substr(regexp_replace(regexp_replace({sql_strip('lower(text)')}, '[^{T.WORD_CLASS}{T.BLANK_CLASS}-]', '', 'g'),
  '[{T.BLANK_CLASS}_-]+', '_', 'g'), 1, 60) AS slug FROM v_texts""",
)


def _fenced():
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return (
        F.when(n % 4 == 0, F.concat(F.lit(" ```json\n"), text, F.lit("\n``` ")))
        .when(n % 4 == 1, F.concat(F.lit("```\n"), text, F.lit("```")))
        .when(n % 4 == 2, F.concat(F.lit("see\n```json\n"), text, F.lit("\n```\nend")))
        .otherwise(text)
    )


@query
def strip_code_fence(spark, d):
    reply = _fenced()
    return V.texts(spark, d).select(
        "doc_id", T.strip_code_fence(reply).alias("stripped"), T.fenced_block(reply).alias("block")
    )


SQL["strip_code_fence"] = V.with_views(
    "v_texts",
    f"""WITH r AS (SELECT doc_id, {sql_strip('''CASE doc_id % 4 WHEN 0 THEN ' ```json' || chr(10) || coalesce(text, '') || chr(10) || '``` '
    WHEN 1 THEN '```' || chr(10) || coalesce(text, '') || '```'
    WHEN 2 THEN 'see' || chr(10) || '```json' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || 'end'
    ELSE coalesce(text, '') END''')} AS b FROM v_texts),
o AS (SELECT *, CASE WHEN starts_with(b, '```json') THEN substr(b, 8) WHEN starts_with(b, '```') THEN substr(b, 4) ELSE b END AS opened FROM r)
SELECT doc_id, {sql_strip("CASE WHEN ends_with(opened, '```') THEN left(opened, CAST(length(opened) - 3 AS BIGINT)) ELSE opened END")} AS stripped,
  CASE WHEN contains(b, '```json') THEN {sql_strip("string_split(string_split(b, '```json')[2], '```')[1]")}
    WHEN contains(b, '```') THEN {sql_strip("string_split(b, '```')[2]")} ELSE b END AS block FROM o""",
)
