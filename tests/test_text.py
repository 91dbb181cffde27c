"""Text functions, splitting, grouping and chunking on hand-written cases."""

import re

import pandas as pd
import pyarrow as pa
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import dates as D
from lorewell.functions import text as T
from lorewell.functions.grouping import assign_groups, describe, group_numbers, term_counts
from lorewell.functions.html import paragraph_text
from lorewell.functions.splitting import split_text
from lorewell.operators import chunking as C


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def evaluate(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema).withColumn("__i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("__i").select(fn(F.col("x"))).collect()]


def test_clean_text_strips_like_python(spark):
    values = [None, "", "  a b  ", " x ", "\x1ca\x1f", "a\n  b\t\n", "​z", "　 "]
    assert evaluate(spark, values, T.clean_text) == [(v or "").strip() for v in values]


def test_file_extension(spark):
    values = ["a.TXT", "noext", ".bashrc", "..x", "a.b.PDF", "dir.d/file", "dir/.env.md", "a.", "x/y.json"]
    import os

    assert evaluate(spark, values, T.raw_extension) == [os.path.splitext(v)[1] for v in values]
    assert evaluate(spark, ["a.TXT"], T.file_extension) == [".txt"]


def test_slugify(spark):
    def expected(title):
        slug = re.sub(r"[^\w\s-]", "", title.lower().strip())
        return re.sub(r"[\s_-]+", "_", slug)[:60]

    values = ["Plan de Acción: ¡Q1!", "  a -- b__c  ", "日本語 title", "x" * 80, "😀 emoji?", "½ cup"]
    assert evaluate(spark, values, T.slugify) == [expected(v) for v in values]


def test_strip_code_fence(spark):
    values = ['```json\n{"a":1}\n```', "```\nx\n```", "plain", "  ```json[]```  ", "a ``` b"]
    assert evaluate(spark, values, T.strip_code_fence) == ['{"a":1}', "x", "plain", "[]", "a ``` b"]


def test_leading_date(spark):
    values = ["2026-3-5", "2026-03-05T10:00", "2026-02-30", "nope", "", None, "05-03-2026"]
    got = evaluate(spark, values, lambda c: F.date_format(D.leading_date(c), "yyyy-MM-dd"))
    assert got == ["2026-03-05", "2026-03-05", None, None, None, None, None]


def test_propositions_keep_lists_with_their_lead(spark):
    text = "Uno. Dos! Tres?\n\n   \n\nLista:\n- a\n- b. c\n1. d\nFin"
    assert evaluate(spark, [text], T.propositions)[0] == [
        "Uno.", "Dos!", "Tres?", "Lista:\n- a\n- b.", "c\n1. d", "Fin",
    ]


def test_first_sentences_agree_with_all_sentences(spark):
    values = ["a. b. c", "\n\n\n\n\n\n\n\n\n\n\nlate. one", "only", "", "x\n" * 30]
    some = evaluate(spark, values, lambda c: T.first_sentences(c, 2))
    whole = evaluate(spark, values, T.sentences)
    assert some == [s[:2] for s in whole]


def test_first_sentences_do_not_depend_on_the_cut(spark):
    texts = ["Uno.  \n - a\n- b. c\n1. d\nFin. Otro! x\x01y\n\n  * e", "a.\n  - b\n  - c\nd. e", "x\n1.\n2) \ny. z", "sin fin " * 4]
    whole = [s[:2] for s in evaluate(spark, texts, T.sentences)]
    for chars in range(1, 48):
        assert evaluate(spark, texts, lambda c: T.first_sentences(c, 2, chars)) == whole, chars


def test_lexicon_counts_whole_words(spark):
    listed = {"class_notes": ["der", "und"], "general": [r"a\w", "del"]}  # a pattern has no first letter of its own
    values = ["der und under der_ der2 der.der", "ab a del modelo", "", "Ünd und"]
    got = evaluate(spark, values, lambda c: C.lexicon_hits(c, listed))
    first, last = C.K.DOC_TYPES.index("class_notes"), C.K.DOC_TYPES.index("general")
    assert [(g[first], g[last]) for g in got] == [(4, 0), (0, 2), (0, 0), (1, 0)]


# --- splitting ---------------------------------------------------------------

def test_split_prefers_headings():
    text = "# A\n" + "uno " * 120 + "\n## B\n" + "dos " * 200
    parts = split_text(text, 600, 50)
    assert parts[0].startswith("# A") and "## B" not in parts[0]
    assert any(p.startswith("## B") for p in parts)


def test_split_short_text_is_one_chunk():
    assert split_text("a\n\nb", 1000, 200) == ["a\n\nb"]
    assert split_text("   ", 1000, 200) == []


def test_split_overlaps_whole_pieces():
    words = [f"w{i:03d}" for i in range(100)]
    parts = split_text(" ".join(words), 50, 20)
    for a, b in zip(parts, parts[1:]):
        assert b.split()[0] in a.split()[-4:]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 😀\n#-`.", max_size=900), st.integers(5, 60))
def test_split_bounds(text, size):
    assert all(0 < len(p) <= size and p == p.strip() for p in split_text(text, size, size // 4))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\n\n", "\n## ", "\n---\n", "```\n"]), max_size=150), st.integers(10, 60))
def test_split_covers_the_text_in_order(separators, size):
    words = [f"w{i:04d}" for i in range(len(separators) + 1)]
    text = words[0] + "".join(s + w for s, w in zip(separators, words[1:]))
    seen = []
    for part in split_text(text, size, size // 4):
        for word in re.findall(r"w\d{4}", part):
            if word not in seen:
                seen.append(word)
    assert seen == words


# --- grouping ----------------------------------------------------------------

def test_groups_by_shared_words():
    statements = ["el gato negro duerme", "la factura del banco", "el gato duerme mucho", "pagar la factura", "???"]
    assert assign_groups(term_counts(statements)) == [0, 1, 0, 1, 2]
    assert assign_groups([]) == []


def test_groups_match_a_plain_restatement():
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    statements = [" ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(1, 5))) for _ in range(60)]
    sums, expected = [], []
    for s in statements:
        c = Counter(re.findall(r"\w+", s))
        scores = []
        for total in sums:
            dot = sum(n * total[t] for t, n in c.items())
            size = math.sqrt(sum(n * n for n in c.values()) * sum(n * n for n in total.values()))
            scores.append(round(dot / size, 9))
        best = max(range(len(scores)), key=lambda i: (scores[i], -i), default=None)
        if best is None or scores[best] < 0.25:
            best = len(sums)
            sums.append(Counter())
        sums[best].update(c)
        expected.append(best)
    assert assign_groups(term_counts(statements)) == expected


def test_describe():
    groups = [["gato gato perro", "gato"], ["perro casa"], ["!!"]]
    made = describe(groups, [term_counts(g) for g in groups], "-", "--", 2)
    assert made[0] == {"title": "gato perro", "summary": "gato gato perro"}
    assert made[1] == {"title": "casa perro", "summary": "perro casa"}
    assert made[2] == {"title": "-", "summary": "!!"}


# --- HTML --------------------------------------------------------------------

def test_paragraph_text():
    html = (
        "<p>Hola &amp; <b>chau</b><!-- no --></p><div>menu</div><script>var x='<p>no</p>'</script>"
        "<p><style>p{}</style>dos<br>tres</p><p>  </p>"
    )
    assert paragraph_text(html) == "Hola &chau dostres"
    assert paragraph_text("<div>nada</div>") == ""


def test_unclosed_paragraph_holds_the_next_one():
    assert paragraph_text("<div><p>a<p>b</div><p>c</p>") == "ab b c"


# --- documents ---------------------------------------------------------------

def test_route(spark):
    cases = [
        ("x" * 20000, "a.txt", True, "semantic"),
        ("x" * 20001, "a.txt", True, "structured"),
        ("plain", "a.txt", False, "structured"),
        ("plain", "a.pdf", None, "structured"),
        ("plain", "a.PDF", None, "semantic"),
        ("# title\nx", "a.txt", None, "structured"),
        ("x\n# title", "a.txt", None, "structured"),
        ("## only", "a.txt", None, "semantic"),
        ("plain", None, None, "semantic"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "t string, f string, s boolean")
    got = [r[0] for r in df.select(C.route(F.col("t"), F.col("f"), F.col("s"))).collect()]
    assert got == [c[3] for c in cases]


def _docs(spark, data):
    schema = "source string, user_id string, filename string, text string, document_date string"
    return spark.createDataFrame(data, schema)


def test_chunk_documents(spark):
    long = "# Informe\n" + "\n\n".join(f"## Parte {i}\n" + "dato " * 150 for i in range(6))
    docs = _docs(
        spark,
        [
            ("d1", "u1", "a.txt", "El gato duerme. La factura llegó.\n\nEl gato come.", "2026-3-5"),
            ("d2", None, "b.md", long, "bad"),
            ("d3", "u1", "c.txt", "   ", None),
            ("d4", "u2", "d.txt", None, None),
        ],
    )
    made = C.chunk_documents(docs, as_of()).collect()
    by_source = {}
    for r in sorted(made, key=lambda r: r.chunk_index):
        by_source.setdefault(r.source, []).append(r)
    assert set(by_source) == {"d1", "d2"}
    first = by_source["d1"]
    assert [r.chunk_index for r in first] == list(range(len(first)))
    assert {r.chunk_type for r in first} == {"agentic"}
    assert first[0].content.endswith("El gato duerme. El gato come.")
    assert first[0].content.startswith("[Contexto Global de financial_legal: El gato duerme. La factura llegó.]\n\n")
    assert first[0].created_at.isoformat() == "2026-03-05T00:00:00" and first[0].custom_date
    second = by_source["d2"]
    assert {r.chunk_type for r in second} == {"markdown"} and len(second) >= 6
    assert all(len(r.content.split("]\n\n", 1)[1]) <= 1000 for r in second)
    assert second[0].created_at.isoformat() == "2026-01-01T00:00:00" and not second[0].custom_date


def test_chunking_needs_no_shuffle(spark):
    docs = _docs(spark, [("d1", "u", "a.txt", "uno. dos", None)])
    plan = C.chunk_documents(docs, as_of())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_profile_model_hook(spark):
    @F.pandas_udf("struct<doc_type:string,global_summary:string,document_date:string,requires_agentic_chunking:boolean>")
    def model(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "doc_type": "technical_doc", "global_summary": texts.str.upper(),
                "document_date": "2025-01-01", "requires_agentic_chunking": False,
            }
        )

    docs = _docs(spark, [("d1", "u", "a.txt", "hola", None), ("d2", "u", "a.txt", "chau", "2026-12-31")])
    made = {r.source: r for r in C.chunk_documents(docs, as_of(), profile_model=model).collect()}
    assert made["d1"].content == "[Contexto Global de technical_doc: HOLA]\n\nhola"
    assert made["d1"].document_date_str == "2025-01-01"
    assert made["d2"].document_date_str == "2026-12-31"  # a manual date wins


def test_profile_sample(spark):
    docs = spark.createDataFrame([("idea " + "x " * 50 + "factura factura factura",)], "text string")
    whole = C.profile_documents(docs).first().profile.doc_type
    sample = C.profile_documents(docs, sample_chars=20).first().profile.doc_type
    assert (whole, sample) == ("financial_legal", "brainstorming")


def test_extract_text_replaces_bad_bytes(spark):
    df = spark.createDataFrame([("a.TXT", bytearray(b" ok \xff ")), ("b.pdf", bytearray(b"x"))], "filename string, content binary")
    assert rows(C.extract_text(df), "filename", "text") == [("a.TXT", "ok �"), ("b.pdf", None)]


def test_control_characters_survive_statement_splitting(spark):
    text = "a\x01b\x02c. d\x03e\x03A!\n- one. two\x01\n- three? \x02"
    found = spark.createDataFrame([(text,)], "t string").select(T.propositions(F.col("t"))).first()[0]
    assert found == ["a\x01b\x02c.", "d\x03e\x03A!\n- one.", "two\x01\n- three?", "\x02"]


def test_results_leave_a_worker_in_slices(spark):
    from lorewell.functions import rows as R
    from lorewell.functions.splitting import split_structured, split_text
    from lorewell.functions.text import propositions

    texts = pa.array(["a" * 10, None, "b" * 25, "", "c" * 9, "d" * 9, "e" * 9])
    assert [len(made) for made in R.slices(zip(texts), lambda t: t, 20)] == [3, 4]
    assert [x for made in R.slices(zip(texts), lambda t: t, 20) for x in made] == texts.to_pylist()
    long = [f"# h{i}\n" + "word " * 900 for i in range(1200)]  # more than one slice in a batch
    df = spark.createDataFrame([(i, t if i % 7 else None) for i, t in enumerate(long)], "i int, t string").coalesce(1)
    found = {r.i: r.c for r in df.select("i", split_structured(F.col("t")).alias("c")).collect()}
    assert found == {i: split_text(t) if i % 7 else None for i, t in enumerate(long)}
    grouped = df.select("i", group_numbers(propositions(F.col("t"))).alias("g")).collect()
    assert len(grouped) == 1200 and all((r.g is None) == (r.i % 7 == 0) for r in grouped)
