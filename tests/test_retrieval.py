"""Vector search against brute force, tenant isolation, fallbacks and formatting."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.operators import retrieval as R
from lorewell.operators import approx as X
from lorewell.catalog.search import QUERIES
from lorewell.plans import retrieve as P

CHUNK = (
    "chunk_key string, source string, user_id string, filename string, chunk_index bigint, chunk_type string, "
    "doc_type string, created_at timestamp, content string, embedding array<float>"
)
QUESTION = (
    "query_id int, query string, user_id string, date_from string, source_filter string, doc_type string, "
    "k_results bigint, embedding array<double>"
)
DAY = dt.datetime(2026, 1, 1)


def chunk(key, source="s1", user="u1", index=0, kind="markdown", doc_type="general", day=0, content=None, vector=(1.0, 0.0), filename=None):
    return (key, source, user, filename, index, kind, doc_type, DAY + dt.timedelta(day), content or f"texto {key}", [float(x) for x in vector])


def question(qid=1, query="texto", user="u1", date=None, source=None, doc_type=None, k=4, vector=(1.0, 0.0)):
    return (qid, query, user, date, source, doc_type, k, list(vector))


def ask(spark, questions, chunks, **options):
    q = spark.createDataFrame(questions, QUESTION)
    c = spark.createDataFrame(chunks, CHUNK)
    return {r.query_id: r.context for r in P.retrieve(q, c, **options).collect()}


@pytest.fixture(scope="module")
def many(spark):
    """A third of the chunks belong to one source and share one vector."""
    rng = random.Random(2)
    hot = [0.3, -0.1, 0.8, 0.2]
    chunks = []
    for i in range(900):
        vector = hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(4)]
        chunks.append(
            chunk(f"c{i:04d}", "hot" if i % 3 == 0 else f"s{i % 20}", f"u{i % 4}", i % 10, "markdown",
                  K.DOC_TYPES[i % 10], i % 30, f"palabra{i % 13} comun", vector)
        )
    questions = []
    for q in range(25):
        vector = hot if q == 0 else [rng.uniform(-1, 1) for _ in range(4)]
        questions.append(
            question(q, f"palabra{q % 13}", f"u{q % 4}" if q % 3 else None, "2026-01-15" if q % 5 == 1 else None,
                     "hot" if q % 7 == 2 else None, K.DOC_TYPES[q % 10] if q % 6 == 3 else None, 2 + q % 6, vector)
        )
    return spark.createDataFrame(questions, QUESTION), spark.createDataFrame(chunks, CHUNK).repartition(6), questions, chunks


def brute_force(questions, chunks):
    answer = {}
    for qid, _, user, date, source, doc_type, k, vector in questions:
        scored = []
        for key, c_source, c_user, _, _, _, c_type, created, _, v in chunks:
            if user and c_user != user or source and c_source != source or doc_type and c_type != doc_type:
                continue
            if date and created < dt.datetime.fromisoformat(date):
                continue
            a, b = np.array(v, dtype=np.float32).astype(float), np.array(vector)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), key))
        for rank, (_, key) in enumerate(sorted(scored)[: int(2.5 * k)], 1):
            answer[qid, key] = rank
    return answer


@pytest.mark.parametrize("block", [4096, 7])
def test_topk_matches_brute_force(spark, many, monkeypatch, block):
    q, c, questions, chunks = many
    blocks = R.question_blocks(q, block)
    assert (len(blocks) == 1) == (block == 4096) and all(b.count() <= block for b in blocks)
    assert sum(b.count() for b in blocks) == 25
    monkeypatch.setattr(R, "question_blocks", lambda _: blocks)
    monkeypatch.setattr(R, "QUESTION_SLICE", 4 if block == 4096 else 256)
    got = {(r.query_id, r.chunk_key): r.vector_rank for r in R.vector_topk(q, c).collect()}
    assert got == brute_force(questions, chunks)


@pytest.fixture(scope="module")
def celled(spark, many, tmp_path_factory):
    _, c, _, _ = many
    path = str(tmp_path_factory.mktemp("cells") / "index")
    cells = X.fit_cells(c, 24)
    X.write_index(c, cells, path)
    return X.read_index(spark, path, c.schema), cells


def counts(df):
    return {r.query_id: r["count"] for r in df.groupBy("query_id").count().collect()}


def test_every_chunk_is_in_its_nearest_cell(spark, many, celled):
    _, c, _, _ = many
    index, cells = celled
    assert len(cells.centres) == 24 and index.count() == 900
    for r in index.select("embedding", "cell").distinct().collect():
        v = np.array(r.embedding)
        assert r.cell == int(np.round(cells.centres @ v / np.linalg.norm(v), R.DIGITS).argmax())


def test_cells_split_dense_regions():
    rng = np.random.default_rng(1)
    dense = np.array([1.0, 0, 0, 0]) + 0.1 * rng.standard_normal((900, 4))
    vectors = np.concatenate((dense, rng.standard_normal((100, 4))))
    centres = X.split_cells(vectors, 40)
    size = np.bincount((X._unit(vectors) @ centres.T).argmax(1), minlength=40)
    assert len(centres) == 40 and size.max() < 100
    assert len(X.split_cells(np.ones((50, 4)), 8)) == 1 and len(X.split_cells(np.zeros((5, 4)), 8)) == 1


def test_approx_topk(spark, many, celled):
    q, c, _, _ = many
    index, cells = celled
    exact = R.vector_topk(q, c)
    everywhere = X.approx_topk(q, index, cells, probes=24, exact_fallback=False)
    assert rows(everywhere) == rows(exact)
    found = X.approx_topk(q, index, cells, probes=6)
    assert counts(found) == counts(exact)
    recalls = [r.recall for r in X.recall_at_k(found, exact).collect()]
    assert sum(recalls) / len(recalls) > 0.8
    # a question whose cells give too little is answered exactly
    assert counts(X.approx_topk(q, index, cells, probes=1)) == counts(exact)


def test_only_asked_cells_are_read(spark, many, celled):
    _, _, questions, _ = many
    index, cells = celled
    one = spark.createDataFrame([question(3, user=None, vector=questions[3][-1])], QUESTION)
    asked = {r.cell for r in X.add_cells_of(one, cells, 2).collect()}
    plan = R._topk_block(one, index, F.lit(5), None, lambda v: cells.nearest(v, 2))
    assert "PartitionFilters: [cell" in plan._jdf.queryExecution().executedPlan().toString()
    part = index.filter(F.col("cell").isin(list(asked)))
    assert X.scored_pairs(one, index, cells, 2).first().scored == part.count() < 0.5 * index.count()
    keys = {r.chunk_key for r in plan.collect()}
    assert keys <= {r.chunk_key for r in part.collect()} and len(keys) == 5


def test_recall_of_the_registered_settings(spark):
    found = QUERIES["approx_recall"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(found) >= 10  # every hundredth of 1000 documents asks
    assert found["recall"].mean() >= 0.9
    assert found["scored"].sum() <= 0.2 * found["chunks"].sum()


def test_every_hundredth_document_asks_against_all(spark, tmp_path):
    docs = [(i, f"word{i % 37} text{i % 11} both{i} end{i % 5}", "en", "web", 20) for i in range(1, 401)]
    made = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["approx_recall"](spark, str(tmp_path)).toPandas()
    assert sorted(found["query_id"]) == [100, 200, 300, 400] and set(found["chunks"]) == {400}


def test_nearest_cell_is_the_first_of_the_nearest():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 4))
    cells = X.Cells(np.concatenate((centres, centres[2:4])))  # equal centres tie
    vectors = np.concatenate((rng.standard_normal((50, 4)), centres, np.zeros((1, 4))))
    assert (cells.nearest(vectors, 1)[:, 0] == cells.nearest(vectors, 3)[:, 0]).all()


def test_odd_vectors(spark, tmp_path):
    made = spark.createDataFrame([chunk("a"), chunk("b", vector=(0, 0)), chunk("c", vector=()), chunk("d", vector=(0, 1))], CHUNK)
    assert [r.cell is not None for r in X.add_cells(made, X.fit_cells(made)).collect()] == [True] * 4
    empty = made.limit(0)
    assert X.add_cells(empty, X.fit_cells(empty)).count() == 0


def test_chunk_table_is_not_shuffled(spark, many):
    q, c, _, _ = many
    hits = R.vector_topk(q, c)
    plan = R.attach_chunks(hits, c, bounded=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in hits._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark, many, tmp_path):
    _, c, _, _ = many
    c.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    q = spark.createDataFrame([question(1, date="2026-01-05")], QUESTION)
    plan = R.vector_topk(q, stored)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In" in plan or "EqualTo(user_id,u1)" in plan
    assert "GreaterThanOrEqual(created_at" in plan
    assert "content" not in plan
    wanted = R.metadata_filter(date_from="2026-01-05", user_id="u1")
    single = stored.filter(wanted).select("chunk_key")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,u1)" in single


def test_metadata_filter_parts():
    assert R.metadata_filter() is None
    assert R.metadata_filter(date_from="no date") is None


def test_no_other_users_chunk(spark):
    chunks = [chunk("mine", user="u1", index=0), chunk("next", user="u2", index=1, content="texto SECRETO"),
              chunk("other", source="s2", user="u2", content="texto SECRETO")]
    context = ask(spark, [question()], chunks)[1]
    assert "texto mine" in context and "SECRETO" not in context


def test_user_is_required_by_default(spark):
    chunks = [chunk("a", user="u2")]
    assert ask(spark, [question(user=None)], chunks)[1].startswith(K.ERROR_PREFIX)
    assert "texto a" in ask(spark, [question(user=None)], chunks, require_user=False)[1]


def test_blank_query_and_bad_k(spark):
    got = ask(spark, [question(1, "  "), question(2, k=8), question(3, k=None)], [chunk("a")])
    assert got[1] == K.EMPTY_QUERY_ERROR
    assert got[2].startswith(K.ERROR_PREFIX)
    assert "texto a" in got[3]


def test_overfetch(spark):
    df = spark.createDataFrame([(k,) for k in range(2, 8)], "k bigint")
    assert [r[0] for r in df.select(R.overfetch(F.col("k"))).collect()] == [5, 7, 10, 12, 15, 17]


def test_filters_are_relaxed_once_and_only_if_given(spark):
    chunks = [chunk("a"), chunk("b", source="s9", user="u2")]
    got = ask(
        spark,
        [
            question(1, source="missing"), question(2, date="2999-01-01"), question(3, date="bad date"),
            question(4, query="nada"), question(5, source="missing", query="nada"), question(6, doc_type="tutorial_guide"),
        ],
        chunks,
    )
    assert all("texto a" in got[i] for i in (1, 2, 3, 6))
    assert got[4] == got[5] == K.NOTHING_FOUND


def test_source_filter_takes_file_names(spark):
    chunks = [chunk("a", filename="uno.txt"), chunk("b", source="s2", filename="dos.txt")]
    got = ask(spark, [question(1, source="dos.txt"), question(2, source="s1")], chunks)
    assert "texto b" in got[1] and "texto a" not in got[1]
    assert "texto a" in got[2] and "texto b" not in got[2]


def test_adjacent_expansion(spark):
    chunks = [
        chunk("c0", index=0, content="cero x"), chunk("c1", index=1, content="uno x"), chunk("c2", index=2, content="dos texto"),
        chunk("c3", index=3, content="tres x"), chunk("c5", index=5, content="cinco texto"),
        chunk("n", source="s2", index=None, content="suelto texto"),
    ]
    context = ask(spark, [question()], chunks, url_base="files/")[1]
    blocks = context.split(K.CONTEXT_SEPARATOR)
    assert sorted(b.split("\n", 1)[1] for b in blocks) == ["cinco texto", "suelto texto", "uno x\ndos texto\ntres x"]
    assert all(b.startswith("Fuente: [s") and "](files/u1/s" in b and "(Tipo: general)" in b for b in blocks)


def test_document_expansion_once_per_source(spark):
    vectors = [(1, 0), (0.9, 0.1), (0.8, 0.2), (0.7, 0.3), (0, 1)]
    chunks = [chunk(f"c{i}", index=4 - i, kind="agentic", content=f"t{i} texto", vector=v) for i, v in enumerate(vectors)]
    context = ask(spark, [question(k=7)], chunks)[1]
    assert context == "Fuente: [s1](#) (Tipo: general)\nt3 texto\n\nt2 texto\n\nt1 texto\n\nt0 texto"


def test_rerank_falls_back_only_on_failure(spark):
    data = [(1, "a", 1, None), (1, "b", 2, None), (2, "a", 1, 0.0), (3, "a", 1, 0.0), (3, "b", 2, 2.0), (3, "c", 3, 2.0)]
    scored = spark.createDataFrame(data, "query_id int, chunk_key string, vector_rank int, score double")
    assert rows(R.rank_scored(scored, F.lit(2)), "query_id", "rank", "chunk_key") == [
        (1, 1, "a"), (1, 2, "b"), (3, 1, "b"), (3, 2, "c"),
    ]


def test_same_answer_with_kept_statistics(spark, many):
    q, c, _, _ = many
    plain = rows(P.retrieve(q, c, require_user=False))
    kept = rows(P.retrieve(q, c, require_user=False, statistics=R.index_statistics(c)))
    assert plain == kept


def test_repeated_question_ids_are_refused(spark):
    asked = spark.createDataFrame([("q",), ("q",), (None,)], "query_id string")
    with pytest.raises(ValueError):
        R.question_blocks(asked, 2)
    many = spark.range(50).selectExpr("cast(id AS string) AS query_id")
    blocks = R.question_blocks(many, 7)
    assert sum(b.count() for b in blocks) == 50 and all(b.count() <= 7 for b in blocks)
