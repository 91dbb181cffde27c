"""Memory, audit, frames, pages, notes and evaluation rules on small fixtures."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from lorewell import constants as K
from lorewell.operators import audit as A
from lorewell.operators import chats as C
from lorewell.operators import evaluation as E
from lorewell.operators import feedback as FB
from lorewell.operators import frames as FR
from lorewell.operators import memory as M
from lorewell.operators import pages as P

MESSAGE = "thread_id string, seq bigint, id string, role string, name string, tool_calls array<string>, content string"
T0 = dt.datetime(2026, 1, 1)


def messages(spark, *threads):
    """Threads as lists of (role, content[, name or calls])."""
    data = []
    for t, thread in enumerate(threads):
        for i, row in enumerate(thread):
            role, content, *more = row
            name = more[0] if more and role == "tool" else None
            calls = more[0] if more and role == "ai" else []
            data.append((f"t{t}", i, f"t{t}-{i}", role, name, calls, content))
    return spark.createDataFrame(data, MESSAGE)


def turns(spark, data):
    schema = (
        "thread_id string, generate_retry_count int, retrieve_retry_count int, docs_parse_retries int, "
        "hallucinations_parse_retries int, task_plan array<struct<tool:string,reason:string,done:boolean>>"
    )
    return spark.createDataFrame([(f"t{i}", *row) for i, row in enumerate(data)], schema)


H, AI, TOOL = "human", "ai", "tool"
SYN = "[SISTEMA]: otra vez"


def test_turn_slicing(spark):
    m = messages(
        spark,
        [(AI, "a"), (TOOL, "x", "web_search")],  # no user row: everything
        [(H, "q"), (AI, "a"), (H, SYN), (TOOL, "x", "web_search"), (AI, "b")],  # synthetic rows do not count
        [(H, "q")],
    )
    assert rows(M.current_turn(m), "id") == [("t0-0",), ("t0-1",), ("t1-1",), ("t1-2",), ("t1-3",), ("t1-4",)]
    assert rows(M.last_tool_batch(m), "id") == [("t0-1",)]


def test_truncation_boundary(spark):
    m = messages(spark, [(TOOL, "x" * 500, "a"), (TOOL, "x" * 501, "b"), (AI, "y" * 501)])
    got = [r.content for r in M.truncate_tool_rows(m).orderBy("seq").collect()]
    assert got == ["x" * 500, K.TOOL_TEXT_PLACEHOLDER, "y" * 501]


def test_reduce_messages(spark):
    v = spark.createDataFrame(
        [("t", "a", 1, False, "1"), ("t", "b", 2, False, "2"), ("t", "a", 3, False, "3"), ("t", "b", 4, True, None),
         ("t", "c", 5, False, "5"), ("t", "b", 6, False, "6"), ("u", "a", 1, False, "other")],
        "thread_id string, id string, version bigint, removed boolean, content string",
    )
    assert rows(M.reduce_messages(v), "thread_id", "seq", "id", "content") == [
        ("t", 1, "a", "3"), ("t", 5, "c", "5"), ("t", 6, "b", "6"), ("u", 1, "a", "other"),
    ]


def test_run_summaries(spark):
    u = spark.createDataFrame(
        [("t", 1, "a"), ("t", 2, None), ("t", 3, "b"), ("t", 4, "c"), ("u", 1, "x"), ("v", 1, None)],
        "thread_id string, seq bigint, summary string",
    )
    assert rows(M.reduce_run_summaries(u)) == [("t", 3, "b"), ("t", 4, "c"), ("u", 1, "x")]


def test_summarize_turn(spark):
    m = messages(
        spark,
        [(H, "viejo"), (AI, "r"), (H, "q" * 300), (AI, "plan", ["web_search"]), (TOOL, "z" * 300, "web_search"),
         (TOOL, "n", "save_note_to_knowledge_base"), (TOOL, "w", "web_search"), (AI, "fin")],
        [(AI, "sin usuario")],
    )
    assert M.summarize_turn(m).first().summary.startswith("q" * 300 + " → ")
    summary = M.summarize_turn(m, 200).collect()
    assert [(r.thread_id, r.summary) for r in summary] == [
        ("t0", "q" * 200 + " → web_search, save_note_to_knowledge_base → fin")
    ]
    lines = [r.log_line for r in M.turn_steps(m, 200).orderBy("seq").collect()]
    assert lines[0] == "Asistente (Plan): plan" and lines[1] == "Herramienta (web_search): " + "z" * 200
    assert rows(M.prune_turn(m).filter("thread_id = 't0'"), "seq") == [(0,), (1,), (2,), (7,)]


def test_collapse(spark):
    three = [(H, "1"), (AI, "a"), (H, "2"), (H, "3"), (H, SYN), (AI, "b")]
    four = [(H, "1"), (AI, "a"), (H, "2"), (H, "3"), (AI, "llama", ["web_search"]), (H, "4"), (H, SYN)]
    no_answer = [(H, str(i)) for i in range(5)]
    m = messages(spark, three, four, no_answer)
    previous = spark.createDataFrame([("t1", "antes"), ("t0", "no")], "thread_id string, summary string")
    runs = spark.createDataFrame([("t1", 1, "r1"), ("t1", 2, "r2")], "thread_id string, seq bigint, summary string")
    got = {r.thread_id: r.summary for r in M.collapse_conversation(m, runs, previous).collect()}
    assert got == {"t1": f"antes\nhuman: 1\nhuman: 2\nhuman: 3\nai: llama\nhuman: {SYN}\nTurno: r1\nTurno: r2"}
    short = {r.thread_id: r.summary for r in M.collapse_conversation(m, runs, previous, limit=20).collect()}
    assert short == {"t1": got["t1"][:20]}
    left = M.collapsed_messages(m)
    assert rows(left.filter("thread_id = 't1'"), "seq") == [(1,), (5,)]
    assert left.filter("thread_id = 't0'").count() == 6 and left.filter("thread_id = 't2'").count() == 5


def test_planner_context(spark):
    m = messages(
        spark,
        [(H, "q"), ("system", K.SUMMARY_PREFIX + " s"), (AI, "a")],
        [(AI, "1"), (AI, "2" * 400), (AI, ""), (AI, "llama", ["web_search"]), (AI, "3")],
        [(H, "q")],
    )
    assert "2" * 400 in {r.thread_id: r.context for r in M.planner_context(m).collect()}["t1"]
    got = {r.thread_id: r.context for r in M.planner_context(m, 300).collect()}
    assert got["t0"] == f"{K.PREVIOUS_SUMMARY}{K.SUMMARY_PREFIX} s"
    assert got["t1"] == f"{K.PREVIOUS_ANSWERS}\n  - {'2' * 300}\n  - 3"
    assert got["t2"] == K.NO_CONVERSATION


def test_next_step(spark):
    search = (TOOL, "docs", "web_search")
    m = messages(
        spark,
        [(H, "q"), (AI, "", ["web_search"])],
        [(H, "q"), (AI, "tool_code: x")],
        [(H, "q"), search, (AI, "default_api.x")],
        [(H, "q"), search, (AI, " ")],
        [(H, "q"), search, (AI, "")],
        [(H, "q"), (AI, "\n")],
        [(H, "q"), search, (AI, "texto")],
        [(H, "q"), search, (H, "otra"), (AI, "texto")],
        [(H, "q"), search, (H, SYN), (AI, "texto")],
    )
    state = turns(spark, [(n, 0, 0, 0, None) for n in (0, 1, 2, 1, 2, 0, 0, 0, 0)])
    got = {r.thread_id: (r.step, r.reason) for r in A.next_step(m, state).collect()}
    grade, clean = "grade_generation_vs_documents", "cleanup_rag_memory"
    assert got == {
        "t0": ("tools", "tool_calls"), "t1": ("agent", "tool_code"), "t2": (grade, "searched"),
        "t3": ("agent", "no_synthesis"), "t4": (clean, "empty"), "t5": (clean, "empty"), "t6": (grade, "searched"),
        "t7": (clean, "plain"), "t8": (grade, "searched"),
    }


def test_triage(spark):
    m = messages(
        spark,
        [(AI, ""), (TOOL, "ok", "web_search")],
        [(AI, ""), (TOOL, "x ERROR_TOOL: y", "web_search")],
        [(AI, ""), (TOOL, "ERROR_TOOL: y", "knowledge_base_retriever"), (TOOL, "ok", "web_search")],
        [(AI, ""), (TOOL, "No encontré nada", "web_search")],
        [(TOOL, "ok", "web_search"), (AI, ""), (TOOL, "nota", "save_note_to_knowledge_base")],
    )
    state = turns(spark, [(0, n, 0, 0, None) for n in (0, 0, 1, 1, 0)])
    got = {r.thread_id: (r.outcome, r.retrieve_retry_count, r.route) for r in A.triage_search_output(m, state).collect()}
    assert got == {
        "t0": ("grade", 0, "agent"), "t1": ("retry", 1, "rewrite_query"), "t2": ("give_up", 2, "agent"),
        "t3": ("no_results", 1, "rewrite_query"), "t4": ("skip", 0, "agent"),
    }
    assert {r.thread_id: r.step for r in A.route_after_tools(m).collect()}["t4"] == "agent"


def test_groundedness(spark):
    def thread(answer):
        return [(H, "q"), (TOOL, "uno dos tres cuatro", "web_search"), (AI, answer)]

    m = messages(spark, thread("uno dos tres otro"), thread("a b c uno"), thread("a b c"), thread("???"), thread("!!"),
                 [(H, "q"), (AI, "uno")])
    state = turns(spark, [(0, 0, 0, 0, None), (0, 0, 0, 0, None), (1, 0, 0, 0, None), (0, 0, 0, 1, None), (0, 0, 0, 2, None), (0, 0, 0, 0, None)])
    got = {r.thread_id: (r.share, r.action) for r in A.grade_groundedness(m, state).collect()}
    assert got == {
        "t0": (0.75, "accept"), "t1": (0.25, "retry"), "t2": (0.0, "refuse"), "t3": (None, "regrade"), "t4": (None, "accept"),
    }


def test_plan(spark):
    step = lambda tool, done=False: (tool, "r", done)
    m = messages(
        spark,
        [(H, "q"), (TOOL, "sal\nida" + "x" * 200, "web_search"), (AI, "No encontré información")],
        [(H, "q"), (AI, "No encontré información")],
        [(H, "q"), (AI, "No encontré información")],
        [(H, "q"), (AI, "hola")],
    )
    state = turns(
        spark,
        [(0, 0, 0, 0, [step("web_search"), step("save_note_to_knowledge_base", True)]), (1, 0, 0, 0, [step("web_search"), step("x")]),
         (2, 0, 0, 0, [step("web_search")]), (0, 0, 0, 0, [])],
    )
    got = {r.thread_id: (r.verdict, r.pending) for r in A.plan_completion(m, state).collect()}
    assert got == {"t0": ("ok", ""), "t1": ("retry", "web_search, x"), "t2": ("give_up", "web_search"), "t3": ("ok", "")}
    snippets = {r.thread_id: r.snippet for r in A.used_tools(m, 100).collect()}
    assert snippets == {"t0": "sal ida" + "x" * 93}
    declined = {r.thread_id: (r.declined, r.nudge) for r in A.declined_without_search(m, state).collect()}
    assert declined == {"t0": (False, False), "t1": (True, True), "t2": (True, False), "t3": (False, False)}


def test_retry_counters_are_capped_per_turn(spark):
    data = [("t", 1, "generate")] * 3 + [("t", 2, "retrieve")]
    got = rows(A.retry_counters(spark.createDataFrame(data, "thread_id string, turn int, kind string")))
    assert got == [("t", 1, 0, 2, 0, 0), ("t", 2, 1, 0, 0, 0)]


# --- frames ------------------------------------------------------------------

EVENT = "turn_id string, seq bigint, ts timestamp, event string, name string, is_generation boolean, content string, data string"


def events(spark, turn):
    return spark.createDataFrame(
        [("a", i, T0 + dt.timedelta(seconds=i), event, name, gen, content, data) for i, (event, name, gen, content, data) in enumerate(turn)],
        EVENT,
    )


START, STREAM = "on_chat_model_start", "on_chat_model_stream"


def test_frames(spark):
    turn = [
        ("on_chain_end", "task_planner", False, None, "[]"),
        (START, "m", True, None, None),
        (STREAM, "m", True, "Ho", None),
        (STREAM, "m", False, "hidden", None),
        (START, "m", False, None, None),
        (START, "m", True, None, None),  # restart after text
        (STREAM, "m", True, " ", None),
        (START, "m", True, None, None),  # restart after blanks only
        (STREAM, "m", True, "fin", None),
        ("on_tool_start", "web_search", False, None, '{"q":1}'),
        ("on_tool_end", "web_search", False, None, "x"),
        ("on_chain_start", "grade_documents", False, None, None),
        ("on_chain_start", "agent", False, None, None),
    ]
    e = events(spark, turn)
    frames = FR.frames_from_events(e)
    got = [(r.seq, r.type, r.content, r.data, r.input) for r in frames.orderBy("seq").collect()]
    assert got == [
        (0, "plan", None, "[]", None), (2, "token", "Ho", None, None), (5, "status", K.CORRECTION_NOTICE, None, None),
        (6, "token", " ", None, None), (8, "token", "fin", None, None), (9, "tool-start", None, "web_search", '{"q":1}'),
        (10, "tool-end", None, "web_search", None), (11, "status", K.GRADING_NOTICE, None, None),
    ]
    assert FR.assemble_answer(e).first().answer == "fin"
    latency = FR.turn_latency(frames).first()
    assert (latency.first_token_seconds, latency.total_seconds) == (2.0, 11.0)
    again = FR.parse_frames(FR.frame_lines(frames)).orderBy("seq").collect()
    assert [(r.type, r.content, r.data) for r in again] == [(t, c, d) for _, t, c, d, _ in got]


def test_parse_frames_skips_noise(spark):
    lines = [
        (1, 'data: {"type":"token","content":"a"}'), (2, "event: x"), (3, "data: {broken"), (4, 'data: {"type":"plan","data":[{"tool":"x"}]}'),
        (5, ""), (6, "data: []"),
    ]
    got = FR.parse_frames(spark.createDataFrame(lines, "n int, line string"))
    assert rows(got, "n", "type", "data") == [(1, "token", None), (4, "plan", '[{"tool":"x"}]')]


def test_flatten_content(spark):
    df = spark.createDataFrame([('["a",{"text":"b"}]',), ("plain",), ("[not json",)], "c string")
    assert [r[0] for r in df.select(FR.flatten_content(F.col("c"))).collect()] == ["ab", "plain", "[not json"]


# --- chats, pages, feedback --------------------------------------------------

def test_chats(spark):
    t = spark.createDataFrame(
        [("a", "u", "x" * 51, T0, 1), ("a", "u", "later", T0, 2), ("b", None, "y" * 50, T0, 1), ("c", "u", "z", T0, 1)],
        "thread_id string, user_id string, message string, ts timestamp, seq int",
    )
    known = spark.createDataFrame([("c", "u", "old", T0, T0)], "thread_id string, user_id string, title string, created_at timestamp, updated_at timestamp")
    assert rows(C.create_chats(t, known), "thread_id", "user_id", "title") == [
        ("a", "u", "x" * 50 + "..."), ("b", "anonymous", "y" * 50), ("c", "u", "old"),
    ]


def test_web_results(spark):
    r = spark.createDataFrame(
        [(1, 0, "T", "http://a", "s0"), (1, 1, None, None, "A" * 1200), (1, 2, "U", "http://c", None), (1, 3, "V", "http://a", "s3"), (1, 4, "W", "l", "no")],
        "query_id int, position int, title string, link string, snippet string",
    )
    texts = spark.createDataFrame([("http://a", "página"), ("http://c", "")], "url string, text string")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {x.query_id: x.answer for x in P.assemble_results(r, texts, q, 800).collect()}
    items = got[1].removeprefix(K.WEB_HEADER).split("\n\n")
    assert items[0] == "- Título: T\n  URL: http://a\n  Contenido: [CONTENIDO EXTRAÍDO DE LA PÁGINA]: página..."
    assert items[1] == f"- Título: Sin título\n  URL: #\n  Contenido: [SNIPPET RESUMEN]: {'A' * 800}..."
    assert items[2].endswith("[SNIPPET RESUMEN]: ...") and items[3].endswith("[SNIPPET RESUMEN]: s3...") and len(items) == 4
    assert got[2] == K.WEB_NOTHING


def test_golden_export(spark):
    f = spark.createDataFrame(
        [("1", 1, None, "a", None), ("2", -1, "q", None, "fix"), ("3", -1, "q", "a", None), ("4", 0, "q", "a", "x")],
        "id string, score int, user_prompt string, ai_response string, user_correction string",
    )
    assert rows(FB.export_golden(f)) == [("N/A", "a", "a", "positive"), ("q", "N/A", "(Corregido) fix", "correction")]


# --- evaluation --------------------------------------------------------------

def test_final_answer(spark):
    m = messages(
        spark,
        [(AI, "viejo"), (AI, " texto ### Fuentes\n- x **Fuentes**"), (AI, "[Pensamiento] no"), (AI, " ")],
        [(AI, "a Fuentes: b")],
        [(AI, "Fuentes: solo")],
        [(H, "q")],
    )
    got = {r.thread_id: r.answer for r in E.final_answer(m).collect()}
    assert got == {"t0": "texto", "t1": "a", "t2": K.NO_ANSWER, "t3": K.NO_ANSWER}


def test_contexts(spark):
    m = messages(
        spark,
        [(TOOL, " uno ", "web_search"), (TOOL, "ERROR x", "web_search"), (TOOL, "uno", "knowledge_base_retriever"), (TOOL, "nota", "other"),
         (TOOL, "No encontré", "web_search"), (TOOL, "dos", "web_search")],
        [(H, "q")],
    )
    assert rows(E.retrieval_contexts(m)) == [("t0", 0, "uno"), ("t0", 5, "dos"), ("t1", 0, K.NO_CONTEXT)]


def test_scores(spark):
    hits = spark.createDataFrame(
        [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "query_id int, rank int, relevant boolean"
    )
    got = {r.query_id: r.contextual_precision for r in E.contextual_precision(hits).collect()}
    assert got == {1: round((1 + 2 / 3) / 2, 9), 2: 0.0}
    made = spark.createDataFrame([("c", 0, "uno dos"), ("c", 1, "tres")], "case_id string, chunk_no int, content string")
    golden = spark.createDataFrame([("c", ["uno dos tres", "tres", "nada"])], "case_id string, ideal_chunks array<string>")
    assert E.chunk_quality(made, golden).first().chunk_quality == round((2 / 3 + 1 + 0) / 3, 9)
    cases = spark.createDataFrame([("a", "x y", "x y"), ("b", "x", "z"), ("c", None, "z")], "thread_id string, question string, answer string")
    assert rows(E.answer_relevancy(cases)) == [("a", 1.0), ("b", 0.0), ("c", 0.0)]


def test_gates(spark):
    scores = spark.createDataFrame(
        [("a", "faithfulness", 0.85), ("a", "coherence", 0.69), ("b", "coherence", 0.7), ("b", "unknown", 0.0)],
        "case_id string, metric string, score double",
    )
    assert rows(E.case_verdict(E.threshold_gate(scores))) == [("a", False), ("b", True)]
    assert E.threshold_gate(scores, {"coherence": 0.5}).filter("passed").count() == 2
    worse = scores.withColumn("score", F.col("score") - F.when(F.col("case_id") == "a", 0.04).otherwise(0.06))
    got = rows(E.regression_gate(worse, scores), "case_id", "metric", "passed")
    assert got == [("a", "coherence", True), ("a", "faithfulness", True), ("b", "coherence", False), ("b", "unknown", False)]


def test_k_respected(spark):
    h = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 5, "a"), (2, 2, "a"), (2, 2, "b"), (2, 2, "c")], "query_id int, k int, source string")
    assert rows(E.k_respected(h)) == [(1, 2, 2, True, True), (1, 5, 1, True, False), (2, 2, 3, False, True)]
