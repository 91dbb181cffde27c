"""Streams: same result as the batch form, replays, retries, dead letters and late rows."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lorewell.functions.registry import register
from lorewell.functions import text as T
from lorewell.operators import admission as A
from lorewell.operators import telemetry as TL
from lorewell.schemas import MESSAGE
from lorewell.streaming import events as E
from lorewell.streaming import folds as FO
from lorewell.streaming import turns as TU
from lorewell.streaming.ingest import DocumentIngest
from lorewell.streaming.late import LateGate
from lorewell.streaming.tables import batch_writer, read_latest, run_to_end

T0 = dt.datetime(2026, 1, 1)
ID = "00000000-0000-0000-0000-00000000000%d"


def message(value, minute=0, retry=None, key="k"):
    headers = [] if retry is None else [{"key": "retry-count", "value": str(retry)}]
    return {
        "key": key, "value": value if isinstance(value, str) else json.dumps(value), "headers": headers,
        "timestamp": (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z",
    }


def event(doc, text, filename="a.txt", user="u", **more):
    return {"doc_id": doc, "filename": filename, "user_id": user, "content": text, **more}


def put(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages))


@pytest.fixture
def inbox(tmp_path):
    return tmp_path / "in"


def run(spark, inbox, out, checkpoint):
    job = DocumentIngest(str(out), user_buckets=2, source_buckets=2, clock=lambda: T0.replace(tzinfo=dt.UTC))  # no retry comes due
    stream = E.read_document_events(spark, str(inbox), max_files=1)
    job.start(stream, str(checkpoint)).awaitTermination()
    return job


def state(spark, job):
    jobs = rows(job.jobs(spark), "doc_id", "user_id", "status", "source_path")
    chunks = rows(job.chunks(spark), "source", "chunk_index", "content", "chunk_key")
    retry = rows(spark.read.schema(MESSAGE).json(job.retry_path), "value")
    dead = rows(spark.read.schema(MESSAGE).json(job.dead_path), "value")
    return jobs, chunks, retry, dead


def test_ingest_stream(spark, inbox, tmp_path):
    put(inbox, "1.json", [
        message(event(ID % 1, "El gato duerme. El gato come."), 0),
        message(event(ID % 2, "El gato duerme. El gato come."), 1),  # same content, same user
        message(event(ID % 3, "El gato duerme. El gato come.", user="v"), 2),
        message("{broken", 3), message("{broken", 4, retry=2), message("{broken3", 5, retry=3),
        message(event(ID % 4, "x", filename="a.exe"), 6, retry=7),
        message(event(None, "Nota sin id."), 7),
        message(event("no-uuid", "x"), 8),
    ])
    job = run(spark, inbox, tmp_path / "out", tmp_path / "cp")
    jobs, chunks, retry, dead = state(spark, job)
    assert [j[:3] for j in jobs if j[0].startswith("0000")] == [(ID % 1, "u", "queued"), (ID % 3, "v", "queued")]
    assert len(jobs) == 3
    assert {c[0] for c in chunks} == {j[0] for j in jobs}
    folded = A.fold_status(job.job_events(spark), job.jobs(spark))
    assert rows(folded, "status", "attempts") == [("indexed", 0)] * 3
    assert len(retry) == 3 and len(dead) == 2
    again = spark.read.schema(MESSAGE).json(job.retry_path).select("value", E.header("retry-count").alias("n"))
    assert rows(again.filter("value = '{broken'"), "n") == [("1",), ("3",)]
    letters = spark.read.schema(MESSAGE).json(job.dead_path)
    assert rows(letters, E.header("original-topic").alias("t")) == [("raw-documents",)] * 2
    assert all(r[0] for r in rows(letters, E.header("failed-at").alias("t")))

    # a second file: a replay and something new, with the same checkpoint
    put(inbox, "2.json", [message(event(ID % 1, "El gato duerme. El gato come."), 20), message(event(ID % 5, "Otro texto."), 21)])
    job = run(spark, inbox, tmp_path / "out", tmp_path / "cp")
    after = state(spark, job)
    assert len(after[0]) == 4 and {c[0] for c in after[1]} == {j[0] for j in after[0]}
    assert [c for c in after[1] if c[0] != ID % 5] == chunks

    # nothing new: nothing changes; and a new checkpoint over the same input gives the same tables
    assert state(spark, run(spark, inbox, tmp_path / "out", tmp_path / "cp")) == after
    fresh = state(spark, run(spark, inbox, tmp_path / "out2", tmp_path / "cp2"))
    assert fresh == after
    # the whole input replayed into the same tables leaves them as they are
    assert state(spark, run(spark, inbox, tmp_path / "out", tmp_path / "cp3")) == after


def test_half_finished_batch_can_run_again(spark, tmp_path):
    job = DocumentIngest(str(tmp_path / "out"), user_buckets=2, source_buckets=2)
    data = [message(event(ID % 1, "Uno. Dos."), 0), message("{", 1)]
    path = tmp_path / "m.json"
    path.write_text("\n".join(json.dumps(m) for m in data))
    messages = spark.read.schema(MESSAGE).json(str(path))
    job.process(messages, 0)
    first = state(spark, job)
    job.process(messages, 0)
    assert state(spark, job) == first


def test_changed_document_replaces_its_chunks(spark, inbox, tmp_path):
    put(inbox, "1.json", [message(event(ID % 1, "Primera versión."), 0)])
    put(inbox, "2.json", [message(event(ID % 1, "Segunda versión."), 9)])
    job = run(spark, inbox, tmp_path / "out", tmp_path / "cp")
    texts = [r.content for r in job.chunks(spark).collect()]
    assert len(texts) == 1 and texts[0].endswith("Segunda versión.")


def test_parse_defaults(spark):
    data = [message({"content": "x"}), message("[1]"), message("null"), message({"doc_id": "", "filename": None})]
    df = spark.read.schema(MESSAGE).json(spark.sparkContext.parallelize([json.dumps(m) for m in data]))
    got = rows(E.parse_document_events(df), "value", "filename", "error", F.length("doc_id").alias("n"), "retry_count")
    assert {(g[1], g[2], g[4]) for g in got if g[0].startswith("{")} == {("unknown_file", None, 0)}
    assert all(g[2] == "invalid JSON" for g in got if not g[0].startswith("{"))
    assert all(g[3] == 36 for g in got)


def test_dedup_within_watermark(spark, inbox, tmp_path):
    put(inbox, "1.json", [message(event(ID % 1, "a"), 0), message(event(ID % 1, "a"), 5), message(event(ID % 2, "b"), 600)])
    put(inbox, "2.json", [message(event(ID % 2, "b"), 610), message(event(ID % 3, "c"), 620)])
    parsed = E.parse_document_events(E.read_document_events(spark, str(inbox), max_files=1))
    out = str(tmp_path / "out")
    run_to_end(
        E.dedup_events(parsed, "1 hour").writeStream.format("parquet").option("path", out), str(tmp_path / "cp")
    )
    assert rows(spark.read.parquet(out), "doc_id") == [(ID % 1,), (ID % 2,), (ID % 3,)]


def test_late_rows_become_dead_letters(spark, tmp_path):
    job = DocumentIngest(str(tmp_path / "out"), user_buckets=2, source_buckets=2, allowed_delay_seconds=3600)

    def batch(number, *data):
        path = tmp_path / f"{number}.json"
        path.write_text("\n".join(json.dumps(m) for m in data))
        job.process(spark.read.schema(MESSAGE).json(str(path)), number)

    batch(0, message(event(ID % 1, "Uno."), 120))
    batch(1, message(event(ID % 2, "Dos."), 59), message(event(ID % 3, "Tres."), 60), message(event(ID % 4, "Cuatro."), 500))
    assert rows(job.jobs(spark), "doc_id") == [(ID % 1,), (ID % 3,), (ID % 4,)]
    letters = spark.read.schema(MESSAGE).json(job.dead_path)
    assert rows(letters, E.header("error").alias("e")) == [("late event",)]


STATUS = "doc_id string, status string, error_msg string, ts timestamp, seq bigint"


def test_status_stream_equals_batch(spark, tmp_path):
    data = [("a", "failed", "x", T0, 1), ("b", "queued", None, T0, 1), ("a", "failed", "y", T0, 2), ("a", "indexed", None, T0 + dt.timedelta(1), 1)]
    folder = str(tmp_path / "in")
    for part in (data[:2], data[2:3], data[3:]):
        spark.createDataFrame(part, STATUS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(folder)
    folded = FO.status_state(stream)
    out = str(tmp_path / "out")
    run_to_end(folded.writeStream.outputMode("update").foreachBatch(batch_writer(out)), str(tmp_path / "cp"))
    got = rows(read_latest(spark, out, folded.schema, ["doc_id"]))
    jobs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert got == rows(A.fold_status(spark.createDataFrame(data, STATUS), jobs))


def test_success_rate_windows(spark):
    data = [(T0, True), (T0 + dt.timedelta(minutes=4, seconds=59), False), (T0 + dt.timedelta(minutes=5), True)]
    df = spark.createDataFrame(data, "ts timestamp, succeeded boolean")
    assert [(r.succeeded, r.failed, r.success_pct) for r in TL.success_rate(df).orderBy("window_start").collect()] == [
        (1, 1, 50.0), (1, 0, 100.0),
    ]


def test_sql_names(spark):
    register(spark)
    df = spark.createDataFrame([(" Plan: ¡Ya!  b ", "```json\n{}\n```", "uno dos tres")], "t string, r string, x string")
    df.createOrReplaceTempView("names_test")
    made = spark.sql("SELECT slugify(t) AS s, strip_code_fence(r) AS f FROM names_test").first()
    assert (made.s, made.f) == (df.select(T.slugify(F.col("t"))).first()[0], "{}")
    pieces = spark.sql("SELECT position, content FROM names_test, LATERAL split_structured(x, 8, 0) ORDER BY position")
    assert [tuple(r) for r in pieces.collect()] == [(0, "uno dos"), (1, "tres")]


def test_events_by_reference(spark, inbox, tmp_path):
    objects = tmp_path / "objects"
    objects.mkdir()
    (objects / "u a.txt").write_text("Texto por referencia. Segunda frase.")
    by_name = lambda doc, name: {"doc_id": doc, "filename": "a.txt", "user_id": "u", "object_name": name}
    put(inbox, "1.json", [
        message(by_name(ID % 1, "u a.txt"), 0), message(by_name(ID % 2, "nothing.txt"), 1, retry=5),
        message(event(ID % 3, "   "), 2), message(event(ID % 4, "Texto propio."), 3),
    ])
    job = DocumentIngest(str(tmp_path / "out"), user_buckets=2, source_buckets=2, objects=str(objects))
    job.start(E.read_document_events(spark, str(inbox)), str(tmp_path / "cp")).awaitTermination()
    texts = {r.source: r.content for r in job.chunks(spark).collect()}
    assert set(texts) == {ID % 1, ID % 4} and "Texto por referencia." in texts[ID % 1]
    states = {r.doc_id: (r.status, r.error_msg) for r in job.job_events(spark).collect() if r.status not in ("received", "queued")}
    assert states[ID % 1] == ("indexed", None) and states[ID % 3] == ("failed", "no text to index")
    assert states[ID % 2] == ("dead", "FileNotFoundError: nothing.txt")


def test_retries_return_when_they_are_due(spark, inbox, tmp_path):
    objects = tmp_path / "objects"
    objects.mkdir()
    by_name = lambda doc, name: {"doc_id": doc, "filename": "a.txt", "user_id": "u", "object_name": name}
    put(inbox, "1.json", [
        message(by_name(ID % 1, "slow.txt"), 0), message(by_name(ID % 2, "never.txt"), 0), message(event(ID % 3, "Texto."), 500),
    ])
    time = [T0.replace(tzinfo=dt.UTC)]

    def step(seconds):
        time[0] += dt.timedelta(seconds=seconds)
        job = DocumentIngest(str(tmp_path / "out"), user_buckets=2, source_buckets=2, objects=str(objects),
                             allowed_delay_seconds=60, clock=lambda: time[0])
        job.start(E.read_document_events(spark, str(inbox)), str(tmp_path / "cp")).awaitTermination()
        last = job.job_events(spark).groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("s"))
        count = job.job_events(spark).filter("status = 'received'").groupBy("doc_id").count()
        return {r.doc_id[-1]: (r.s, r["count"]) for r in last.join(count, "doc_id").collect()}

    assert step(0) == {"1": ("failed", 1), "2": ("failed", 1), "3": ("indexed", 1)}
    assert step(59) == {"1": ("failed", 1), "2": ("failed", 1), "3": ("indexed", 1)}  # not due yet
    assert step(1) == {"1": ("failed", 2), "2": ("failed", 2), "3": ("indexed", 1)}
    (objects / "slow.txt").write_text("Ya está aquí.")
    assert step(119) == {"1": ("failed", 2), "2": ("failed", 2), "3": ("indexed", 1)}
    assert step(1) == {"1": ("indexed", 3), "2": ("failed", 3), "3": ("indexed", 1)}
    assert step(240) == {"1": ("indexed", 3), "2": ("dead", 4), "3": ("indexed", 1)}
    assert step(10_000)["2"] == ("dead", 4)


TIMED = "n int, ts timestamp"


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    gate = LateGate(str(tmp_path / "gate"), dt.timedelta(minutes=10))
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[(1, minute(0)), (2, minute(30))], [(3, minute(20)), (4, minute(19)), (5, None)], [], [(6, minute(31)), (7, minute(19))]]
    for number, data in enumerate(batches):
        for _ in range(2):  # every batch runs twice
            gate.process(spark.createDataFrame(data, TIMED), number)
    on_time = spark.read.parquet(gate.on_time_path)
    assert rows(on_time, "n") == [(1,), (2,), (3,), (5,), (6,)]
    assert rows(gate.late(spark, on_time.select("n", "ts").schema), "n", "batch") == [(4, 1), (7, 3)]
    assert rows(gate.counts(spark), "batch", "n", "n_late") == [(0, 2, 0), (1, 3, 1), (2, 0, 0), (3, 2, 1)]


def test_silent_turns_answer_once(spark, tmp_path):
    schema = "turn_id string, seq bigint, ts timestamp, event string, name string, is_generation boolean, content string, data string"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    say = lambda turn, seq, m, text: (turn, seq, at(m), "on_chat_model_stream", "model", True, text, None)
    start = lambda turn, seq, m: (turn, seq, at(m), "on_chat_model_start", "model", True, None, None)
    steps = [
        [start("a", 1, 0), say("a", 2, 1, "old "), start("b", 1, 1), say("b", 2, 2, '[{"text": "x"}, "y"]')],
        [start("a", 3, 5), say("a", 4, 6, "new "), say("b", 3, 100, "far")],  # b goes on: its timer moves
        [say("c", 1, 200, "later")],
        [say("a", 5, 7, "too late"), say("d", 1, 400, "end")],
        [say("d", 2, 900, "end")],
    ]
    for number, data in enumerate(steps):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = TU.live_turns(stream, "10 minutes", 1800).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        run_to_end(writer, str(tmp_path / "cp"))
    found = spark.read.schema(TU.FINISHED).parquet(str(tmp_path / "out"))
    wanted = [("a", "new ", 1), ("b", "xyfar", 2), ("c", "later", 1)]
    assert rows(found, "turn_id", "answer", "n_tokens") == wanted
    assert rows(found.filter("turn_id = 'a'"), "first_token_seconds", "total_seconds") == [(60.0, 360.0)]
    assert rows(TU.open_turns(spark, str(tmp_path / "cp")), "turn_id") == [("d",)]


def test_many_turns_share_few_states(spark, tmp_path):
    schema = "turn_id string, seq bigint, ts timestamp, event string, name string, is_generation boolean, content string, data string"
    say = lambda turn, seq, m: (turn, seq, T0 + dt.timedelta(minutes=m), "on_chat_model_stream", "model", True, f"{turn}.{seq} ", None)
    steps = [[say(f"t{n}", s, 40 * s + n % 7) for n in range(60) for s in (2, 1)], [say("t3", 3, 125), say("end", 1, 300)], [say("end", 2, 301)]]
    for data in steps:
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = TU.live_turns(stream, "10 minutes", 1800, buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        run_to_end(writer, str(tmp_path / "cp"))
    found = rows(spark.read.schema(TU.FINISHED).parquet(str(tmp_path / "out")), "turn_id", "answer", "n_tokens", "total_seconds")
    assert ("t3", "t3.1 t3.2 t3.3 ", 3, 82 * 60.0) in found and len(found) == 60
    assert ("t4", "t4.1 t4.2 ", 2, 40 * 60.0) in found
    assert spark.read.format("statestore").load(str(tmp_path / "cp")).count() <= 4
    assert rows(TU.open_turns(spark, str(tmp_path / "cp")), "turn_id") == [("end",)]
