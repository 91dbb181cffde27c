"""Admission, jobs, index maintenance, files, sinks and the chunk store on small fixtures."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorewell.operators import admission as A
from lorewell.operators import indexing as I
from lorewell.sources import files, sinks, tables

T0 = dt.datetime(2026, 1, 1)


def test_size_limit_is_inclusive(spark):
    df = spark.createDataFrame([("a.txt", 10), ("b.TXT", 11), ("c.exe", 1), (".env", 1), ("d", 0)], "filename string, length bigint")
    checked = {r.filename: r.error for r in A.validate_files(df, max_bytes=10).collect()}
    assert checked["a.txt"] is None
    assert "tamaño máximo" in checked["b.TXT"]
    assert checked["c.exe"].startswith("Extensión no permitida: .exe. Permitidas: ['.pdf'")
    assert checked[".env"].startswith("Extensión no permitida: . Permitidas") and checked["d"] is not None


def decide(spark, uploads, jobs):
    u = spark.createDataFrame(uploads, "arrival int, user_id string, file_hash string, new_doc_id string")
    j = spark.createDataFrame(jobs, "doc_id string, user_id string, file_hash string, status string, created_at timestamp")
    return {r.arrival: (r.decision, r.doc_id) for r in A.dedup_decision(u, j).collect()}


def test_dedup_decision(spark):
    jobs = [
        ("j1", "u", "h1", "queued", T0), ("j2", "u", "h2", "failed", T0), ("j3", "u", "h3", "indexed", T0),
        ("j4", None, "h4", "processing", T0),
        # two matches: skip beats retry
        ("j5", "u", "h5", "dead", T0), ("j6", "u", "h5", "succeeded", T0 + dt.timedelta(1)),
    ]
    uploads = [
        (1, "u", "h1", "n1"), (2, "u", "h2", "n2"), (3, "u", "h2", "n3"), (4, "u", "h3", "n4"), (5, "u", "h3", "n5"),
        (6, None, "h4", "n6"), (7, "v", "h1", "n7"), (8, "u", "h5", "n8"), (9, "u", None, "n9"), (10, "u", None, "n10"),
        (11, "w", "h9", "n11"), (12, "w", "h9", "n12"),
    ]
    got = decide(spark, uploads, jobs)
    assert got == {
        1: ("already_exists", "j1"), 2: ("queued", "j2"), 3: ("already_exists", "j2"), 4: ("queued", "n4"),
        5: ("already_exists", "n4"), 6: ("already_exists", "j4"), 7: ("queued", "n7"), 8: ("already_exists", "j6"),
        9: ("queued", "n9"), 10: ("queued", "n10"), 11: ("queued", "n11"), 12: ("already_exists", "n11"),
    }


def test_skip_statuses_option(spark):
    u = spark.createDataFrame([(1, "u", "h", "n")], "arrival int, user_id string, file_hash string, new_doc_id string")
    j = spark.createDataFrame([("j", "u", "h", "indexed", T0)], "doc_id string, user_id string, file_hash string, status string, created_at timestamp")
    got = A.dedup_decision(u, j, skip_statuses=["queued", "processing", "succeeded", "indexed"]).first()
    assert (got.decision, got.doc_id) == ("already_exists", "j")


def test_fold_status(spark):
    events = spark.createDataFrame(
        [
            ("a", "failed", "x", T0, 1), ("a", "failed", "y", T0, 2), ("a", "indexed", None, T0, 3),
            ("b", "failed", "z", T0, 1), ("ghost", "queued", None, T0, 1),
        ],
        "doc_id string, status string, error_msg string, ts timestamp, seq int",
    )
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert rows(A.fold_status(events, jobs), "doc_id", "status", "error_msg", "attempts") == [
        ("a", "indexed", None, 2), ("b", "failed", "z", 1),
    ]


def test_dead_letter_threshold(spark):
    for n, status in ((10, "ok"), (11, "warning"), (0, "ok")):
        assert A.dead_letter_health(spark.range(n)).first().status == status


def test_batch_outcome(spark):
    df = spark.createDataFrame([("a", None), ("a", "e"), ("b", None), ("c", "e")], "batch_id string, error string")
    assert rows(A.batch_outcome(df), "batch_id", "status") == [("a", "partial_success"), ("b", "success"), ("c", "failed")]
    jobs = spark.createDataFrame([("d1", "x", "queued"), ("d2", "y", "indexed")], "doc_id string, batch_id string, status string")
    assert rows(A.batch_status(jobs, "y")) == [("d2", "indexed")]


def test_user_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "jobs")
    spark.createDataFrame(
        [("d", "u", "s", "queued", T0, "h")],
        "doc_id string, user_id string, source_path string, status string, created_at timestamp, file_hash string",
    ).write.parquet(path)
    plan = A.list_user_documents(spark.read.parquet(path), "u")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,u)" in plan


# --- index -------------------------------------------------------------------

def chunks(spark, data):
    return spark.createDataFrame(data, "source string, user_id string, chunk_index bigint, content string").withColumn(
        "chunk_key", I.chunk_key(F.col("content"), F.col("source"), F.col("chunk_index"))
    )


V1 = [("a", "u", 0, "uno"), ("a", "u", 1, "dos"), ("b", "u", 0, "tres"), ("c", "v", 0, "cuatro")]
V2 = [("a", "u", 0, "uno"), ("a", "u", 1, "DOS"), ("d", "v", 0, "cinco")]
AFTER = sorted([("a", "u", 0, "uno"), ("a", "u", 1, "DOS"), ("b", "u", 0, "tres"), ("c", "v", 0, "cuatro"), ("d", "v", 0, "cinco")])
COLUMNS = ["source", "user_id", "chunk_index", "content"]


def test_index_diff(spark):
    old, new = chunks(spark, V1), chunks(spark, V2)
    diff = I.index_diff(new, old)
    assert I.diff_counts(diff).first().asDict() == {"num_added": 2, "num_skipped": 1, "num_deleted": 1}
    result = I.apply_diff(new, old, diff)
    assert rows(result, *COLUMNS) == AFTER
    again = I.diff_counts(I.index_diff(new, result)).first().asDict()
    assert again == {"num_added": 0, "num_skipped": 3, "num_deleted": 0}


def test_diff_does_not_read_contents(spark, tmp_path):
    path = str(tmp_path / "c")
    chunks(spark, V1).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = I.index_diff(stored, stored)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_chunk_store(spark, tmp_path):
    store = sinks.ChunkStore(str(tmp_path / "store"), user_buckets=4, source_buckets=2)
    schema = chunks(spark, V1).schema
    assert store.read(spark, schema).count() == 0
    assert store.update(chunks(spark, V1), 0) == {"num_added": 4, "num_skipped": 0, "num_deleted": 0}
    assert store.update(chunks(spark, V2), 1) == {"num_added": 2, "num_skipped": 1, "num_deleted": 1}
    assert rows(store.read(spark, schema), *COLUMNS) == AFTER
    assert rows(store.read(spark, schema, users=["v"]), "source") == [("c",), ("d",)]
    assert store.holds(spark, 1) and not store.holds(spark, 2)
    # the same batch again changes nothing and publishes nothing
    assert store.update(chunks(spark, V2), 2) == {"num_added": 0, "num_skipped": 3, "num_deleted": 0}
    assert not store.holds(spark, 2)


def files_of(base, version):
    return {p.name: p.stat().st_size for p in base.rglob("*.parquet") if f"version={version}/" in str(p)}


def test_store_user_change_delete_compact(spark, tmp_path):
    base = tmp_path / "store"
    store = sinks.ChunkStore(str(base), user_buckets=4, source_buckets=4)
    schema = chunks(spark, V1).schema
    store.write(chunks(spark, V1 * 2), 0)  # equal rows are stored once
    assert rows(store.read(spark, schema), *COLUMNS) == sorted(V1)
    moved = [("a", "w", 0, "uno"), ("a", "w", 1, "dos")]
    assert store.update(chunks(spark, moved), 1) == {"num_added": 2, "num_skipped": 0, "num_deleted": 2}
    assert rows(store.read(spark, schema), *COLUMNS) == sorted([*moved, *V1[2:]])
    assert rows(store.read(spark, schema, users=["u"]), *COLUMNS) == [V1[2]]
    gone = spark.createDataFrame([("b",), ("nothing",)], "source string")
    assert store.delete(gone, schema, 2) == 1 and store.delete(gone, schema, 3) == 0
    assert rows(store.read(spark, schema), *COLUMNS) == sorted([*moved, V1[3]])
    assert store.update(chunks(spark, [V1[2]]), 4)["num_added"] == 1  # a removed chunk may come back
    wider = sinks.ChunkStore(str(base), user_buckets=8, source_buckets=2)
    before = rows(store.read(spark, schema))
    assert wider.update(chunks(spark, [V1[2], ("b", "u", 1, "más")]), 5) == {"num_added": 1, "num_skipped": 1, "num_deleted": 0}
    assert len(rows(wider.read(spark, schema))) == len(before) + 1
    before = rows(wider.read(spark, schema))
    wider.compact(spark, schema, 6)
    assert [r["version"] for r in wider.current(spark)] == [6] and rows(wider.read(spark, schema)) == before
    assert wider.vacuum(spark) == [0, 1, 2, 4, 5] and rows(store.read(spark, schema)) == before


def test_update_writes_in_proportion_to_the_batch(spark, tmp_path):
    base = tmp_path / "store"
    store = sinks.ChunkStore(str(base))
    many = [(f"s{i}", f"u{i % 9}", k, f"texto {i} {k} " * 20) for i in range(400) for k in range(5)]
    store.write(chunks(spark, many), 0)
    store.update(chunks(spark, [("s7", "u7", k, f"nuevo {k}") for k in range(5)]), 1)
    assert sum(files_of(base, 1).values()) < sum(files_of(base, 0).values()) / 5
    assert len(rows(store.read(spark, chunks(spark, V1).schema))) == len(many)


def test_records_and_deletion(spark):
    batches = spark.createDataFrame(
        [("n", ["k1", "k2"], ["g1", "g2"], 100.0, 250.0), ("n", ["k3"], None, 100.0, None)],
        "namespace string, keys array<string>, group_ids array<string>, now double, time_at_least double",
    )
    updates = I.record_rows(batches)
    old = spark.createDataFrame([("k1", "n", "old", 5.0), ("k9", "n", "g1", 6.0)], "key string, namespace string, group_id string, updated_at double")
    records = I.upsert_records(old, updates)
    assert rows(records) == [("k1", "n", "g1", 250.0), ("k2", "n", "g2", 250.0), ("k3", "n", None, 100.0), ("k9", "n", "g1", 6.0)]
    ids = spark.createDataFrame([("g1",), ("nothing",)], "doc_id string")
    store = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k9", "z")], "chunk_key string, content string")
    deletion = I.delete_documents(ids, store, records, F.lit(T0))
    assert rows(deletion.chunks, "chunk_key") == [("k2",)]
    assert rows(deletion.records, "key") == [("k2",)] or rows(deletion.records, "key") == [("k2",), ("k3",)]
    assert rows(deletion.events, "doc_id", "status") == [
        ("g1", "deleted"), ("g1", "deleting"), ("nothing", "deleted"), ("nothing", "deleting"),
    ]
    kept = I.wipe_documents(ids, store, records, F.lit(T0), "g1")
    assert rows(kept.chunks, "chunk_key") == [("k1",), ("k2",), ("k9",)]


def test_unequal_lists_are_rejected(spark):
    bad = spark.createDataFrame(
        [("n", ["k1", "k2"], ["g1"], 1.0, None)],
        "namespace string, keys array<string>, group_ids array<string>, now double, time_at_least double",
    )
    with pytest.raises(PySparkException):
        I.record_rows(bad).collect()


def test_cache(spark):
    cache = spark.createDataFrame([("a", "x", 99), ("b", "y", 100), ("c", "z", 101), ("d", "w", None)], "cache_key string, value string, expires_at bigint")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "cache_key string")
    got = {r.cache_key: (r.hit, r.value) for r in I.cache_lookup(asked, cache, F.lit(100.9)).collect()}
    assert got == {"a": (False, None), "b": (True, "y"), "c": (True, "z"), "d": (True, "w"), "e": (False, None)}
    put = I.cache_put(spark.createDataFrame([("k", "v")], "cache_key string, value string"), F.lit(10.7))
    assert put.first().expires_at == 3610


def test_embedding_has_unit_length(spark):
    texts = spark.createDataFrame([("gato negro",), ("perro blanco",), ("",)], "content string")
    made = I.embed(texts, I.fit_embedder(texts, dims=64))
    lengths = sorted(sum(x * x for x in r.embedding) for r in made.collect())
    assert lengths[0] == 0 and all(abs(x - 1) < 1e-5 for x in lengths[1:])
    assert made.columns == ["content", "embedding"]


def test_counted_words_are_not_counted_again(spark):
    texts = spark.createDataFrame([(1, "gato negro gato"), (2, "perro blanco"), (3, "")], "id int, content string")
    counted = spark.createDataFrame(I.count_words(texts, dims=64).collect(), I.count_words(texts, dims=64).schema)
    blank = counted.withColumn("content", F.lit("otro"))  # the text itself is not looked at
    plain = I.embed(texts, I.fit_embedder(texts, dims=64))
    made = I.embed(blank, I.fit_embedder(blank, dims=64))
    assert made.columns == plain.columns and rows(made, "id", "embedding") == rows(plain, "id", "embedding")
    again = I.embed(texts, I.fit_embedder(counted, dims=64))  # questions come as texts
    assert rows(again, "id", "embedding") == rows(plain, "id", "embedding")


# --- files -------------------------------------------------------------------

def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hola")
    (tmp_path / "sub" / "b.MD").write_bytes(b"# x")
    (tmp_path / "empty.txt").write_bytes(b"")  # Spark's file sources leave out files without bytes
    found = files.scan_files(spark, str(tmp_path))
    assert rows(found, "filename", "length") == [("a.txt", 4), ("b.MD", 3)]
    assert rows(files.scan_files(spark, str(tmp_path), "*.txt"), "filename") == [("a.txt",)]
    batch = files.scan_batch(spark, [str(tmp_path)], "u1", "2026-01-02", "b1")
    assert rows(batch, "user_id", "document_date", "batch_id") == [("u1", "2026-01-02", "b1")] * 2
    hashed = batch.select(A.content_hash(F.col("content")).alias("h"))
    assert all(len(r.h) == 64 for r in hashed.collect())


def test_scan_tables_and_golden(spark, tmp_path):
    from lorewell import schemas

    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    found = tables.scan_tables(spark, str(tmp_path))
    assert set(found) == {"jobs", "chats", "messages", "feedback", "records"} and found["jobs"].count() == 0
    with pytest.raises(ValueError, match="jobs"):
        tables.scan_tables(spark, "jdbc:none", {"": {"driver": "none"}})
    case = tmp_path / "golden.json"
    case.write_text('[{"name": "t", "category": "general", "raw_text": "x", "ideal_chunks": ["x", "y"], "eval_query": "q", "expected_answer": "a"}]')
    assert tables.scan_golden(spark, str(case)).first().ideal_chunks == ["x", "y"]


def test_csv_report_is_newest_first(spark, tmp_path):
    from lorewell.schemas import RUN_COLUMNS

    data = [("r1", T0), ("r2", T0 + dt.timedelta(hours=1))]
    df = spark.createDataFrame(data, "run_id string, start_time timestamp")
    for name in RUN_COLUMNS.values():
        if name not in df.columns:
            df = df.withColumn(name, F.lit("1" if "token" in name or name in ("latency_ms", "total_cost") else "a, b"))
    path = str(tmp_path / "report")
    sinks.write_csv_report(df.coalesce(1), path)
    lines = spark.read.text(path).collect()
    assert lines[0][0].startswith("Run ID,Name,Start Time") and lines[1][0].startswith("r2")
    assert tables.scan_runs(spark, path).first().tags == "a, b"


def test_repeated_chunks_alone_are_shuffled_with_their_text(spark, tmp_path):
    schema = "chunk_key string, user_id string, source string, chunk_index bigint, content string"
    store = sinks.ChunkStore(str(tmp_path / "s"), 2, 2)
    first = [("a", "u", "s1", 0, "one"), ("a", "u", "s1", 0, "one"), ("a", None, "s1", 0, "one"), ("b", "u", "s2", 1, "two")]
    assert store.update(spark.createDataFrame(first, schema), 0) == {"num_added": 3, "num_skipped": 0, "num_deleted": 0}
    again = [("b", "u", "s2", 1, "two"), ("c", "u", "s2", 2, "x"), ("c", "u", "s2", 0, "y")]
    assert store.update(spark.createDataFrame(again, schema), 1) == {"num_added": 1, "num_skipped": 1, "num_deleted": 0}
    wanted = [("a", "u", "one"), ("a", None, "one"), ("b", "u", "two"), ("c", "u", "y")]
    assert rows(store.read(spark, schema), "chunk_key", "user_id", "content") == sorted(wanted, key=repr)
    plain = sinks._stored_unique(spark.createDataFrame(first[2:], schema).withColumn("owner", sinks._owner()), "plain")
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
