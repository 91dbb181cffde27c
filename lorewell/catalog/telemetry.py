"""Telemetry queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.catalog import views as V
from lorewell.functions import dates as D
from lorewell.operators import telemetry as T

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


def _exported(spark, d):
    return T.runs_in_range(V.runs(spark, d), F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp"))


@query
def runs_in_range(spark, d):
    return _exported(spark, d)


_EXPORTED = f"""exported AS (SELECT run_id, name, start_time, coalesce(round((epoch_us(end_time) - epoch_us(start_time)) / 1000, 2), 0) AS latency_ms, status,
  coalesce(user_id, 'N/A') AS user_id, coalesce(thread_id, 'N/A') AS thread_id, coalesce(test_type, 'load_test') AS test_type,
  coalesce(array_to_string(tags, ', '), '') AS tags, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens,
  coalesce(total_tokens, 0) AS total_tokens, coalesce(total_cost, 0) AS total_cost FROM v_runs
  WHERE is_root AND start_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}')"""
SQL["runs_in_range"] = V.with_views("v_runs", f"WITH {_EXPORTED} SELECT * FROM exported ORDER BY start_time DESC, run_id")


@query
def run_totals(spark, d):
    return T.run_totals(_exported(spark, d))


SQL["run_totals"] = V.with_views(
    "v_runs",
    f"WITH {_EXPORTED} SELECT count(*) AS runs, round(sum(total_cost), 4) AS total_cost, round(avg(latency_ms), 2) AS mean_latency_ms FROM exported",
)


@query
def parse_time_bound(spark, d):
    """Event times written in full, as a clock time, or as something else."""
    n, ts = F.col("event_id"), F.col("ts")
    text = (
        F.when(n % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(n % 4 == 1, F.date_format(ts, "HH:mm:ss"))
        .when(n % 4 == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise("25:61:00")
    )
    e = V.event_times(spark, d).select("event_id", text.alias("text"))
    return e.select("event_id", "text", D.time_bound(F.col("text"), F.lit("2026-04-07").cast("date")).alias("bound"))


SQL["parse_time_bound"] = """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%H:%M:%S')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE '25:61:00' END AS text FROM events)
SELECT event_id, text, coalesce(try_strptime(text, '%Y-%m-%d %H:%M:%S'), try_strptime('2026-04-07 ' || text, '%Y-%m-%d %H:%M:%S')) AS bound FROM e"""


@query
def documents_processed(spark, d):
    outcomes = V.jobs(spark, d).select(
        "status", F.col("source_path").alias("filename"), F.when(F.col("attempts") > 1, "orchestration").alias("phase"),
        F.when(F.col("user_id") == "en", "kafka").alias("source"),
    )
    return T.documents_processed(outcomes)


SQL["documents_processed"] = V.with_views(
    "v_jobs",
    """SELECT status, CASE WHEN contains(source_path, '.') THEN string_split(source_path, '.')[-1] ELSE 'unknown' END AS file_type,
  CASE WHEN attempts > 1 THEN 'orchestration' END AS phase, CASE WHEN user_id = 'en' THEN 'kafka' END AS source, count(*) AS documents
FROM v_jobs GROUP BY ALL""",
)


def _durations(spark, d):
    return V.table(spark, d, "events").select(F.col("event_type").alias("file_type"), F.col("value").alias("seconds"))


@query
def extraction_histogram(spark, d):
    return T.extraction_histogram(_durations(spark, d))


SQL["extraction_histogram"] = f"""WITH b AS (SELECT unnest({V.sql_list([str(x) for x in T.HISTOGRAM_BOUNDS] + ['+Inf'])}) AS le,
  unnest([{', '.join(f'{x}::DOUBLE' for x in T.HISTOGRAM_BOUNDS)}, 'inf'::DOUBLE]) AS bound)
SELECT event_type AS file_type, le, count(*) FILTER (WHERE value <= bound) AS observations FROM events, b GROUP BY event_type, le"""


@query
def extraction_p95(spark, d):
    return T.extraction_p95(_durations(spark, d)).withColumn("p95", F.round("p95", 6))


SQL["extraction_p95"] = "SELECT event_type AS file_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"


@query
def token_usage(spark, d):
    """Events as model calls with one or two generations, reporting usage in different places."""
    k = V.prop_k()
    usage = lambda on, a, b, c: F.when(
        on, F.struct(a.alias("total"), b.alias("input"), c.alias("output"))
    )
    response = lambda on, a, b, c: F.when(
        on, F.struct(a.alias("total"), b.alias("prompt"), c.alias("completion"))
    )
    first = F.struct(
        usage(k % 3 != 0, k * 3, k, k * 2).alias("usage"),
        F.when(k % 5 != 0, F.concat(F.lit("resp-"), "event_type")).alias("response_model"),
        response(k % 2 == 0, k * 7, k * 5, k * 2).alias("response_usage"),
    )
    second = F.struct(
        usage(k % 7 == 0, k + 1, k, F.lit(1).cast("bigint")).alias("usage"),
        F.lit("second").alias("response_model"),
        response(k % 11 == 0, k + 2, k + 1, F.lit(1).cast("bigint")).alias("response_usage"),
    )
    calls = V.table(spark, d, "events").select(
        F.when(k % 6 == 0, F.col("event_type")).alias("model_name"),
        F.when(k % 13 == 0, F.lit(5).cast("bigint")).alias("llm_total"),
        F.when(k % 4 == 0, F.array(first)).otherwise(F.array(first, second)).alias("generations"),
    )
    return T.token_usage(calls)


SQL["token_usage"] = f"""WITH e AS (SELECT event_type, {V.SQL_K} AS k FROM events),
g AS (SELECT *, k % 3 <> 0 AS u1, k % 2 = 0 AS r1, k % 4 <> 0 AS two, k % 4 <> 0 AND k % 7 = 0 AS u2, k % 4 <> 0 AND k % 7 <> 0 AND k % 11 = 0 AS r2 FROM e),
c AS (SELECT coalesce(CASE WHEN k % 6 = 0 THEN event_type END, CASE WHEN NOT u1 AND k % 5 <> 0 THEN 'resp-' || event_type END,
    CASE WHEN two AND NOT u2 THEN 'second' END, 'unknown') AS model,
  CASE WHEN u2 THEN k + 1 WHEN r2 THEN k + 2 WHEN u1 THEN k * 3 WHEN r1 THEN k * 7 WHEN k % 13 = 0 THEN 5 ELSE 0 END AS total,
  CASE WHEN u1 THEN k WHEN r1 THEN k * 5 ELSE 0 END + CASE WHEN u2 THEN k WHEN r2 THEN k + 1 ELSE 0 END AS input,
  CASE WHEN u1 THEN k * 2 WHEN r1 THEN k * 2 ELSE 0 END + CASE WHEN u2 THEN 1 WHEN r2 THEN 1 ELSE 0 END AS output FROM g)
SELECT model, CAST(sum(total) AS BIGINT) AS total_tokens, CAST(sum(input) AS BIGINT) AS input_tokens, CAST(sum(output) AS BIGINT) AS output_tokens
FROM c GROUP BY model"""


@query
def latency_report(spark, d):
    requests = V.event_times(spark, d).select(
        F.when(F.col("event_type") == "error", "SSE").otherwise("POST").alias("type"),
        F.concat(F.lit("/"), "event_type").alias("name"), "ts", F.col("value").alias("response_ms"),
        (V.prop_k() % 10 == 0).alias("failed"),
    )
    return T.latency_report(requests)


_P = ", ".join(f"round(quantile_cont(value, {f}), 6) AS {n}" for n, f in T.REPORT_PERCENTILES.items())
_REPORT = f"""count(*) AS requests, count(*) FILTER (WHERE failed) AS failures, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms,
  round(count(*) / max(span), 6) AS requests_per_second, round(count(*) FILTER (WHERE failed) / max(span), 6) AS failures_per_second,
  round(median(value), 6) AS median_ms, {_P}"""
SQL["latency_report"] = f"""WITH r AS (SELECT *, {V.SQL_K} % 10 = 0 AS failed,
   (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 FROM events) AS span FROM events)
SELECT CASE WHEN event_type = 'error' THEN 'SSE' ELSE 'POST' END AS type, '/' || event_type AS name, {_REPORT} FROM r GROUP BY event_type
UNION ALL SELECT '', 'Aggregated', {_REPORT} FROM r"""


@query
def success_rate(spark, d):
    tasks = V.event_times(spark, d).select("ts", (F.col("event_type") != "error").alias("succeeded"))
    return T.success_rate(tasks)


SQL["success_rate"] = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
  count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type <> 'error') / count(*) * 100, 6) AS success_pct
FROM events GROUP BY 1"""


@query
def ingestion_latency(spark, d):
    return T.ingestion_latency(V.jobs(spark, d))


SQL["ingestion_latency"] = V.with_views(
    "v_jobs",
    """SELECT user_id, round(avg((epoch_us(updated_at) - epoch_us(created_at)) / 1000000), 6) AS avg_seconds,
  max((epoch_us(updated_at) - epoch_us(created_at)) / 1000000) AS max_seconds FROM v_jobs WHERE status = 'indexed' GROUP BY user_id""",
)


@query
def generation_rate(spark, d):
    turns = V.table(spark, d, "events").select(
        "event_id", (V.prop_k() * 3).alias("total_tokens"), F.col("value").alias("total_seconds"),
        F.when(F.col("event_id") % 5 == 0, F.col("value")).otherwise(F.col("value") / 4).alias("first_token_seconds"),
    )
    return T.generation_rate(turns).select("event_id", "tokens_per_second")


SQL["generation_rate"] = f"""SELECT event_id, round(CAST({V.SQL_K} * 3 AS DOUBLE) /
  nullif(value - CASE WHEN event_id % 5 = 0 THEN value ELSE value / 4 END, 0), 6) AS tokens_per_second FROM events"""


@query
def compare_runs(spark, d):
    """The first half of the month against the second, one metric per event type."""
    run = F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second")
    metrics = V.event_times(spark, d).groupBy(run.alias("run"), F.col("event_type").alias("metric")).agg(
        F.round(F.sum("value"), 2).alias("value")
    )
    return T.compare_runs(metrics, "first", "second")


SQL["compare_runs"] = """WITH m AS (SELECT event_type AS metric, round(sum(value) FILTER (WHERE day(ts) <= 15), 2) AS value_before,
  round(sum(value) FILTER (WHERE day(ts) > 15), 2) AS value_after FROM events GROUP BY event_type)
SELECT *, round(value_after / value_before, 6) AS ratio FROM m"""


@query
def stage_duration(spark, d):
    return T.stage_duration(V.job_events(spark, d))


SQL["stage_duration"] = V.with_views(
    "v_job_events",
    """SELECT doc_id, status, ts, seq, (epoch_us(lead(ts) OVER (PARTITION BY doc_id ORDER BY ts, seq)) - epoch_us(ts)) / 1000000 AS seconds
FROM v_job_events""",
)
