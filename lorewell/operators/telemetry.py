"""Reports over trace runs, jobs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import metric_file_type
from lorewell.operators.percentiles import exact_percentiles
from lorewell.operators.skew import lookup
from lorewell.operators.skew import next_value

# Default bucket bounds of the histogram, and the percentiles of the latency report.
HISTOGRAM_BOUNDS = [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]
REPORT_PERCENTILES = {
    "p50": 0.5, "p66": 0.66, "p75": 0.75, "p80": 0.8, "p90": 0.9, "p95": 0.95,
    "p98": 0.98, "p99": 0.99, "p999": 0.999, "p9999": 0.9999, "p100": 1.0,
}


def runs_in_range(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Root runs started within both bounds, with defaults filled in, newest first."""
    latency = F.round((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000, 2)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        runs.filter(F.col("is_root") & F.col("start_time").between(start, end))
        .select(
            "run_id", "name", "start_time",
            F.coalesce(latency, F.lit(0.0)).alias("latency_ms"),
            "status",
            F.coalesce("user_id", F.lit("N/A")).alias("user_id"),
            F.coalesce("thread_id", F.lit("N/A")).alias("thread_id"),
            F.coalesce("test_type", F.lit("load_test")).alias("test_type"),
            F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"),
            zero("prompt_tokens").alias("prompt_tokens"),
            zero("completion_tokens").alias("completion_tokens"),
            zero("total_tokens").alias("total_tokens"),
            F.coalesce(F.col("total_cost").cast("double"), F.lit(0.0)).alias("total_cost"),
        )
        .orderBy(F.col("start_time").desc(), "run_id")
    )


def run_totals(exported: DataFrame) -> DataFrame:
    """Number of runs, summed cost and mean latency."""
    return exported.agg(
        F.count("*").alias("runs"),
        F.round(F.sum("total_cost"), 4).alias("total_cost"),
        F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"),
    )


def documents_processed(outcomes: DataFrame) -> DataFrame:
    """Counter of processed documents by status, file type, phase and source."""
    return (
        outcomes.withColumn("file_type", metric_file_type(F.col("filename")))
        .groupBy("status", "file_type", "phase", "source")
        .agg(F.count("*").alias("documents"))
    )


def extraction_histogram(durations: DataFrame, bounds: list[float] = HISTOGRAM_BOUNDS) -> DataFrame:
    """(file_type, le, observations): cumulative counts per bucket bound, the last bucket unbounded."""
    counted = durations.groupBy("file_type").agg(
        *[F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("seconds").alias("inf")
    )
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return counted.select("file_type", F.explode(F.array(*buckets)).alias("x")).select(
        "file_type", "x.le", F.col("x.n").alias("observations")
    )


def extraction_p95(durations: DataFrame) -> DataFrame:
    """95th percentile of the extraction seconds per file type."""
    return exact_percentiles(durations, ["file_type"], "seconds", {"p95": 0.95})


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens per model from model calls.

    `calls`: model_name, llm_total, generations ARRAY<STRUCT<usage STRUCT<total, input, output>,
    response_model, response_usage STRUCT<total, prompt, completion>>>. A generation's own usage counts
    before the response's; input and output are summed, the total is the last one seen; only positive
    numbers count.
    """
    g = F.col("generations")
    own = lambda x: x["usage"].isNotNull()
    total_of = lambda x: F.when(own(x), F.coalesce(x["usage"]["total"], F.lit(0))).when(
        x["response_usage"].isNotNull(), F.coalesce(x["response_usage"]["total"], F.lit(0))
    )
    input_of = lambda x: F.coalesce(
        F.when(own(x), x["usage"]["input"]).otherwise(x["response_usage"]["prompt"]), F.lit(0)
    )
    output_of = lambda x: F.coalesce(
        F.when(own(x), x["usage"]["output"]).otherwise(x["response_usage"]["completion"]), F.lit(0)
    )
    add = lambda of: F.aggregate(F.transform(g, of), F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    seen = F.filter(F.transform(g, total_of), lambda n: n.isNotNull())
    named = F.filter(F.transform(F.filter(g, lambda x: ~own(x)), lambda x: x["response_model"]), lambda m: m.isNotNull())
    per_call = calls.select(
        F.coalesce("model_name", F.try_element_at(named, F.lit(1)), F.lit("unknown")).alias("model"),
        F.coalesce(F.try_element_at(seen, F.lit(-1)), "llm_total", F.lit(0)).alias("total"),
        F.coalesce(add(input_of), F.lit(0)).alias("input"),
        F.coalesce(add(output_of), F.lit(0)).alias("output"),
    )
    positive = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0))
    return per_call.groupBy("model").agg(
        positive("total").alias("total_tokens"), positive("input").alias("input_tokens"), positive("output").alias("output_tokens")
    )


def latency_report(requests: DataFrame) -> DataFrame:
    """Load report per (type, name) plus the `Aggregated` row, from rows (type, name, ts, response_ms, failed).

    Counts, median, mean, extremes, rates over the whole span and percentiles.
    """
    # each request counts for its endpoint and for the aggregated row; both are combined before the shuffle
    span = F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, F.lit(1e-6))
    seconds = requests.agg(span).scalar()
    rows = requests.select(
        F.explode(
            F.array(
                F.struct(F.col("type"), F.col("name")),
                F.struct(F.lit("").alias("type"), F.lit("Aggregated").alias("name")),
            )
        ).alias("k"),
        "response_ms", "failed",
    ).select("k.*", "response_ms", "failed")
    stats = rows.groupBy("type", "name").agg(
        F.count("*").alias("requests"),
        F.count_if("failed").alias("failures"),
        F.round(F.avg("response_ms"), 6).alias("mean_ms"),
        F.min("response_ms").alias("min_ms"),
        F.max("response_ms").alias("max_ms"),
    )
    rates = [F.round(F.col(c) / seconds, 6).alias(f"{c}_per_second") for c in ("requests", "failures")]
    stats = stats.select("*", *rates)
    points = exact_percentiles(rows, ["type", "name"], "response_ms", REPORT_PERCENTILES)
    rounded = [F.round(c, 6).alias(c) for c in REPORT_PERCENTILES]
    return lookup(stats, points, ["type", "name"]).select(
        *stats.columns, F.round("p50", 6).alias("median_ms"), *rounded
    )


def success_rate(tasks: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Percentage of succeeded tasks per time window, from rows (ts, succeeded). Batch and streaming."""
    counted = tasks.groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed")
    )
    rate = F.col("succeeded") / (F.col("succeeded") + F.col("failed")) * 100
    return counted.select(
        F.col("w.start").alias("window_start"), "succeeded", "failed", F.round(rate, 6).alias("success_pct")
    )


def ingestion_latency(jobs: DataFrame, finished: str = "indexed") -> DataFrame:
    """Mean and greatest seconds from creation to last update of finished jobs, per user."""
    seconds = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1e6
    return (
        jobs.filter(F.col("status") == finished)
        .groupBy("user_id")
        .agg(F.round(F.avg(seconds), 6).alias("avg_seconds"), F.max(seconds).alias("max_seconds"))
    )


def generation_rate(turns: DataFrame) -> DataFrame:
    """Tokens per second after the first token; NULL when no time passed."""
    rate = F.try_divide(F.col("total_tokens").cast("double"), F.col("total_seconds") - F.col("first_token_seconds"))
    return turns.withColumn("tokens_per_second", F.round(rate, 6))


def compare_runs(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """Metrics (run, metric, value) of two runs side by side with their ratio."""
    sides = metrics.groupBy("metric").pivot("run", [before, after]).agg(F.max("value"))
    return sides.select(
        "metric", F.col(before).alias("value_before"), F.col(after).alias("value_after"),
        F.round(F.try_divide(F.col(after), F.col(before)), 6).alias("ratio"),
    )


def stage_duration(events: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """(doc_id, status, ts, seq, seconds): how long each status lasted; NULL for the current one."""
    block = F.floor(F.unix_seconds("ts") / block_seconds)
    followed = next_value(events, ["doc_id"], ["ts", "seq"], block, "ts", "next_ts")
    seconds = (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6
    return followed.select("doc_id", "status", "ts", "seq", seconds.alias("seconds"))
