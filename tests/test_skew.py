"""Hot-key building blocks against brute force, and the plans that split hot keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import percentiles
from lorewell.operators import skew as S
from lorewell.operators.percentiles import exact_percentiles


@pytest.fixture(scope="module")
def hot(spark):
    """A third and more of the rows share one key."""
    rng = random.Random(5)
    data = [("hot" if i % 5 < 3 else f"k{i % 7}", i, rng.randint(0, 9)) for i in range(3000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, seq bigint, v bigint"), data


def by_key(data):
    groups = {}
    for k, seq, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(k, []).append((seq, v))
    return groups


@pytest.mark.parametrize("block", [7, 100, 8192])
def test_running_total(hot, block):
    df, data = hot
    got = {(r.k, r.seq): r.t for r in S.running_total(df, ["k"], "seq", F.col("v"), "t", block).collect()}
    for k, items in by_key(data).items():
        total = 0
        for seq, v in items:
            total += v
            assert got[k, seq] == total
    assert len(got) == len(data)


def test_next_value(hot):
    df, data = hot
    result = S.next_value(df, ["k"], ["seq"], F.floor(F.col("seq") / 50), "v", "n")
    got = {(r.k, r.seq): r.n for r in result.collect()}
    for k, items in by_key(data).items():
        for (seq, _), following in zip(items, [*items[1:], None]):
            assert got[k, seq] == (following[1] if following else None)


def test_next_value_keeps_null_values(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 300, 7)], "k string, seq int, v int")
    result = S.next_value(df, ["k"], ["seq"], F.floor(F.col("seq") / 100), "v", "n")
    assert {r.seq: r.n for r in result.collect()} == {1: None, 2: 7, 300: None}


def test_ordered_concat(hot):
    df, data = hot
    got = {r.k: r.t for r in S.ordered_concat(df, ["k"], "seq", F.col("v").cast("string"), ",", "t", 64).collect()}
    assert got == {k: ",".join(str(v) for _, v in items) for k, items in by_key(data).items()}


def test_lookup_is_null_safe_and_keeps_rows(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, k string")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, x int")
    assert sorted((r.id, r.x) for r in S.lookup(left, right, ["k"]).collect()) == [(1, 10), (2, 20), (3, None)]
    assert sorted(r.id for r in S.lookup(left, right, ["k"], "inner").collect()) == [1, 2]


def test_lookup_splits_a_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 200000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        per_key = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = S.lookup(rows, per_key, ["k"])
        joined.write.format("noop").mode("overwrite").save()
        counted = joined.groupBy().agg(F.count("n").alias("n"))
        assert counted.first().n == 200000
        total = joined.select(F.sum(F.length("payload")))
        total.collect()
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_top_per_key_limits_before_the_shuffle(hot):
    df, data = hot
    top = S.top_per_key(df, ["k"], [F.col("v").desc(), F.col("seq")], 3, "rank")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    got = {}
    for r in top.collect():
        got.setdefault(r.k, {})[r["rank"]] = r.seq
    for k, items in by_key(data).items():
        best = sorted(items, key=lambda x: (-x[1], x[0]))[:3]
        assert [got[k][i + 1] for i in range(3)] == [seq for seq, _ in best]


def test_exact_percentiles(spark):
    rng = random.Random(11)
    data = [("hot", float(rng.choice([1, 2, 2, 2, 50, 50.5, 1000]))) for _ in range(501)]
    data += [("one", 7.0), ("none", None)] + [("few", float(x)) for x in (3, 1, 2, 10)]
    fractions = {"p0": 0.0, "p50": 0.5, "p66": 0.66, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "x", fractions).collect()}
    assert "none" not in got
    for k in ("hot", "one", "few"):
        values = sorted(x for key, x in data if key == k)
        for name, f in fractions.items():
            at = f * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert math.isclose(got[k][name], low + (high - low) * (at - math.floor(at)), rel_tol=1e-9), (k, name)


def crowded(spark):
    """99 % of a key's values lie within one unit, the others reach up to 2e8 and below zero; a NULL key has the same values."""
    v = F.when(F.col("id") % 100 == 0, (F.col("id") - 50_000) * 1000.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(200_003)) / 1e6)
    return spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), v.alias("v"))


def test_percentile_ranges_follow_crowded_values(spark):
    counts = percentiles.counts_by_range(crowded(spark), ["k"], "v", [0.5, 0.95]).collect()
    for key in ("a", None):
        mine = sorted((r["__v"], r["__n"], r["__b"]) for r in counts if r["k"] == key)
        total, by_range, upto = sum(n for _, n, _ in mine), {}, 0
        assert [b for *_, b in mine] == sorted(b for *_, b in mine)
        for _, n, b in mine:
            by_range[b] = by_range.get(b, 0) + n
        assert total == 100_000 and max(by_range.values()) < 1.2 * total / percentiles.EVEN
        for _, n, b in mine:
            if upto <= total // 2 < upto + n:
                assert by_range[b] <= 6 * percentiles.ERROR * total + 2
            upto += n


def test_exact_percentiles_of_crowded_values(spark):
    fractions = {"p50": 0.5, "p95": 0.95, "p999": 0.999}
    df = crowded(spark)
    rows = df.collect()
    for r in exact_percentiles(df, ["k"], "v", fractions).collect():
        values = sorted(x.v for x in rows if x.k == r.k)
        for name, f in fractions.items():
            at = f * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert math.isclose(r[name], low + (high - low) * (at - math.floor(at)), rel_tol=1e-9), (r.k, name)
