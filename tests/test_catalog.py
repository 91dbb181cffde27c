"""Every registered query against its SQL on the small shared tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    result = QUERIES[name](spark, SF)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    verdict, _ = compare(result, con, SQL[name])
    assert verdict == "ok", verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "context"]
    contexts = [r["context"] for r in result.collect()]
    assert len(contexts) == 40 and all(contexts)
    assert any(c.startswith("Fuente: [") for c in contexts)
