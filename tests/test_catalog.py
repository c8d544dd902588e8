"""Registered queries against their SQL, and rules every registration keeps."""

import pytest

import __spark_entry__ as registry
from check import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_equivalent_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[0] == "rating_range" and df.count() > 0


def test_no_cross_joins_or_python_in_relational_queries(spark, sf_dir):
    names = ["resolve_script_files", "skip_reason", "tfidf", "standard_scale", "sample_weights", "expand_duplicates", "text_features"]
    for name in names:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
            assert operator not in plan, (name, operator)
