"""Plan assertions: no Python in the relational queries, top-k pruning,
no single-partition exchange for the global index, pruning at the scan."""

import pytest

import __spark_entry__ as E

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PYTHON_QUERIES = {"generate_responses", "compare_models", "timing", "resume_anti", "failure_accounting",
                  "incremental_generate", "stream_generate", "compare_models_legs", "evaluate_batched", "generation_params",
                  "timing_batches", "resume_chunks", "stream_retry", "json_array_round_trip"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - PYTHON_QUERIES))
def test_no_python_in_relational_queries(spark, sf001, name):
    p = plan(E.queries()[name](spark, sf001))
    assert not any(n in p for n in PYTHON_NODES), name


def test_window_group_limit(spark, sf001):
    for name in ("capped_eval", "log_tail", "representative_sample"):
        df = E.queries()[name](spark, sf001)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            assert "WindowGroupLimit" in plan(df), name
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_global_index_has_no_single_partition(spark, sf001):
    p = plan(E.queries()["seeded_shuffle"](spark, sf001))
    assert "SinglePartition" not in p


def test_scan_pruning(spark, sf001):
    df = E.queries()["numeric_accuracy"](spark, sf001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in p
