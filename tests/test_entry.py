import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "exact_match" in df.columns


def test_every_query_has_oracle_or_is_declared_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) - set(E._optional()[0]) == set()  # those have tests of their own


def test_queries_run_on_smoke_data(spark, sf001):
    for name, fn in E.queries().items():
        if name in E._optional()[0]:
            continue
        df = fn(spark, sf001)
        assert df.count() >= 0, name
