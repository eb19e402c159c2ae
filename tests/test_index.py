"""The dense index over keys alone, content keys of rows without an id, and the two-level top rows."""

import re

import pytest
from pyspark.sql import functions as F

from tesserae.operators import reports as REP
from tesserae.operators import sampling as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_hold_keys_only(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for out in (M.with_index(df, ["doc_id"], "i")[0], M.assign_shards(df, ["doc_id"], 3, 7), M.assign_batches(df, ["doc_id"], 7)):
        pinned = re.findall(r"Scan ExistingRDD\[([^\]]*)\]", plan(out))
        assert pinned and all("text" not in columns for columns in pinned)
        assert "text" in out.columns and out.count() == 500


def test_index_of_the_keys_themselves_needs_no_join(spark):
    out, n = M.with_index(spark.range(99).withColumnRenamed("id", "doc_id"), ["doc_id"], "i", num_partitions=5)
    assert n == 99 and plan(out).count("Join") == 1  # the offsets'
    assert all(r["doc_id"] == r["i"] for r in out.collect())


@pytest.mark.parametrize("parts", [1, 6])
def test_index_of_repeated_and_null_keys_is_dense(spark, parts):
    rows = [(None, "a", 1), (None, "b", 2), (3, None, 3), (3, "x", 4), (3, "x", 5), (1, "q", 6), (3, "x", 5)] + [(7, "y", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, t string, v int").repartition(parts)
    out, n = M.with_index(df, ["k", "t"], "i", num_partitions=3)
    got = sorted(out.collect(), key=lambda r: r["i"])
    assert n == len(rows) and [r["i"] for r in got] == list(range(len(rows)))
    assert sorted((r["k"], r["t"], r["v"]) for r in got if r["k"]) == sorted((r for r in rows if r[0]), key=lambda r: r) \
        if all(r["t"] is not None for r in got) else len(got) == len(rows)
    order = [((r["k"] is not None, r["k"] or 0), (r["t"] is not None, r["t"] or "")) for r in got]
    assert order == sorted(order)
    again = {r["i"]: (r["k"], r["t"], r["v"]) for r in M.with_index(df.repartition(4), ["k", "t"], "i")[0].collect()}
    assert again == {r["i"]: (r["k"], r["t"], r["v"]) for r in got}  # no layout changes it


def test_index_of_an_empty_table(spark):
    out, n = M.with_index(spark.createDataFrame([], "k long, t string"), ["k"], "i")
    assert n == 0 and out.collect() == [] and out.columns == ["k", "t", "i"]


def test_rows_without_an_id_are_shuffled_and_drawn_like_others(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 20 != 0, F.col("id")).alias("doc_id"), F.col("id").alias("v")).repartition(5)
    ranks = M.seeded_shuffle(df, "doc_id", 42, "rank").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(4000))  # 200 of them have a null id
    assert sum(r["rank"] < 2000 for r in ranks if r["doc_id"] is None) in range(60, 140)
    drawn = M.sample_n(df, 1000, "doc_id", 42).collect()
    assert len(drawn) == 1000 and sum(r["doc_id"] is None for r in drawn) in range(25, 80)
    assert sorted(r["v"] for r in M.sample_n(df.repartition(9), 1000, "doc_id", 42).collect()) == sorted(r["v"] for r in drawn)
    assert M.sample_n(df, 5000, "doc_id").count() == 4000


def hot(spark):
    """Two thirds of the rows are of one group."""
    return spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"))


def test_top_rows_in_two_levels_are_exact(spark):
    df = hot(spark).repartition(7)
    for k in (1, 10, 1500):
        got = {(r["g"], r["id"], r["r"]) for r in M.top_per_group(df, ["g"], [F.desc("id")], k, "r", ["id"]).collect()}
        want = set()
        for g in {r["g"] for r in df.collect()}:
            ids = sorted((r["id"] for r in df.collect() if r["g"] == g), reverse=True)[:k]
            want |= {(g, x, i + 1) for i, x in enumerate(ids)}
        assert got == want


def test_a_hot_group_is_cut_down_by_many_tasks_first(spark):
    for out in (M.capped_eval_sample(hot(spark), "g", {"hot": 20}, "id"), REP.log_tail(hot(spark), "g", "id", 5),
                M.representative_sample(hot(spark), 60, "g", "id", "id")):
        p = plan(out)
        levels = re.findall(r"hashpartitioning\(([^)]*), \d+\)", p)
        assert any("_salt" in x for x in levels)
        salted = [x for x in p.split("\n") if "WindowGroupLimit" in x and "_salt" in x]
        assert salted  # cut down before and behind the exchange by (group, salt)


def test_quotas_beyond_the_local_bound_give_the_same_rows(spark, monkeypatch):
    want = sorted(tuple(r) for r in M.representative_sample(hot(spark), 60, "g", "id", "id").collect())
    monkeypatch.setattr(M, "MAX_LOCAL_DOMAINS", 2)
    assert sorted(tuple(r) for r in M.representative_sample(hot(spark), 60, "g", "id", "id").collect()) == want
