"""The size checks behind every broadcast and the prefilter behind exact
sampling are part of the plan; these tests pin them."""

from pyspark.sql import functions as F

from tesserae.operators import sampling as M


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark, n=2000, parts=4):
    return spark.range(n).select(F.col("id").alias("doc_id"),
                                 F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"),
                                 (F.col("id") % 3).cast("string").alias("lang")).repartition(parts)


def test_overlap_audit_broadcasts_only_under_its_bound(spark):
    d = _docs(spark)
    ev, tr = d.filter("doc_id < 100"), d.filter("doc_id >= 100")
    small = M.overlap_audit(ev, tr, "text", "lang")
    big = M.overlap_audit(ev, tr, "text", "lang", broadcast_max_rows=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastExchange" in _plan(small)
        assert "BroadcastExchange" not in _plan(big)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sample_top_n_reads_only_prefiltered_candidates(spark):
    d = _docs(spark, 5000)
    s = M.sample_n(d, 20, "doc_id", 42)
    p = _plan(s)
    assert "TakeOrderedAndProject" in p and "conv(substring(" in p      # prefix filter below the top-n
    got = sorted(r[0] for r in s.collect())
    want = sorted(r[0] for r in M.seeded_key(d, "doc_id", 42).orderBy(M.KEY, "doc_id").limit(20).collect())
    assert got == want


def test_index_offsets_bounded_by_partitions(spark):
    d = _docs(spark, 3000, 6)
    idx, n = M.with_index(d, ["doc_id"], "i", num_partitions=5)
    assert n == 3000 and idx.agg(F.max("i")).first()[0] == 2999
