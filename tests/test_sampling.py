import pytest
from pyspark.sql import functions as F

from tesserae.operators import sampling as M


def ids_df(spark, n, parts=4):
    return spark.range(n).withColumnRenamed("id", "doc_id").repartition(parts)


@pytest.mark.parametrize("n,k", [(3164, 316), (5000, 350), (10, 1), (9, 0)])
def test_eval_size(n, k):
    assert M.eval_size(n) == k


@pytest.mark.parametrize("n", [9, 10, 3164])
def test_split_is_a_partition(spark, n):
    df = ids_df(spark, n)
    ev, tr = M.train_eval_split(df, "doc_id", 42)
    e = {r[0] for r in ev.collect()}
    t = {r[0] for r in tr.collect()}
    assert len(e) == M.eval_size(n)
    assert not (e & t) and len(e | t) == n


def test_sample_exact_and_partition_independent(spark):
    base = None
    for parts in (1, 3, 17):
        got = sorted(r[0] for r in M.sample_n(ids_df(spark, 500, parts), 37, "doc_id", 7).collect())
        assert len(got) == 37
        base = base or got
        assert got == base
    assert M.sample_n(ids_df(spark, 5), 10, "doc_id").count() == 5


def test_with_index_dense_and_ordered(spark):
    df = ids_df(spark, 1000, 7)
    idx, n = M.with_index(M.seeded_key(df, "doc_id", 1), [M.KEY, "doc_id"], "i", num_partitions=5)
    r = idx.select("i", M.KEY).orderBy("i").collect()
    assert n == 1000 and [x[0] for x in r] == list(range(1000))
    keys = [x[1] for x in r]
    assert keys == sorted(keys)


def test_shuffle_permutation_independent_of_layout(spark):
    a = {r[0]: r[1] for r in M.seeded_shuffle(ids_df(spark, 300, 2), "doc_id").collect()}
    b = {r[0]: r[1] for r in M.seeded_shuffle(ids_df(spark, 300, 9), "doc_id").collect()}
    assert a == b and sorted(a.values()) == list(range(300))


def _domain_df(spark, sizes):
    rows, seq = [], 0
    for d, n in sizes:
        for _ in range(n):
            rows.append((seq, d))
            seq += 1
    return spark.createDataFrame(rows, "doc_id long, domain string")


@pytest.mark.parametrize("sizes,quotas", [
    ([("a", 200), ("b", 100), ("c", 50)], {"a": 4, "b": 3, "c": 3}),
    ([("a", 1), ("b", 9), ("c", 9)], {"a": 1, "b": 3, "c": 3}),
])
def test_representative_quotas(spark, sizes, quotas):
    df = _domain_df(spark, sizes)
    got = M.representative_sample(df, 10, "domain", "doc_id", "doc_id").groupBy("domain").count().collect()
    assert {r[0]: r[1] for r in got} == quotas


def test_representative_empty_and_null_domain(spark):
    empty = spark.createDataFrame([], "doc_id long, domain string")
    assert M.representative_sample(empty, 10, "domain", "doc_id", "doc_id").count() == 0
    df = spark.createDataFrame([(0, None), (1, "x")], "doc_id long, domain string")
    assert M.representative_sample(df, 2, "domain", "doc_id", "doc_id").count() == 2


def test_capped_eval_caps(spark):
    df = _domain_df(spark, [("math", 300), ("code", 30), ("aiops", 150), ("other", 5)])
    out = M.capped_eval_sample(df, "domain", {"math": 200, "code": 50, "aiops": 100}, "doc_id")
    assert {r[0]: r[1] for r in out.groupBy("domain").count().collect()} == {"math": 200, "code": 30, "aiops": 100}


@pytest.mark.parametrize("n,k,expected", [(10, 3, [3, 3, 4]), (2, 4, [0, 0, 0, 2]), (9, 3, [3, 3, 3])])
def test_shards(spark, n, k, expected):
    out = M.assign_shards(ids_df(spark, n, 2), ["doc_id"], k, 4)
    counts = {r[0]: r[1] for r in out.groupBy("shard_id").count().collect()}
    assert [counts.get(i, 0) for i in range(k)] == expected


def test_batches(spark):
    out = M.assign_batches(ids_df(spark, 10, 3), ["doc_id"], 4).orderBy("doc_id")
    assert [r[0] for r in out.select("batch_id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_overlap_audit(spark):
    ev = spark.createDataFrame([(1, " Hello "), (2, "x")], "id long, text string")
    tr = spark.createDataFrame([(9, "hello")], "id long, text string")
    r = M.overlap_audit(ev, tr, "text").first()
    assert (r["n_eval"], r["n_overlap"]) == (2, 1)


def test_mode_sample(spark):
    df = _domain_df(spark, [("a", 100), ("b", 100)])
    assert M.mode_sample(df, "quick", "domain", "doc_id", "doc_id").count() == 10
    assert M.mode_sample(df, "medium", "domain", "doc_id", "doc_id").count() == 50
    assert M.mode_sample(df, "full", "domain", "doc_id", "doc_id").count() == 200
    with pytest.raises(ValueError):
        M.mode_sample(df, "huge", "domain", "doc_id", "doc_id")


def test_seeded_index_matches_generic_index(spark):
    keyed = M.seeded_key(ids_df(spark, 777, 5), "doc_id", 3)
    a, n1 = M.seeded_index(keyed, "doc_id", "i", num_partitions=3)
    b, n2 = M.with_index(keyed, [M.KEY, "doc_id"], "i", num_partitions=6)
    assert n1 == n2 == 777
    assert dict(a.select("doc_id", "i").collect()) == dict(b.select("doc_id", "i").collect())


def test_large_sample_path(spark, monkeypatch):
    monkeypatch.setattr(M, "TAKE_ORDERED_MAX", 10)
    df = ids_df(spark, 400, 4)
    got = sorted(r[0] for r in M.sample_n(df, 57, "doc_id", 5).collect())
    monkeypatch.setattr(M, "TAKE_ORDERED_MAX", 100_000)
    want = sorted(r[0] for r in M.sample_n(df, 57, "doc_id", 5).collect())
    assert got == want and len(got) == 57


def test_seeded_index_broadcast_offsets(spark):
    keyed = M.seeded_key(ids_df(spark, 300, 3), "doc_id", 9)
    got, _ = M.seeded_index(keyed, "doc_id", "i", num_partitions=4)
    order = [r["doc_id"] for r in keyed.orderBy(M.KEY, "doc_id").collect()]
    assert {r["doc_id"]: r["i"] for r in got.collect()} == {d: i for i, d in enumerate(order)}


def test_exclude_eval_from_train(spark):
    df = _domain_df(spark, [("math", 300), ("code", 30)])
    ev = M.capped_eval_sample(df, "domain", {"math": 200, "code": 50}, "doc_id", exclude_from_train=True)
    assert ev.filter("exclude_from_train").count() == 230
    train = M.exclude_eval_from_train(df, ev, "doc_id")
    assert train.count() == 100 and train.join(ev, "doc_id", "inner").count() == 0


@pytest.mark.parametrize("ids", [[1, 2, None], [1, 2, 2]])
@pytest.mark.parametrize("split", [M.train_eval_split, M.label_split])
def test_split_refuses_null_and_repeated_ids(spark, ids, split):
    with pytest.raises(ValueError, match="null id|repeated"):
        split(spark.createDataFrame([(i,) for i in ids], "id long"), "id")


def test_split_is_the_same_beyond_the_switch(spark, monkeypatch):
    df = spark.range(500)
    want = {r["id"]: r["split"] for r in M.label_split(df, "id", cap=None).collect()}
    monkeypatch.setattr(M, "TAKE_ORDERED_MAX", 10)
    assert {r["id"]: r["split"] for r in M.label_split(df, "id", cap=None).collect()} == want
