import pytest
from pyspark.sql import functions as F

from tesserae.functions import logits as LG
from tesserae.operators import logits as LO


def positions(spark):
    student = [[[1, 0, -1], [0, 2, 0]], [[.5, .5, 0], [3, 0, 0]]]
    teacher = [[[2, 0, -1], [0, 1, 0]], [[0, 1, 0], [1, 0, 0]]]
    labels = [[-100, 1], [0, 2]]
    mask = [[1, 1], [1, 0]]
    rows = []
    for s in range(2):
        for p in range(2):
            rows.append((0, s, p, [float(x) for x in teacher[s][p]], [float(x) for x in student[s][p]],
                         labels[s][p], mask[s][p]))
    return spark.createDataFrame(rows, "g int, seq int, pos int, t array<double>, s array<double>, "
                                       "label int, m int")


def test_loss_fixtures(spark):
    terms = LO.position_terms(positions(spark), "t", "s", "label", "m", 2.0)
    r = LO.kd_losses(terms, ["g"], "seq", 2.0, alpha=0.8).first()
    assert r["kl_masked"] == pytest.approx(0.106456, abs=1e-6)
    assert r["kl_unmasked"] == pytest.approx(0.206136, abs=1e-6)
    assert r["kl_per_sequence"] == pytest.approx(0.412272, abs=1e-6)
    assert r["ce"] == pytest.approx(1.430829, abs=1e-6)
    assert r["total"] == pytest.approx(0.371330, abs=1e-6)


def test_kl_zero_on_equal_logits_and_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(LG.kl_position("a", "b", 2.0), LG.array_sum(LG.softmax("a", 3.0))).first()
    assert abs(r[0]) < 1e-12 and r[1] == pytest.approx(1.0)


def test_no_valid_position_gives_zero(spark):
    df = positions(spark).withColumn("m", F.lit(0))
    terms = LO.position_terms(df, "t", "s", "label", "m", 2.0)
    assert LO.kd_losses(terms, ["g"], "seq").first()["kl_masked"] == 0.0


def test_top_k_and_offline(spark):
    df = spark.createDataFrame([(0, [0.1, 3.0, -1.0, 3.0, 2.0], [0.0, 1.0, 0.0, 1.0, 0.5])],
                               "id int, t array<double>, s array<double>")
    tk = LO.with_top_k(df, "t", 3).first()
    assert tk["top_k_indices"] == [1, 3, 4] and tk["top_k_values"] == [3.0, 3.0, 2.0]
    kd = LO.offline_kd_terms(LO.with_top_k(df, "t", 5), "top_k_values", "top_k_indices", "t").first()
    assert abs(kd["kl_topk"]) < 1e-12   # student == teacher over the full support


def test_soft_label_table(spark):
    rows = [(0, 1, [3.0], [7], 11, 5, 1), (0, 0, [2.0], [4], 10, -100, 1), (0, 2, [1.0], [1], 12, 6, 0)]
    df = spark.createDataFrame(rows, "seq int, pos int, v array<double>, i array<int>, id int, label int, m int")
    r = LO.soft_label_table(df, "seq", "pos", "v", "i", "id", "label", "m").first()
    assert r["true_length"] == 2 and r["input_ids"] == [10, 11] and r["top_k_indices"] == [[4], [7]]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_vec = st.lists(st.floats(min_value=-20, max_value=20, allow_nan=False), min_size=3, max_size=3)


@settings(max_examples=40, deadline=None)
@given(_vec, _vec, st.sampled_from([0.5, 1.0, 2.0, 5.0]))
def test_kl_non_negative(spark, a, b, t):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    r = df.select(LG.kl_position("a", "b", t), LG.array_sum(LG.softmax("a", t))).first()
    assert r[0] >= -1e-12 and r[1] == pytest.approx(1.0)


def test_shift_labels(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (0, 2, 7), (1, 0, 9)], "seq int, pos int, label int")
    got = {(r[0], r[1]): r[2] for r in LO.shift_labels(df, "seq", "pos", "label").collect()}
    assert got == {(0, 0): 6, (0, 1): 7, (0, 2): -100, (1, 0): -100}
