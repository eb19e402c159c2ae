import pytest
from pyspark.sql import functions as F

from tesserae.operators import scoring as S


def test_numeric_denominators(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "3"), (None, "5"), ("4", None)], "p string, r string")
    r = S.numeric_accuracy(df, "p", "r").first()
    assert (r["total_samples"], r["correct_samples"], r["no_answer_samples"]) == (3, 1, 1)
    assert r["exact_match"] == pytest.approx(1 / 3) and r["no_answer_rate"] == pytest.approx(1 / 4)
    df2 = df.unionByName(spark.createDataFrame([(None, None)], "p string, r string"))
    r2 = S.numeric_accuracy(df2, "p", "r").first()
    assert (r2["total_samples"], r2["no_answer_samples"]) == (4, 2)
    assert r2["exact_match"] == pytest.approx(1 / 4) and r2["no_answer_rate"] == pytest.approx(2 / 5)


def test_all_empty_rates_are_zero(spark):
    empty = spark.createDataFrame([], "p string, r string")
    r = S.numeric_accuracy(empty, "p", "r").first()
    assert r["exact_match"] == 0.0 and r["no_answer_rate"] == 0.0
    k = S.keyword_verdicts(empty, "p", "r").agg(*S.keyword_aggs()).first()
    assert k["keyword_match_rate"] == 0.0


def test_exact_and_contains(spark):
    df = spark.createDataFrame([(" Yes\n", "yes"), ("the answer is 4", "4"), ("x", ""), ("y", None)],
                               "p string, r string")
    v = df.select(S.exact_match_verdict("p", "r"), S.contains_match_verdict("p", "r")).collect()
    assert [tuple(x) for x in v] == [(True, True), (False, True), (False, True), (False, False)]
    assert S.metric("contains", F.col("p"), F.col("r")) is not None
    with pytest.raises(ValueError):
        S.metric("bleu", F.col("p"), F.col("r"))


def test_pass_at_k_fixture(spark):
    rows = [("t", i < 3) for i in range(10)]
    df = spark.createDataFrame(rows, "task string, passed boolean")
    got = {r["k"]: r["pass_at_k"] for r in S.pass_at_k(df, "task", "passed").collect()}
    assert got[1] == pytest.approx(0.3) and got[5] == pytest.approx(0.916667, abs=1e-6) and got[10] == 1.0


def test_pass_at_k_of_too_few_attempts_is_undefined(spark):
    df = spark.createDataFrame([("a", True), ("b", True), ("b", False)], "task string, passed boolean")
    got = {r["k"]: r for r in S.pass_at_k(df, "task", "passed", ks=(2, 5)).collect()}
    assert (got[2]["pass_at_k"], got[2]["n_tasks"], got[2]["n_left_out"]) == (1.0, 1, 1)
    assert (got[5]["pass_at_k"], got[5]["n_tasks"], got[5]["n_left_out"]) == (None, 0, 2)


def test_pass_at_1(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "passed boolean")
    r = df.agg(*S.pass_at_1_aggs()).first()
    assert r["pass_at_1"] == pytest.approx(1 / 3) and r["total_samples"] == 3


def test_evaluate_one_pass(spark):
    rows = [("math", "#### 4", "#### 4", None), ("math", "none", "#### 2", None),
            ("code", "x", None, True), ("aiops", "restart the pod", "restart it", None),
            ("poetry", "x", "y", None)]
    df = spark.createDataFrame(rows, "domain string, prediction string, reference string, passed boolean")
    rep = {r["domain"]: r for r in S.evaluate(df).collect()}
    assert rep["math"]["exact_match"] == 0.5 and rep["math"]["headline_text"] == "50.0%"
    assert rep["code"]["pass_at_1"] == 1.0 and rep["aiops"]["keyword_match_rate"] == 1.0
    assert rep["poetry"]["scored"] is False
    assert S.overall_total(S.evaluate(df)).first()[0] == 4
