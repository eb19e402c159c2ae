import pytest
from pyspark.sql import functions as F

from tesserae.operators import reports as REP


def test_perplexity_fixture(spark):
    df = spark.createDataFrame([("s", 2.0, 3), ("s", 1.0, 1)], "role string, loss double, n_tokens long")
    r = REP.corpus_perplexity(df, ["role"]).first()
    assert r["avg_loss"] == pytest.approx(1.75) and r["perplexity"] == pytest.approx(5.754603, abs=1e-6)


def test_improvement(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 8.0), (None, 8.0)], "b double, s double")
    got = [r[0] for r in df.select(REP.improvement_pct(F.col("b"), F.col("s"))).collect()]
    assert got == [20.0, None, None]


def test_convergence_verdicts(spark):
    rows = [("a", 1, 10.0), ("a", 2, 8.0), ("b", 1, 10.0), ("b", 2, 9.4), ("c", 1, 10.0), ("c", 2, 11.0),
            ("d", 1, 5.0)]
    df = spark.createDataFrame(rows, "run string, step long, loss double")
    got = {r["run"]: r["verdict"] for r in REP.convergence(df, "run", "step", "loss").collect()}
    assert got == {"a": "excellent", "b": "good", "c": "diverging", "d": None}


def test_log_tail_and_timing(spark):
    log = spark.range(25).select(F.lit("r").alias("run"), F.col("id").alias("step"))
    assert sorted(r[0] for r in REP.log_tail(log, "run", "step", 10).select("step").collect()) == list(range(15, 25))
    per_row = spark.createDataFrame([("m", "a", 0.0, 2.0), ("m", "a", 0.0, 2.0), ("m", "b", 5.0, 6.0)],
                                    "model string, batch_key string, batch_started double, batch_ended double")
    t = REP.timing(per_row, "model").first()
    assert t["total_time"] == pytest.approx(3.0) and t["n_batches"] == 2 and t["n_rows"] == 3


def test_teacher_student_report_limits_and_missing_role(spark):
    losses = spark.createDataFrame([("student", 1, 1.0, 1), ("student", 2, 9.0, 1), ("baseline", 1, 2.0, 1)],
                                   "role string, text_id long, loss double, n_tokens long")
    gens = spark.createDataFrame([("student", 1, "abcd"), ("student", 2, "ab")],
                                 "role string, prompt_id long, generated string")
    rep = {r["role"]: r for r in REP.teacher_student_report(losses, gens, {"student": 1}, {"student": 1}).collect()}
    assert rep["student"]["loss"] == 1.0 and rep["student"]["avg_generation_length"] == 4.0
    assert rep["student"]["loss_improvement_pct"] == 50.0
    assert rep["teacher"]["error"] == "no texts" and rep["baseline"]["error"] is None
