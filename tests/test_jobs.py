import json
import os
import tempfile

from pyspark.sql import functions as F

from tesserae import jobs
from tesserae.operators import stubs


def _dump(path, rows, array=True):
    with open(path, "w", encoding="utf-8") as f:
        if array:
            json.dump(rows, f, ensure_ascii=False, indent=2)
        else:
            for r in rows:
                f.write(json.dumps(r, ensure_ascii=False) + "\n")


def test_prepare_teach_evaluate_compare(spark):
    d = tempfile.mkdtemp(prefix="tesserae-jobs-")
    math = [{"question": f"What is {i} + {i}?", "answer": f"{i} + {i} = {2 * i}\n#### {2 * i}"} for i in range(60)]
    code = [{"task_id": f"T/{i}", "prompt": f"def f{i}(x):", "canonical_solution": "    return x",
             "test": "assert True", "entry_point": f"f{i}"} for i in range(8)]
    _dump(os.path.join(d, "math.json"), math)
    _dump(os.path.join(d, "code.json"), code)
    counts = jobs.prepare_corpus(spark, os.path.join(d, "math.json"), os.path.join(d, "code.json"),
                                 os.path.join(d, "corpus"), math_n=50, code_n=5, incident_n=40)
    got = {(r["split"], r["domain"]): r["count"] for r in counts.collect()}
    assert sum(got.values()) == 95 and sum(v for (s, _), v in got.items() if s == "eval") == 9

    train = os.path.join(d, "corpus", "train")
    taught = jobs.teacher_responses(spark, train, os.path.join(d, "teach"), stubs.length_model, batch_size=16)
    assert {r[0]: r[1] for r in taught.collect()} == {"ok": 86}
    again = jobs.teacher_responses(spark, train, os.path.join(d, "teach"), stubs.length_model, batch_size=16)
    assert again.collect()[0][1] == 86                     # resumed: nothing regenerated
    assert spark.read.parquet(os.path.join(d, "teach", "_generated")).count() == 86

    report = jobs.run_evaluation(spark, os.path.join(d, "corpus", "eval"), os.path.join(d, "eval"),
                                 stubs.length_model)
    assert set(r["domain"] for r in report.collect()) <= {"math", "code", "aiops"}
    assert os.path.isdir(os.path.join(d, "eval", "detailed")) and os.path.isdir(os.path.join(d, "eval", "report"))

    res, timing = jobs.compare_models(spark, os.path.join(d, "corpus", "eval"), os.path.join(d, "cmp"),
                                      {"original": stubs.length_model, "kd": stubs.letter_count_model("a")},
                                      mode="quick")
    assert res.count() <= 10 and {r["model"] for r in timing.collect()} == {"original", "kd"}


def test_distillation_report(spark):
    d = tempfile.mkdtemp(prefix="tesserae-jobs-")
    _dump(os.path.join(d, "losses.jsonl"), [{"role": "student", "text_id": "1", "loss": 1.0, "n_tokens": 2},
                                            {"role": "baseline", "text_id": "1", "loss": 2.0, "n_tokens": 2}], False)
    rep = {r["role"]: r for r in jobs.distillation_report(spark, os.path.join(d, "losses.jsonl"), None,
                                                          os.path.join(d, "out")).collect()}
    assert rep["student"]["loss_improvement_pct"] == 50.0 and rep["teacher"]["error"] == "no texts"


def test_a_leg_that_fails_is_recorded(spark):
    d = tempfile.mkdtemp(prefix="tesserae-legs-")
    for role, loss in (("student", 1.0), ("baseline", 2.0)):
        _dump(os.path.join(d, f"{role}.jsonl"), [{"role": role, "text_id": "1", "loss": loss, "n_tokens": 2}], False)
    with open(os.path.join(d, "gen.jsonl"), "w") as f:
        f.write("{broken\n")
    open(os.path.join(d, "none.jsonl"), "w").close()
    losses = {"student": f"{d}/student.jsonl", "baseline": f"{d}/baseline.jsonl", "teacher": f"{d}/missing.jsonl", "other": f"{d}/none.jsonl"}
    rep = {r["role"]: r for r in jobs.distillation_report(spark, losses, {"baseline": f"{d}/gen.jsonl"}, os.path.join(d, "out")).collect()}
    assert rep["student"]["loss_improvement_pct"] == 50.0 and rep["student"]["error"] is None
    assert rep["baseline"]["loss"] == 2.0 and rep["baseline"]["error"]  # its answers could not be read
    assert "PATH_NOT_FOUND" in rep["teacher"]["error"] and rep["teacher"]["loss"] is None
    assert rep["other"]["error"] == "no texts"
    assert len(os.listdir(os.path.join(d, "out", "report"))) > 0


def test_taught_records_have_their_provenance_and_details_their_verdicts(spark):
    d = tempfile.mkdtemp(prefix="tesserae-prov-")
    items = [{"id": f"i{k:02d}", "domain": ("math", "code", "aiops")[k % 3], "prompt": f"p{k}", "expected_answer": "#### 4",
              "metadata": {"entry_point": "f"}} for k in range(20)]
    _dump(os.path.join(d, "items.jsonl"), items, False)
    jobs.teacher_responses(spark, os.path.join(d, "items.jsonl"), os.path.join(d, "teach"), stubs.length_model, batch_size=4, instances=3)
    taught = sorted(spark.read.json(os.path.join(d, "teach", "taught")).collect(), key=lambda r: r["id"])
    assert [r["instance_id"] for r in taught] == [0] * 6 + [1] * 6 + [2] * 8  # the last shard takes the rest
    assert [r["batch_id"] for r in taught] == [0] * 4 + [1] * 2 + [0] * 4 + [1] * 2 + [0] * 4 + [1] * 4
    verdicts = spark.createDataFrame([("i01", True, None), ("i04", False, "AssertionError")], "id string, passed boolean, error string")
    rep = {r["domain"]: r for r in jobs.run_evaluation(spark, os.path.join(d, "items.jsonl"), os.path.join(d, "eval"), stubs.length_model,
                                                       model_path="m/1", verdicts=verdicts).collect()}
    assert rep["code"]["pass_at_1"] == 1 / 7
    detail = {r["id"]: r for r in spark.read.json(os.path.join(d, "eval", "detailed")).collect()}
    assert detail["i00"]["pred_answer"] is not None and detail["i04"]["error"] == "AssertionError" and detail["i02"]["keyword_match"] is False
    record = spark.read.json(os.path.join(d, "eval", "report")).first()
    assert record["model_path"] == "m/1" and record["eval_data_path"].endswith("items.jsonl") and record["total_samples"] == 20
    none = {r["domain"]: r for r in jobs.run_evaluation(spark, os.path.join(d, "items.jsonl"), os.path.join(d, "eval2"), stubs.length_model).collect()}
    assert none["code"]["pass_at_1"] is None  # nothing was run
