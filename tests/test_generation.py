"""Resumable generation by chunks, the stream with retries, batches, pairing and verdicts."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import inference as INF
from tesserae.operators import records as REC
from tesserae.operators import reports as REP
from tesserae.operators import stubs
from tesserae.streaming import generate as G

R_OF = "Human: {}\n\nAssistant:"


def items(spark, n, bad=()):
    return spark.createDataFrame([(i, f"p{i}@" if i in bad else f"p{i}") for i in range(n)], "id long, prompt string")


def counting_model(log, fails="@"):
    """Writes a line for each prompt it is asked; fails on batches with ``fails``."""
    def factory():
        def fn(prompts, params):
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            if fails and any(fails in p for p in prompts):
                raise RuntimeError("down")
            return [p.upper() for p in prompts]
        return fn
    return factory


def asked(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def test_chunks_finished_by_the_manifest_are_not_looked_at_again(spark, tmp_path):
    out, log = str(tmp_path / "out"), [str(tmp_path / f"log{i}") for i in range(4)]
    first = INF.generate_incremental(items(spark, 40, {3, 17}), out, counting_model(log[0]), batch_size=1, chunk_rows=8)
    assert len(asked(log[0])) == 40 and first.filter("status = 'failed'").count() == 2
    manifest = INF.read_manifest(spark, out)
    assert set(manifest) == set(range(5)) and sum(e["n_ok"] for e in manifest.values()) == 38
    # the failed rows only, whose chunks alone are opened
    bad = spark.read.parquet(out).filter("status = 'failed'").select("chunk").distinct().count()
    second = INF.generate_incremental(items(spark, 40, {3, 17}), out, counting_model(log[1], None), batch_size=1, chunk_rows=8)
    assert asked(log[1]) == ["p17@", "p3@"] and bad <= 2
    assert second.count() == 40 and second.filter("status = 'failed'").count() == 0
    INF.generate_incremental(items(spark, 40, {3, 17}), out, counting_model(log[2], None), batch_size=1, chunk_rows=8)
    assert asked(log[2]) == []
    # new items in old chunks
    third = INF.generate_incremental(items(spark, 45, {3, 17}), out, counting_model(log[3], None), batch_size=1)
    assert asked(log[3]) == sorted(f"p{i}" for i in range(40, 45)) and third.count() == 45


def test_a_crash_between_answers_and_manifest_loses_nothing(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    INF.generate_incremental(items(spark, 20), out, counting_model(str(tmp_path / "a")), batch_size=1, chunk_rows=5)
    os.rename(os.path.join(out, INF.MANIFEST), str(tmp_path / "lost"))
    got = INF.generate_incremental(items(spark, 20), out, counting_model(log), batch_size=1, chunk_rows=5)
    assert asked(log) == [] and got.count() == 20 and len(INF.read_manifest(spark, out)) == 4


def test_runs_of_a_batch_column():
    frames = [pd.DataFrame({"b": b, "x": x}) for b, x in (([None, None, 1], [0, 1, 2]), ([1, 1], [3, 4]), ([], []), ([2, 5, 5], [5, 6, 7]))]
    got = [g["x"].tolist()[a:z] for g, edges in INF._runs(iter(frames), "b") for a, z in zip(edges, edges[1:])]
    assert got == [[0, 1], [2, 3, 4], [5], [6, 7]]


def test_prompts_spread_over_the_cores(spark):
    few = items(spark, 64).coalesce(1)
    assert INF.spread_tasks(few) == INF.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    out = INF.generate(few, stubs.length_model, "prompt", 4)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert INF.generate(few, stubs.length_model, "prompt", 4, num_partitions=0).rdd.getNumPartitions() == 1


def test_timing_counts_each_batch_once(spark):
    rows = [("a", "x", 10.0, 12.0), ("a", "x", 10.0, 12.0), ("a", "y", 20.0, 21.0), ("b", "x", 0.0, 4.0), ("b", None, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "m string, batch_key string, batch_started double, batch_ended double")
    got = {r["m"]: tuple(r)[1:] for r in REP.timing(df, "m").collect()}
    assert got == {"a": (3.0, 2, 3, 1.0), "b": (4.0, 1, 1, 4.0)}
    gen = INF.generate(items(spark, 30).coalesce(1), stubs.length_model, "prompt", 7, num_partitions=0).withColumn("m", F.lit("s"))
    r = REP.timing(gen, "m").first()
    assert (r["n_batches"], r["n_rows"]) == (5, 30) and r["total_time"] >= 0
    both = INF.generate_many(items(spark, 30), {"a": stubs.length_model, "b": stubs.length_model}, "prompt", 7)
    got = {r["model"]: r for r in REP.timing(REP.model_batches(both, ["a", "b"]), "model").collect()}
    assert got["a"]["n_batches"] == got["b"]["n_batches"] and got["a"]["n_rows"] == 30


def test_responses_are_paired_once(spark):
    it = spark.createDataFrame([(1, "e"), (2, "f"), (None, "g")], "id long, expected_answer string")
    answers = lambda *rows: spark.createDataFrame(list(rows), "id long, response string")
    got = sorted((r["id"] or 0, r["teacher_response"], r["expected_answer"], r["response_status"])
                 for r in REC.attach_response(it, answers((1, "x"), (None, "n"), (None, "m"))).collect())
    assert got == [(0, None, "g", "missing"), (1, "x", "x", "ok"), (2, None, "f", "missing")]
    with pytest.raises(Exception, match="more than one response for 1"):
        REC.attach_response(it, answers((1, "x"), (1, "x"))).collect()


def test_evaluation_rows_take_verdicts_by_id(spark):
    schema = "id string, domain string, response string, expected_answer string, original_answer string, metadata struct<entry_point:string>"
    pred = spark.createDataFrame([("1", "math", "#### 4", "#### 4", None, None), ("2", "code", "def f(): pass", None, None, ("f",)),
                                  ("3", "code", "no", None, None, (None,)), ("4", "aiops", "disk space is low", "disk space", None, None)], schema)
    rows = {r["id"]: r for r in INF.evaluation_rows(pred).collect()}
    assert rows["1"]["pred_answer"] == 4 and rows["1"]["correct"] and rows["2"]["passed"] is None and rows["4"]["keyword_match"] is not None
    assert rows["2"]["pred_answer"] is None and rows["4"]["correct"] is None
    from tesserae.operators import scoring as S
    assert {r["domain"]: r["pass_at_1"] for r in S.summarize(INF.evaluation_rows(pred)).collect()}["code"] is None  # nothing was run
    verdicts = spark.createDataFrame([("2", True, None), ("9", False, "x")], "id string, passed boolean, error string")
    report = {r["domain"]: r for r in S.summarize(INF.evaluation_rows(pred, verdicts)).collect()}
    assert report["code"]["pass_at_1"] == 0.5 and report["math"]["exact_match"] == 1.0
    with pytest.raises(Exception, match="more than one verdict for 2"):
        INF.evaluation_rows(pred, verdicts.unionAll(verdicts)).collect()


def drop(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(json.dumps({"id": i, "prompt": p}) + "\n" for i, p in rows)


def stream(spark, base, model, **kw):
    G.generate_stream(spark, f"{base}/in", "id string, prompt string", f"{base}/out", f"{base}/ck", model, batch_size=1, **kw).stop()


def test_a_failed_row_is_answered_by_a_later_batch(spark, tmp_path):
    log = [str(tmp_path / f"log{i}") for i in range(4)]
    drop(f"{tmp_path}/in", "a.json", [("1", "a"), ("2", "b@"), ("3", "c"), ("3", "c")])
    stream(spark, tmp_path, counting_model(log[0]))
    assert asked(log[0]) == ["a", "b@", "c"]
    got = {r["id"]: r for r in G.read_answers(spark, f"{tmp_path}/out").collect()}
    assert got["2"]["status"] == "failed" and got["2"]["attempt"] == 1 and len(got) == 3
    drop(f"{tmp_path}/in", "b.json", [("4", "d"), ("1", "a")])
    stream(spark, tmp_path, counting_model(log[1], None))
    assert asked(log[1]) == ["b@", "d"]  # no answered id again
    got = {r["id"]: (r["response"], r["status"], r["attempt"]) for r in G.read_answers(spark, f"{tmp_path}/out").collect()}
    assert got == {"1": ("A", "ok", 1), "2": ("B@", "ok", 2), "3": ("C", "ok", 1), "4": ("D", "ok", 1)}
    stream(spark, tmp_path, counting_model(log[2], None))
    assert asked(log[2]) == []


def test_attempts_are_bounded(spark, tmp_path):
    log = str(tmp_path / "log")
    drop(f"{tmp_path}/in", "a.json", [("1", "a@")])
    for _ in range(4):
        stream(spark, tmp_path, counting_model(log), max_attempts=2)
    assert asked(log) == ["a@"] * 2
    r = G.read_answers(spark, f"{tmp_path}/out").collect()
    assert [(x["status"], x["id"]) for x in r] == [("failed", "1")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    log = [str(tmp_path / f"log{i}") for i in range(2)]
    drop(f"{tmp_path}/in", "a.json", [(str(i), f"p{i}") for i in range(5)] + [("9", "z@")])
    stream(spark, tmp_path, counting_model(log[0]))
    files = sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    commits = tmp_path / "ck" / "commits"
    last = max((p.name for p in commits.iterdir() if p.name.isdigit()), key=int)
    (commits / last).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    stream(spark, tmp_path, counting_model(log[1], None))
    assert asked(log[1]) == ["z@"]  # the retry, not the batch
    assert set(files) <= {str(p) for p in (tmp_path / "out").rglob("*.parquet")}
    assert sorted(r["id"] for r in G.read_answers(spark, f"{tmp_path}/out").collect()) == ["0", "1", "2", "3", "4", "9"]


def test_a_batch_does_not_read_earlier_answers(spark, tmp_path, monkeypatch):
    plans = []
    answer = G.answer_epoch

    def spy(batch, folder, *args):
        plans.append(batch._jdf.queryExecution().toString())
        return answer(batch, folder, *args)

    monkeypatch.setattr(G, "answer_epoch", spy)
    for i in range(2):
        drop(f"{tmp_path}/in", f"{i}.json", [(f"{i}-{j}", "p") for j in range(4)])
        stream(spark, tmp_path, stubs.length_model)
    assert len(plans) >= 2 and not any(f"{tmp_path}/out" in p for p in plans)


def test_a_null_id_stops_the_stream(spark, tmp_path):
    drop(f"{tmp_path}/in", "a.json", [(None, "p")])
    with pytest.raises(Exception, match="null ids in column id"):
        stream(spark, tmp_path, stubs.length_model)


@pytest.mark.parametrize("parts", [0, 3])
def test_the_stream_queries_read_a_table_of_one_file_or_of_many(spark, tmp_path, parts):
    from tesserae.plans import inference as P

    rows = [(i, f"mail a@b {i}" if i % 3 == 0 else f"text {i}", "en") for i in range(12)]
    path = tmp_path / "documents.parquet"
    pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).to_parquet(path, index=False)
    if parts:
        folder = tmp_path / "many"
        spark.read.parquet(str(path)).repartition(parts).write.parquet(str(folder / "documents.parquet"))
        assert len(list((folder / "documents.parquet").glob("part-*"))) == parts
        path = folder / "documents.parquet"
    want = [(i, f"Final Answer: {len(R_OF.format(t))}", "ok") for i, t, _ in rows]
    assert sorted(map(tuple, P.stream_generate(spark, str(path.parent)).collect())) == want
    got = sorted(map(tuple, P.stream_retry(spark, str(path.parent)).collect()))
    assert got == [(*w, 2 if w[0] % 3 == 0 else 1) for w in want]
