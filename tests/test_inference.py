import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import inference as INF
from tesserae.operators import stubs
from tesserae.operators.sampling import assign_batches


def items(spark, n=40):
    return spark.range(n).select(F.col("id").cast("string").alias("id"),
                                 F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"),
                                 F.lit("ref").alias("expected_answer"))


def test_generate_strips_and_batches(spark):
    out = INF.generate(items(spark), stubs.length_model, "prompt", batch_size=7).collect()
    assert len(out) == 40
    assert all(r["response"] == f"Final Answer: {len(r['prompt'])}" and r["status"] == "ok" for r in out)
    assert max(r["batch_rows"] for r in out) <= 7


def test_failures_marked_not_shifted(spark):
    df = items(spark).withColumn("prompt", F.when(F.col("id") == "5", F.lit("a@b")).otherwise(F.col("prompt")))
    batched = assign_batches(df, ["id"], 4)
    out = {r["id"]: r for r in INF.generate(batched, stubs.failing_model("@"), "prompt", 4,
                                                batch_col="batch_id").collect()}
    bad_batch = out["5"]["batch_id"]
    for r in out.values():
        assert (r["status"] == "failed") == (r["batch_id"] == bad_batch)
        assert (r["response"] is None) == (r["status"] == "failed")
    assert INF.failure_rate(INF.generate(batched, stubs.failing_model("@"), "prompt", 4, batch_col="batch_id")) \
        == 0.1


def test_generate_dataset_overwrites_answer(spark):
    out = INF.generate_dataset(items(spark, 3), stubs.length_model).collect()
    assert all(r["teacher_response"] == r["expected_answer"] for r in out)


def test_incremental_run_twice_equals_once(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tesserae-inc-"), "gen")
    first = INF.generate_incremental(items(spark, 10), out, stubs.length_model, chunk_rows=3)
    assert first.count() == 10
    # more items arrive; the done ones are skipped
    second = INF.generate_incremental(items(spark, 25), out, stubs.length_model, chunk_rows=7)
    raw = spark.read.parquet(out)
    assert second.count() == 25 and raw.count() == 25
    third = INF.generate_incremental(items(spark, 25), out, stubs.length_model)
    assert spark.read.parquet(out).count() == 25 and third.count() == 25


def test_compare_models(spark):
    out = INF.compare_models(items(spark, 12), {"original": stubs.length_model,
                                                  "kd": stubs.letter_count_model("p")}, "id", "prompt", 5).collect()
    assert len(out) == 12
    assert all(r["kd_response"] == "#### 2" and r["original_time"] >= 0 for r in out)


def test_stream_two_drops_and_restart(spark):
    from tesserae.streaming.generate import generate_stream

    base = tempfile.mkdtemp(prefix="tesserae-stream-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    os.makedirs(src)

    def drop(name, ids):
        with open(os.path.join(src, name), "w") as f:
            for i in ids:
                f.write('{"id": "%s", "prompt": "p%s"}\n' % (i, i))

    schema = "id string, prompt string"
    drop("a.json", [1, 2, 3, 3])
    generate_stream(spark, src, schema, out, ck, stubs.length_model).stop()
    drop("b.json", [3, 4, 5])
    generate_stream(spark, src, schema, out, ck, stubs.length_model).stop()   # restart from checkpoint
    ids = [r[0] for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(ids) == ["1", "2", "3", "4", "5"]


def test_stream_replayed_batch_is_idempotent(spark):
    """Crash after the write but before the checkpoint commit: the batch is
    replayed on restart and the anti-join keeps every id once."""
    from tesserae.streaming.generate import generate_stream

    base = tempfile.mkdtemp(prefix="tesserae-replay-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        for i in range(6):
            f.write('{"id": "%d", "prompt": "p%d"}\n' % (i, i))
    schema = "id string, prompt string"
    generate_stream(spark, src, schema, out, ck, stubs.length_model).stop()
    commits = os.path.join(ck, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    os.remove(os.path.join(commits, last))          # the commit never happened
    crc = os.path.join(commits, f".{last}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    generate_stream(spark, src, schema, out, ck, stubs.length_model).stop()
    ids = [r[0] for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(ids) == [str(i) for i in range(6)]


def test_compare_models_single_pass_equals_legs(spark):
    models = {"original": stubs.length_model, "kd": stubs.letter_count_model("o")}
    a = INF.compare_models(items(spark, 30), models, "id", "prompt", 7, single_pass=True)
    b = INF.compare_models(items(spark, 30), models, "id", "prompt", 7, single_pass=False)
    cols = ["id", "domain", "difficulty", "prompt", "original_response", "kd_response", "expected_answer",
            "teacher_response"]
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_failed_rows_are_tried_again(spark, tmp_path):
    items = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id long, prompt string")
    broken = tmp_path / "broken"
    broken.write_text("")

    def factory(flag=str(broken)):
        import os

        def model(prompts, params):
            if os.path.exists(flag) and any(p == "p3" for p in prompts):
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

        return model

    out = str(tmp_path / "out")
    kw = {"batch_size": 2, "chunk_rows": 5}
    first = INF.generate_incremental(items, out, factory, **kw)
    failed = first.filter("status = 'failed'").count()
    assert failed >= 1
    broken.unlink()
    again = INF.generate_incremental(items, out, factory, **kw)
    assert again.count() == 12 and again.filter("status = 'failed'").count() == 0


def test_null_and_repeated_ids_are_refused(spark, tmp_path):
    for ids in ([1, None], [1, 1]):
        items = spark.createDataFrame([(i, "p") for i in ids], "id long, prompt string")
        with pytest.raises(ValueError, match="ids"):
            INF.generate_incremental(items, str(tmp_path / f"o{len(str(ids))}"), lambda: None)


def test_batches_keep_order_and_size():
    frames = [pd.DataFrame({"x": range(a, z)}) for a, z in ((0, 5), (5, 6), (6, 30), (30, 31))]
    got = [g["x"].tolist()[a:z] for g, edges in INF._batches(iter(frames), 4) for a, z in zip(edges, edges[1:])]
    assert [len(g) for g in got] == [4] * 7 + [3]
    assert [x for g in got for x in g] == list(range(31))


@pytest.mark.parametrize("bound", ["10000", "0"])
def test_a_worker_gets_small_frames_and_whole_batches(spark, tmp_path, bound):
    """What a worker holds must not grow with the rows of its task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    log = str(tmp_path / "frames")

    def tell(frames):
        for f in frames:
            with open(log, "a") as out:
                out.write(f"{len(f)}\n")
            yield f

    try:
        spark.conf.set(name, bound)
        rows = spark.range(4300).select(F.col("id"), F.col("id").cast("string").alias("prompt")).coalesce(1)
        gen = INF.generate(rows, stubs.length_model, "prompt", 700, num_partitions=0)
        sizes = sorted((r["n"], r["count"]) for r in gen.groupBy("batch_key").agg(F.max("batch_rows").alias("n"), F.count("*").alias("count")).collect())
        assert sizes == [(100, 100)] + [(700, 700)] * 6
        rows.mapInPandas(tell, rows.schema).count()
        assert max(map(int, open(log).read().split())) <= INF.FRAME_ROWS
        spark.conf.set(name, bound)
        INF.generate_many(rows, {"a": stubs.length_model}, "prompt", 700)
        assert int(spark.conf.get(name)) == INF.FRAME_ROWS
    finally:
        spark.conf.set(name, before)
