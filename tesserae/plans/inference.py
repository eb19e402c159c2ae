"""Inference queries (G1-G8, F3, J2, J3, P13, P14, A14) with deterministic
stub models, so the oracle can recompute every response in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.operators import inference as INF
from tesserae.operators import records as REC
from tesserae.operators import reports as REP
from tesserae.operators import stubs
from tesserae.operators.sampling import assign_batches
from tesserae.plans.registry import query, table
from tesserae.session import scratch_path

BATCH = 64
RENDERED = "'Human: ' || text || chr(10) || chr(10) || 'Assistant:'"
LENGTH_ANSWER = f"'Final Answer: ' || length({RENDERED})"


def items(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return d.select(F.col("doc_id"), F.col("lang").alias("domain"), F.col("text").alias("prompt"),
                    F.col("lang").alias("expected_answer"))


@query("generate_responses", "G1 G2 P8 P13 X7", sql=f"""
SELECT doc_id, {LENGTH_ANSWER} AS teacher_response, {LENGTH_ANSWER} AS expected_answer, 'ok' AS status
FROM documents
""")
def generate_responses(spark, sf_dir):
    out = INF.generate_dataset(items(spark, sf_dir), stubs.length_model, R.render_single_turn,
                               "doc_id", "prompt", BATCH)
    return out.select("doc_id", "teacher_response", "expected_answer", "status")


@query("compare_models", "G7 G8 J2 P14", sql="""
SELECT doc_id, lang AS domain, 'unknown' AS difficulty, md5(text) AS prompt_md5, 'Final Answer: ' || length(text) AS original_response,
       '#### ' || (length(text) - length(replace(text, 'e', ''))) AS kd_response, true AS timed, '' AS expected_answer, '' AS teacher_response
FROM documents
""")
def compare_models(spark, sf_dir):
    models = {"original": stubs.length_model, "kd": stubs.letter_count_model("e")}
    out = INF.compare_models(items(spark, sf_dir), models, "doc_id", "prompt", BATCH)
    return out.select("doc_id", "domain", "difficulty", F.md5("prompt").alias("prompt_md5"), "original_response", "kd_response",
                      ((F.col("original_time") >= 0) & (F.col("kd_time") >= 0)).alias("timed"), "expected_answer", "teacher_response")


@query("compare_models_legs", "G7 G8 J2 P14 (one stage per model, joined)", sql="""
SELECT doc_id, lang AS domain, 'Final Answer: ' || length(text) AS original_response,
       '#### ' || (length(text) - length(replace(text, 'e', ''))) AS kd_response
FROM documents
""")
def compare_models_legs(spark, sf_dir):
    models = {"original": stubs.length_model, "kd": stubs.letter_count_model("e")}
    out = INF.compare_models(items(spark, sf_dir), models, "doc_id", "prompt", BATCH, single_pass=False)
    return out.select("doc_id", "domain", "original_response", "kd_response")


@query("evaluate_batched", "G7", sql="""
SELECT doc_id, 'Final Answer: ' || length(text) AS student_response, true AS timed FROM documents
""")
def evaluate_batched(spark, sf_dir):
    out = INF.evaluate_batched(items(spark, sf_dir), stubs.length_model, "student", "prompt", BATCH)
    return out.select("doc_id", "student_response", (F.col("student_time") >= 0).alias("timed"))


@query("generation_params", "U3", sql="""
SELECT doc_id, 'max_new_tokens=7 temperature=0.3 top_p=0.9' AS response FROM documents
""")
def generation_params(spark, sf_dir):
    """The defaults with the caller's settings over them, as the model got them."""
    out = INF.generate(items(spark, sf_dir), stubs.settings_model, "prompt", BATCH, {"max_new_tokens": 7})
    return out.select("doc_id", "response")


@query("attach_responses", "P13 J1", sql="""
SELECT d.doc_id, l.label AS teacher_response, coalesce(l.label, d.lang) AS expected_answer,
       CASE WHEN l.label IS NULL THEN 'missing' ELSE 'ok' END AS response_status
FROM documents d LEFT JOIN (SELECT doc_id, 'quality ' || quality AS label FROM labels) l USING (doc_id)
""")
def attach_responses(spark, sf_dir):
    answers = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("response"))
    out = REC.attach_response(items(spark, sf_dir), answers, "doc_id")
    return out.select("doc_id", "teacher_response", "expected_answer", "response_status")


@query("timing", "A14", sql="""
WITH b AS (SELECT event_type AS model, user_id % 97 AS batch, max(event_id + value) - min(event_id) AS seconds, count(*) AS n
           FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT model, round(sum(seconds), 6) AS total_time, count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_rows,
       round(sum(seconds) / sum(n), 6) AS avg_time_per_row
FROM b GROUP BY model
""")
def timing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").filter(F.col("value").isNotNull())
    rows = e.select(F.col("event_type").alias("model"), F.pmod("user_id", F.lit(97)).alias("batch_key"),
                    F.col("event_id").cast("double").alias("batch_started"), (F.col("event_id") + F.col("value")).alias("batch_ended"))
    return REP.timing(rows, "model").select("model", F.round("total_time", 6).alias("total_time"), "n_batches", "n_rows",
                                            F.round("avg_time_per_row", 6).alias("avg_time_per_row"))


@query("timing_batches", "A14 G7 M9", sql=f"""
SELECT 'student' AS model, CAST(ceil(count(*) / {BATCH}) AS BIGINT) AS n_batches, count(*) AS n_rows, true AS timed FROM documents
""")
def timing_batches(spark, sf_dir):
    """A run's own batches: as many as the input has batch numbers, each counted once."""
    batched = assign_batches(items(spark, sf_dir).select("doc_id", "prompt"), ["doc_id"], BATCH)
    gen = INF.generate(batched, stubs.length_model, "prompt", BATCH, batch_col="batch_id").withColumn("model", F.lit("student"))
    return REP.timing(gen, "model").select("model", "n_batches", "n_rows", (F.col("total_time") >= 0).alias("timed"))


@query("resume_anti", "F3 J3", sql=f"""
SELECT d.doc_id, {LENGTH_ANSWER.replace('text', 'd.text')} AS response
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    todo = REC.not_done(items(spark, sf_dir), done, "doc_id")
    staged = todo.withColumn("prompt", R.render_single_turn("prompt"))
    return INF.generate(staged, stubs.length_model, "prompt", BATCH).select("doc_id", "response")


@query("failure_accounting", "G6 G5 M9", sql=f"""
WITH b AS (SELECT doc_id, {RENDERED} AS prompt, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id
           FROM documents),
f AS (SELECT *, bool_or(contains(prompt, '@')) OVER (PARTITION BY batch_id) AS bad FROM b)
SELECT doc_id, batch_id, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN bad THEN NULL ELSE 'Final Answer: ' || length(prompt) END AS response
FROM f
""")
def failure_accounting(spark, sf_dir):
    it = items(spark, sf_dir).withColumn("prompt", R.render_single_turn("prompt")).select("doc_id", "prompt")
    batched = assign_batches(it, ["doc_id"], 8).drop("idx")
    gen = INF.generate(batched, stubs.failing_model("@"), "prompt", 8, batch_col="batch_id")
    return gen.select("doc_id", "batch_id", "status", "response")


@query("incremental_generate", "G3 F3 S5", sql=f"""
SELECT doc_id, {LENGTH_ANSWER} AS response, 'ok' AS status FROM documents
""")
def incremental_generate(spark, sf_dir):
    out = scratch_path(spark, "incremental")
    it = items(spark, sf_dir).withColumn("prompt", R.render_single_turn("prompt")).select("doc_id", "prompt")
    # two runs over the same output: the second finds every id done (run twice = run once)
    INF.generate_incremental(it, out, stubs.length_model, "doc_id", "prompt", BATCH, chunk_rows=4000)
    merged = INF.generate_incremental(it, out, stubs.length_model, "doc_id", "prompt", BATCH, chunk_rows=4000)
    return merged.select("doc_id", "response", "status")


@query("resume_chunks", "G3 F3 S5 (chunks, failed rows, second run)", sql=f"""
SELECT doc_id, {LENGTH_ANSWER} AS response, 'ok' AS status, contains(text, '@') AS failed_first FROM documents
""")
def resume_chunks(spark, sf_dir):
    """A first run over many chunks whose model fails on rows with an ``@``, and a second that completes it."""
    out = scratch_path(spark, "resume")
    it = items(spark, sf_dir).withColumn("prompt", R.render_single_turn("prompt")).select("doc_id", "prompt")
    rows = max(1, it.count() // 3)
    first = INF.generate_incremental(it, out, stubs.failing_model("@"), "doc_id", "prompt", 1, chunk_rows=rows)
    failed = first.select("doc_id", (F.col("status") == "failed").alias("failed_first")).write.mode("overwrite")
    failed.parquet(f"{out}-first")
    second = INF.generate_incremental(it, out, stubs.length_model, "doc_id", "prompt", BATCH, chunk_rows=rows)
    return second.join(spark.read.parquet(f"{out}-first"), "doc_id").select("doc_id", "response", "status", "failed_first")


@query("stream_generate", "G4", sql=f"""
SELECT doc_id, {LENGTH_ANSWER} AS response, 'ok' AS status FROM documents
""")
def stream_generate(spark, sf_dir):
    from tesserae.streaming.generate import generate_stream

    base = scratch_path(spark, "stream")
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    q = generate_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet", schema, f"{base}/out", f"{base}/checkpoint",
                        stubs.length_model, id_col="doc_id", prompt_col="text", fmt="parquet", batch_size=BATCH,
                        render=R.render_single_turn)
    q.stop()
    return spark.read.parquet(f"{base}/out").select("doc_id", "response", "status")


@query("stream_retry", "G4 (failed rows come back)", sql=f"""
SELECT doc_id, {LENGTH_ANSWER} AS response, 'ok' AS status, CASE WHEN contains(text, '@') THEN 2 ELSE 1 END AS attempt FROM documents
""")
def stream_retry(spark, sf_dir):
    """A first run whose model fails on rows with an ``@``; the next, without new input, answers them from the retry folder."""
    from tesserae.streaming.generate import generate_stream, read_answers

    base = scratch_path(spark, "stream-retry")
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    for model in (stubs.failing_model("@"), stubs.length_model):
        generate_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet", schema, f"{base}/out", f"{base}/checkpoint", model, id_col="doc_id",
                        prompt_col="text", fmt="parquet", batch_size=1,
                        render=R.render_single_turn).stop()
    return read_answers(spark, f"{base}/out", "doc_id").select("doc_id", "response", "status", "attempt")
