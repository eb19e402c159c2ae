"""End-to-end jobs over files: the reference's entry points as Spark jobs.

Each job reads JSON Lines (or a JSON array), composes the operators, and
writes JSON Lines directories.  They return small DataFrames (counts,
reports) for the caller to show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.operators import inference as INF
from tesserae.operators import records as REC
from tesserae.operators import reports as REP
from tesserae.operators import sampling as M
from tesserae.operators import scoring as S
from tesserae.sources import jsonl as J

MATH_RAW = "question string, answer string"
CODE_RAW = "task_id string, prompt string, canonical_solution string, test string, entry_point string"
RECORD_IN = ("id string, domain string, difficulty string, prompt string, expected_answer string, "
             "original_answer string, teacher_response string, metadata struct<source:string, "
             "original_index:bigint, task_id:string, test_cases:string, entry_point:string, scenario:string, "
             "fix_plan:array<string>>")


def _read_any(spark: SparkSession, path: str, schema: str, array: bool) -> DataFrame:
    return J.read_json_array(spark, path, schema) if array else J.read_jsonl(spark, path, schema)


def prepare_corpus(spark: SparkSession, math_path: str | None, code_path: str | None, out_dir: str,
                   math_n: int | None = None, code_n: int | None = None, incident_n: int = 1000,
                   seed: int = 42, eval_cap: int | None = 350, raw_is_array: bool = True,
                   mode: str = "errorifexists") -> DataFrame:
    """3.1: math sample (P1, M1) + code head (P2, M2) + synthetic incidents
    (P3, P4) -> union (J5) -> seeded split (M3, M4) -> ``train``/``eval``
    JSON Lines under ``out_dir``.  Returns the split/domain counts (A1, A16).

    A missing source is skipped, as in the reference.  The math sample and its
    ids are keyed by the text of a question and its answer, and code tasks are
    taken in the order of their ids (numbers in them by size), so how a source
    is split into files or partitions changes nothing.
    """
    parts = []
    if math_path:
        raw = _read_any(spark, math_path, MATH_RAW, raw_is_array)
        text = F.to_json(F.struct("question", "answer"), {"ignoreNullFields": "false"})
        parts.append(REC.normalize_math(raw.withColumn("_key", F.md5(text)), "question", "answer", "_key", math_n, seed,
                                        answer_field="original_answer"))
    if code_path:
        raw = _read_any(spark, code_path, CODE_RAW, raw_is_array)
        number = F.regexp_extract("task_id", r"([0-9]{1,18})$", 1).try_cast("long")
        ordered = raw.withColumn("_stem", F.regexp_replace("task_id", r"[0-9]{1,18}$", "")).withColumn("_number", number)
        parts.append(REC.normalize_code(ordered, "task_id", "prompt", "canonical_solution", "test", "entry_point",
                                        ["_stem", "_number", "task_id"], code_n, answer_field="original_answer"))
    if incident_n:
        driver = spark.range(incident_n).withColumnRenamed("id", "i")
        parts.append(REC.synthesize_incidents(driver, "i", seed, answer_field="original_answer"))
    corpus = REC.union_corpora(*parts)
    split = M.label_split(corpus, "id", seed, cap=eval_cap)
    J.write_jsonl(split.filter(F.col("split") == "train").drop("split"), f"{out_dir}/train", mode)
    J.write_jsonl(split.filter(F.col("split") == "eval").drop("split"), f"{out_dir}/eval", mode)
    train, held = (J.read_jsonl(spark, f"{out_dir}/{part}", RECORD_IN).withColumn("split", F.lit(part)) for part in ("train", "eval"))
    written = train.unionByName(held)
    return REP.domain_counts(written, ["split", "domain"], "count")


def teacher_responses(spark: SparkSession, items_path: str, out_dir: str, model_factory,
                      batch_size: int = 512, params: dict | None = None, chunk_rows: int = 10_000_000,
                      max_failure_rate: float = 0.0, instances: int = 1) -> DataFrame:
    """3.2: items -> resumable generation (G3, single-turn prompt P8) ->
    attach (P13) -> ``taught`` JSON Lines with their provenance (G5, record R4):
    ``instance_id``, which of ``instances`` contiguous shards of the items by id a
    row is of, and ``batch_id``, its batch of ``batch_size`` there (M8, M9).
    Rerunning resumes; ids already answered are skipped, failed ones tried
    again.  Fails when more than ``max_failure_rate`` of the rows failed (G6)."""
    items = J.read_jsonl(spark, items_path, RECORD_IN)
    staged = items.select("id", R.render_single_turn("prompt").alias("_rendered"))
    gen = INF.generate_incremental(staged, f"{out_dir}/_generated", model_factory, "id", "_rendered",
                                   batch_size, params, chunk_rows)
    INF.check_failures(gen, max_failure_rate)
    taught = REC.attach_response(items, gen.filter(F.col("status") == "ok").select("id", "response"),
                                 "id", "response")
    placed = M.assign_shards(items.select("id"), ["id"], instances, batch_size, "instance_id", "batch_id").select(
        "id", F.col("instance_id").cast("int").alias("instance_id"), F.col("batch_id").cast("int").alias("batch_id"))
    taught = taught.join(placed, "id")
    J.write_jsonl(taught, f"{out_dir}/taught", "overwrite")
    return taught.groupBy("response_status").count()


# The generation settings of an evaluation run.
EVALUATION_SETTINGS = {"max_new_tokens": 512, "temperature": 0.1, "top_p": 0.95, "do_sample": True}


def run_evaluation(spark: SparkSession, eval_path: str, out_dir: str, model_factory,
                   generation_kwargs: dict | None = None, batch_size: int = 4, model_path: str | None = None,
                   verdicts: DataFrame | None = None) -> DataFrame:
    """3.3: eval records -> predictions (G1) -> per-row verdicts -> per-domain
    details (S6) and the report (S7).  Returns the report table.

    Model code is not executed here: ``verdicts`` (``id, passed, error``) brings
    what its tests said, paired by id; a row without one has failed, and
    without any the pass rate is null.  The details hold the verdicts of each
    domain (``pred_answer, ref_answer, correct``; ``extracted_code, passed,
    error``; ``pred_keywords, ref_keywords, keyword_match, substring_match``).
    """
    params = {**EVALUATION_SETTINGS, **(generation_kwargs or {})}
    items = J.read_jsonl(spark, eval_path, RECORD_IN)
    staged = items.withColumn("_rendered", R.render_single_turn("prompt"))
    fresh = INF.generate(staged, model_factory, "_rendered", batch_size, params)
    fresh.write.mode("overwrite").parquet(f"{out_dir}/predictions")  # one model pass: details and report read its answers
    pred = spark.read.schema(fresh.schema).parquet(f"{out_dir}/predictions")
    INF.evaluation_rows(pred, verdicts).write.mode("overwrite").parquet(f"{out_dir}/verdicts")
    detail = spark.read.parquet(f"{out_dir}/verdicts")
    J.write_detailed_results(detail, f"{out_dir}/detailed")
    report = S.summarize(detail)
    J.write_report(report, f"{out_dir}/report", params, header={"model_path": model_path, "eval_data_path": eval_path})
    return report


LOSS_FIELDS, GENERATION_FIELDS = "role string, text_id string, loss double, n_tokens long", "role string, prompt_id string, generated string"


def distillation_report(spark: SparkSession, losses_path: str | dict[str, str], generations_path: str | dict[str, str] | None,
                        out_dir: str, text_limits: dict | None = None, gen_limits: dict | None = None) -> DataFrame:
    """3.4 / G10: per-role perplexity, loss, generation length, improvement.

    Paths by role make each role a leg of its own: one that cannot be read is
    recorded in ``error`` and the others are reported."""
    if isinstance(losses_path, dict):
        leg = lambda path, fields: lambda: J.read_jsonl(spark, path, fields)
        rep = REP.leg_report(spark, {r: leg(p, LOSS_FIELDS) for r, p in losses_path.items()},
                             {r: leg(p, GENERATION_FIELDS) for r, p in (generations_path or {}).items()})
    else:
        gens = J.read_jsonl(spark, generations_path, GENERATION_FIELDS) if generations_path else None
        rep = REP.teacher_student_report(J.read_jsonl(spark, losses_path, LOSS_FIELDS), gens, text_limits, gen_limits)
    J.write_jsonl(rep, f"{out_dir}/report", "overwrite")
    return rep


def compare_models(spark: SparkSession, eval_path: str, out_dir: str, models: dict, mode: str = "full",
                   batch_size: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Model comparison (G8): sample by mode (M7), run every model (G7),
    side by side (J2), timing (A14).  Returns (results, timing)."""
    items = J.read_jsonl(spark, eval_path, RECORD_IN).withColumn("_seq", F.monotonically_increasing_id())
    sample = M.mode_sample(items, mode, "domain", "_seq", "id", seed).drop("_seq")
    results = INF.compare_models(sample, models, "id", "prompt", batch_size)
    J.write_jsonl(results, f"{out_dir}/results", "overwrite")
    written = spark.read.json(f"{out_dir}/results")
    timing = written.select(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_time").alias("t")).alias(m)
                              for m in models])
    stacked = timing.select(F.explode(F.array(*[F.col(m) for m in models])).alias("x")).select("x.*")
    summary = stacked.groupBy("model").agg(F.sum("t").alias("total_time"), F.count(F.lit(1)).alias("n_rows"),
                                           F.avg("t").alias("avg_time_per_row"))
    return written, summary
