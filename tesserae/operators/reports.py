"""Reports (A1, A11-A16, W5, W6): aggregates that feed the run report.

All are grouped aggregates with map-side partial aggregation; none pulls rows
to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.sampling import top_per_group


def domain_counts(df: DataFrame, keys: list[str] | str = "domain", name: str = "count") -> DataFrame:
    """Rows per domain (or per split and domain)."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def corpus_perplexity(df: DataFrame, group_cols: list[str], loss_col: str = "loss",
                      tokens_col: str = "n_tokens") -> DataFrame:
    """Token-weighted mean loss and ``exp`` of it; no tokens -> null."""
    w = F.sum(F.col(loss_col) * F.col(tokens_col))
    n = F.sum(F.col(tokens_col))
    mean = F.try_divide(w, n.cast("double"))
    return (df.groupBy(*group_cols)
            .agg(mean.alias("avg_loss"), n.alias("total_tokens"), F.count(F.lit(1)).alias("n_texts"))
            .withColumn("perplexity", F.exp("avg_loss")))


def improvement_pct(baseline: Column, student: Column) -> Column:
    """``(baseline - student) / baseline * 100`` only when both sides are
    present and non-zero (the reference's truthiness test)."""
    ok = baseline.isNotNull() & student.isNotNull() & (baseline != 0) & (student != 0)
    return F.when(ok, (baseline - student) / baseline * F.lit(100.0))


def role_pivot(per_role: DataFrame, group_cols: list[str], role_col: str, value_cols: list[str],
               roles: list[str]) -> DataFrame:
    """Wide form of a per-role table, one conditional aggregate per (role, value)."""
    aggs = [F.max(F.when(F.col(role_col) == r, F.col(v))).alias(f"{r}_{v}")
            for r in roles for v in value_cols]
    return per_role.groupBy(*group_cols).agg(*aggs)


def convergence(log: DataFrame, run_col: str, step_col: str, loss_col: str) -> DataFrame:
    """A13 + W6: first and last logged loss per run, % change and verdict.

    Needs at least two logged losses; otherwise the run gets a null verdict.
    ``min_by``/``max_by`` aggregate map-side, so a long run is never gathered
    into one task.
    """
    logged = log.filter(F.col(loss_col).isNotNull())
    agg = logged.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_logged"),
        F.min_by(loss_col, step_col).alias("initial_loss"),
        F.max_by(loss_col, step_col).alias("final_loss"))
    imp = F.try_divide(F.col("initial_loss") - F.col("final_loss"), F.col("initial_loss")) * F.lit(100.0)
    enough = F.col("n_logged") >= 2
    verdict = (F.when(~enough | F.col("improvement_pct").isNull(), F.lit(None).cast("string"))
               .when(F.col("improvement_pct") > 10, "excellent")
               .when(F.col("improvement_pct") > 5, "good")
               .when(F.col("improvement_pct") > 0, "positive")
               .otherwise("diverging"))
    return (agg.withColumn("improvement_pct", F.when(enough, imp))
            .withColumn("verdict", verdict))


def log_tail(log: DataFrame, run_col: str, step_col: str, n: int = 10) -> DataFrame:
    """The last n log rows per run, a long run cut down in two levels
    (:func:`~tesserae.operators.sampling.top_per_group`)."""
    return top_per_group(log, [run_col], [F.col(step_col).desc()], n, "rank_from_end", [step_col])


def timing(rows: DataFrame, model_col: str, batch_col: str = "batch_key", start_col: str = "batch_started",
           end_col: str = "batch_ended") -> DataFrame:
    """Per model, total seconds, number of batches and rows and the average time per row.

    Rows carry the key, start and end of their batch; a batch is counted once,
    from its first start to its last end.  Rows without a key ran in no batch
    and are left out.  Both steps combine map-side."""
    batches = rows.filter(F.col(batch_col).isNotNull()).groupBy(model_col, batch_col).agg(
        (F.max(end_col) - F.min(start_col)).alias("_seconds"), F.count(F.lit(1)).alias("_rows"))
    return batches.groupBy(model_col).agg(
        F.sum("_seconds").alias("total_time"), F.count(F.lit(1)).alias("n_batches"), F.sum("_rows").alias("n_rows"),
        (F.sum("_seconds") / F.sum("_rows")).alias("avg_time_per_row"))


def model_batches(generated: DataFrame, models: list[str]) -> DataFrame:
    """The rows of a single-pass comparison as one row per model: ``model, batch_key, batch_started, batch_ended``."""
    return generated.select("batch_key", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_started").alias("batch_started"), F.col(f"{m}_ended").alias("batch_ended"))
        for m in models])))


def generation_length_profile(df: DataFrame, text_col: str, group_cols: list[str]) -> DataFrame:
    """Character length of answers, profiled with exact percentiles."""
    n = F.length(F.col(text_col))
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(n).alias("avg_length"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        F.percentile(n, F.lit(0.5)).alias("median_length"))


def teacher_student_report(losses: DataFrame, generations: DataFrame | None = None,
                           text_limits: dict[str, int] | None = None, gen_limits: dict[str, int] | None = None,
                           role_col: str = "role", text_id_col: str = "text_id", loss_col: str = "loss",
                           tokens_col: str = "n_tokens", gen_id_col: str = "prompt_id",
                           gen_text_col: str = "generated", roles=("student", "baseline", "teacher")
                           ) -> DataFrame:
    """One row per role: A11 perplexity/loss over the role's first
    ``text_limits[role]`` texts (all when absent), A15 mean generation length
    over its first ``gen_limits[role]`` prompts, and A12 improvements of the
    student over the baseline (on the student row).  A role without texts is
    kept with ``error = 'no texts'`` instead of failing the report.
    """
    def first_n(df: DataFrame, limits: dict[str, int] | None, order_col: str) -> DataFrame:
        if not limits:
            return df
        lim = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
        ranked = top_per_group(df, [role_col], [order_col], max(limits.values()), "_r", [order_col])
        return ranked.filter(F.col("_r") <= F.coalesce(F.try_element_at(lim, F.col(role_col)),
                                                      F.lit(max(limits.values())))).drop("_r")

    spark = losses.sparkSession
    base = spark.createDataFrame([(r,) for r in roles], f"{role_col} string")
    ppl = corpus_perplexity(first_n(losses, text_limits, text_id_col), [role_col], loss_col, tokens_col) \
        .select(role_col, "perplexity", F.col("avg_loss").alias("loss"), "n_texts")
    # one row per role: a broadcast of the fixed role list
    out = base.join(ppl, role_col, "left")
    if generations is not None:
        g = first_n(generations, gen_limits, gen_id_col).groupBy(role_col).agg(
            F.avg(F.length(gen_text_col)).alias("avg_generation_length"),
            F.count(F.lit(1)).alias("n_generations"))
        out = out.join(g, role_col, "left")
    return _improved(out.withColumn("error", F.when(F.col("n_texts").isNull(), F.lit("no texts"))), role_col)


def _improved(out: DataFrame, role_col: str) -> DataFrame:
    """A12 on the student's row; ``error`` last."""
    # the per-role table has one row per role: a window over all of it is bounded
    everything = Window.partitionBy()
    bp = F.max(F.when(F.col(role_col) == "baseline", F.col("perplexity"))).over(everything)
    bl = F.max(F.when(F.col(role_col) == "baseline", F.col("loss"))).over(everything)
    is_student = F.col(role_col) == "student"
    return (out.withColumn("_bp", bp).withColumn("_bl", bl)
            .withColumn("perplexity_improvement_pct",
                        F.when(is_student, improvement_pct(F.col("_bp"), F.col("perplexity"))))
            .withColumn("loss_improvement_pct", F.when(is_student, improvement_pct(F.col("_bl"), F.col("loss"))))
            .select(*[c for c in out.columns if c != "error"], "perplexity_improvement_pct", "loss_improvement_pct", "error"))


def leg_report(spark, legs: dict[str, Callable[[], DataFrame]], generations: dict[str, Callable[[], DataFrame]] | None = None,
               role_col: str = "role", loss_col: str = "loss", tokens_col: str = "n_tokens", gen_text_col: str = "generated") -> DataFrame:
    """G10 with legs of their own: a leg that fails is recorded and the others go on.

    ``legs``: by role, what gives its per-text losses, ``generations`` its
    answers.  Each is evaluated by itself, one aggregate row a leg; whatever
    it raises (a missing file, a malformed row) becomes the row's ``error``, after
    what did work.  A role without texts has the error ``no texts``."""
    rows = []
    for role, losses in legs.items():
        found, errors = [None] * 5, []
        for at, make, aggs in ((0, losses, [F.exp(F.try_divide(F.sum(F.col(loss_col) * F.col(tokens_col)), F.sum(tokens_col).cast("double"))),
                                            F.try_divide(F.sum(F.col(loss_col) * F.col(tokens_col)), F.sum(tokens_col).cast("double")), F.count(F.lit(1))]),
                               (3, (generations or {}).get(role), [F.avg(F.length(gen_text_col)), F.count(F.lit(1))])):
            if make is None:
                continue
            try:
                found[at:at + len(aggs)] = list(make().agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first())
            except Exception as e:  # noqa: BLE001 - a leg's failure is a result of the report
                errors.append(f"{type(e).__name__}: {str(e).splitlines()[0]}")
        if not errors and not found[2]:
            found[2] = None
            errors.append("no texts")
        rows.append((role, *found, "; ".join(errors) or None))
    out = spark.createDataFrame(rows, f"{role_col} string, perplexity double, loss double, n_texts long, avg_generation_length double, "
                                      "n_generations long, error string")
    return _improved(out, role_col)
