"""Scoring (A2-A10, J4, J6, F6, U1, U2): verdict columns and one-pass aggregates.

Every metric is a conditional aggregate over verdict columns, so scoring all
domains is one scan and one ``groupBy`` (map-side partial aggregation; the
shuffle carries one row per group per partition).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as X


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rate(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- verdicts
def exact_match_verdict(pred, ref) -> Column:
    """A2 per row: normalised equality; an unpaired prediction never matches."""
    return F.coalesce(X.normalize_text(pred) == X.normalize_text(ref), F.lit(False))


def contains_match_verdict(pred, ref) -> Column:
    """A3 per row: normalised reference inside normalised prediction (empty matches)."""
    return F.coalesce(F.contains(X.normalize_text(pred), X.normalize_text(ref)), F.lit(False))


def numeric_verdicts(df: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """X1 + X2 + X6 per row, plus the A4 bookkeeping flags."""
    pa, ra = F.col("pred_answer"), F.col("ref_answer")
    return (df.withColumn("pred_answer", X.extract_answer(pred_col))
            .withColumn("ref_answer", X.extract_reference(ref_col))
            .withColumn("correct", F.coalesce(X.approx_equal(pa, ra), F.lit(False)))
            # no prediction: counted and wrong; prediction without reference: excluded
            .withColumn("counted", pa.isNull() | ra.isNotNull())
            .withColumn("no_answer", pa.isNull()))


def keyword_verdicts(df: DataFrame, pred_col: str, ref_col: str) -> DataFrame:
    """X4 + J4 + X5 per row."""
    return (df.withColumn("pred_keywords", X.extract_keywords(pred_col))
            .withColumn("ref_keywords", X.extract_keywords(ref_col))
            .withColumn("keyword_match",
                        F.size(X.keyword_overlap("pred_keywords", "ref_keywords")) > 0)
            .withColumn("substring_match", X.any_token_contained(pred_col, ref_col)))


# ---------------------------------------------------------------- aggregates
def exact_match_aggs(pred, ref) -> list[Column]:
    v = exact_match_verdict(pred, ref)
    return [_rate(F.count_if(v), F.count(F.lit(1))).alias("exact_match")]


def contains_match_aggs(pred, ref) -> list[Column]:
    v = contains_match_verdict(pred, ref)
    return [_rate(F.count_if(v), F.count(F.lit(1))).alias("contains_match")]


def numeric_accuracy_aggs() -> list[Column]:
    """A4 over :func:`numeric_verdicts` columns.

    total counts rows with no prediction or with a reference; exact_match
    divides by it; no_answer_rate divides by all rows.
    """
    total = F.count_if(F.col("counted"))
    correct = F.count_if(F.col("counted") & F.col("correct"))
    no_answer = F.count_if(F.col("no_answer"))
    return [total.alias("total_samples"), correct.alias("correct_samples"),
            no_answer.alias("no_answer_samples"),
            _rate(correct, total).alias("exact_match"),
            _rate(no_answer, F.count(F.lit(1))).alias("no_answer_rate")]


def numeric_accuracy(df: DataFrame, pred_col: str, ref_col: str,
                     group_cols: list[str] | None = None) -> DataFrame:
    """A4 (+A9 via :func:`with_overall`)."""
    scored = numeric_verdicts(df, pred_col, ref_col)
    return scored.groupBy(*(group_cols or [])).agg(*numeric_accuracy_aggs())


def pass_at_1_aggs(passed_col: str = "passed") -> list[Column]:
    """A5: passed / all rows."""
    p = F.coalesce(F.col(passed_col), F.lit(False))
    return [F.count(F.lit(1)).alias("total_samples"), F.count_if(p).alias("passed_samples"),
            _rate(F.count_if(p), F.count(F.lit(1))).alias("pass_at_1")]


def pass_at_k_value(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k estimator ``1 - C(n-c, k) / C(n, k)`` as a stable product
    ``1 - prod_{i=n-c+1..n} (1 - k / i)``; null, undefined, with fewer than k attempts."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i.cast("double")))
    return (F.when(n < k, F.lit(None).cast("double"))
            .when(c <= 0, F.lit(0.0))
            .when(n - c < k, F.lit(1.0))
            .otherwise(F.lit(1.0) - prod))


def pass_at_k(df: DataFrame, task_col: str, passed_col: str, ks=(1, 5, 10),
              group_cols: list[str] | None = None) -> DataFrame:
    """Per task n attempts, c passed; mean pass@k over the tasks of at least k
    attempts (``n_tasks``; ``n_left_out`` have fewer), one row per k."""
    g = list(group_cols or [])
    per_task = (df.groupBy(*g, task_col)
                .agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.coalesce(F.col(passed_col), F.lit(False))).alias("c")))
    vals = F.array(*[F.struct(F.lit(k).alias("k"), pass_at_k_value(F.col("n"), F.col("c"), k).alias("v"))
                     for k in ks])
    exploded = per_task.select(*g, F.inline(vals))
    return exploded.groupBy(*g, "k").agg(F.avg("v").alias("pass_at_k"), F.count("v").alias("n_tasks"),
                                         F.count_if(F.col("v").isNull()).alias("n_left_out"))


def keyword_aggs() -> list[Column]:
    """A7 + A8 over :func:`keyword_verdicts` columns."""
    n = F.count(F.lit(1))
    return [n.alias("total_samples"),
            _rate(F.count_if(F.col("keyword_match")), n).alias("keyword_match_rate"),
            _rate(F.count_if(F.col("substring_match")), n).alias("substring_match_rate")]


def with_overall(df: DataFrame, group_col: str, aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Per-group rows plus an overall row in one pass (ROLLUP); rows without a group are the group ``unknown``."""
    name = F.when(F.col("_overall") == 1, F.lit(label)).otherwise(F.coalesce(F.col(group_col).cast("string"), F.lit("unknown")))
    return (df.rollup(group_col).agg(*aggs, F.grouping(group_col).alias("_overall"))
            .withColumn(group_col, name).drop("_overall"))


# ---------------------------------------------------------------- registries
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "exact_match": exact_match_verdict,
    "contains": contains_match_verdict,
}


def metric(name: str, pred, ref) -> Column:
    """Metric by name; an unknown name is an error."""
    try:
        fn = METRICS[name]
    except KeyError:
        raise ValueError(f"Unknown metric type: {name}") from None
    return fn(_col(pred), _col(ref))


def register_metric(name: str, fn: Callable[[Column, Column], Column]) -> None:
    METRICS[name] = fn


@dataclass(frozen=True)
class Scorer:
    """How the rows of one domain are scored.

    ``verdicts``: steps of per-row columns, each step a function of the names of
    the prediction, reference and passed columns; a step may read the columns
    of earlier ones.  They are evaluated only for the domain's rows; a column
    that several scorers name is shared and follows the row's domain.
    ``metrics``: the aggregates over them, by name, with ``total_samples`` among
    them.  ``headline``: the metric that stands for the domain, ``label`` its
    printed name."""

    verdicts: tuple[Callable[[str, str, str], dict[str, Column]], ...]
    metrics: Callable[[], dict[str, Column]]
    headline: str
    label: str | None = None


def _math_metrics() -> dict[str, Column]:
    counted = F.count_if("counted")
    return {"total_samples": counted,
            "exact_match": _rate(F.count_if(F.col("counted") & F.col("correct")), counted),
            "no_answer_rate": _rate(F.count_if(F.col("pred_answer").isNull()), F.count(F.lit(1)))}


def _code_metrics() -> dict[str, Column]:
    n = F.count(F.lit(1))
    # no verdict at all is not a failure of every row: the rate is unknown
    return {"total_samples": n,
            "pass_at_1": F.when(F.count("passed") > 0, _rate(F.count_if(F.coalesce("passed", F.lit(False))), n))}


def _incident_metrics() -> dict[str, Column]:
    n = F.count(F.lit(1))
    return {"total_samples": n, "keyword_match_rate": _rate(F.count_if("keyword_match"), n),
            "substring_match_rate": _rate(F.count_if("substring_match"), n)}


SCORERS: dict[str, Scorer] = {
    "math": Scorer(
        (lambda p, r, v: {"pred_answer": X.extract_answer(p), "ref_answer": X.extract_reference(r)},
         lambda p, r, v: {"counted": F.col("pred_answer").isNull() | F.col("ref_answer").isNotNull(),
                          "correct": F.coalesce(X.approx_equal("pred_answer", "ref_answer"), F.lit(False))}),
        _math_metrics, "exact_match"),
    "code": Scorer((lambda p, r, v: {"passed": F.col(v)},), _code_metrics, "pass_at_1", "pass@1"),
    "aiops": Scorer(
        (lambda p, r, v: {"pred_keywords": X.extract_keywords(p), "ref_keywords": X.extract_keywords(r),
                          "substring_match": X.any_token_contained(p, r)},
         lambda p, r, v: {"keyword_match": F.size(F.array_intersect("pred_keywords", "ref_keywords")) > 0}),
        _incident_metrics, "keyword_match_rate"),
}


def register_scorer(domain: str, scorer: Scorer) -> None:
    """Score ``domain`` by ``scorer`` from now on, in :func:`evaluate`, its details and its report."""
    SCORERS[domain] = scorer


def _by_domain(domain: Column, parts: dict[str, Column]) -> Column:
    """The part of the row's domain; null for any other."""
    out = None
    for name, c in parts.items():
        out = F.when(domain == name, c) if out is None else out.when(domain == name, c)
    return out


def verdict_columns(scorers: dict[str, Scorer] | None = None, pred_col: str = "prediction", ref_col: str = "reference",
                    passed_col: str = "passed") -> list[dict[str, dict[str, Column]]]:
    """Per step: each verdict column with its expression by domain."""
    steps: list[dict[str, dict[str, Column]]] = []
    for domain, scorer in (SCORERS if scorers is None else scorers).items():
        for i, step in enumerate(scorer.verdicts):
            if i == len(steps):
                steps.append({})
            for name, c in step(pred_col, ref_col, passed_col).items():
                steps[i].setdefault(name, {})[domain] = c
    return steps


def with_verdicts(df: DataFrame, domain_col: str = "domain", pred_col: str = "prediction", ref_col: str = "reference",
                  passed_col: str = "passed", scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """``df`` with the verdict columns of every scorer, null outside its domain: one projection a step."""
    for step in verdict_columns(scorers, pred_col, ref_col, passed_col):
        columns = {name: _by_domain(F.col(domain_col), parts) for name, parts in step.items()}
        df = df.select(*[F.col(c) for c in df.columns if c not in columns], *[c.alias(name) for name, c in columns.items()])
    return df


def evaluate(df: DataFrame, domain_col: str = "domain", pred_col: str = "prediction",
             ref_col: str = "reference", passed_col: str = "passed", scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """Score every domain in one scan and one ``groupBy``, by the registered scorers.

    Verdicts are computed under ``when(domain == ...)`` so each row only pays
    for its own scorer.  Output: one row per domain with every metric (null
    where it does not apply), the headline metric and its ``x.x%`` text (A10),
    plus a ``scored`` flag: domains without a scorer are reported, not dropped.
    """
    base = df.select(domain_col, pred_col, ref_col, passed_col)
    return summarize(with_verdicts(base, domain_col, pred_col, ref_col, passed_col, scorers), domain_col, scorers)


def summarize(verdicts: DataFrame, domain_col: str = "domain", scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """:func:`evaluate` over rows that have their verdict columns already."""
    scorers = SCORERS if scorers is None else scorers
    m, metrics = F.col(domain_col), {}
    for domain, scorer in scorers.items():
        for name, c in scorer.metrics().items():
            metrics.setdefault(name, {})[domain] = c
    agg = verdicts.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                           *[_by_domain(m, parts).alias(name) for name, parts in metrics.items()])
    headline = _by_domain(m, {d: F.col(x.headline) for d, x in scorers.items()})
    label = _by_domain(m, {d: F.lit(x.label or x.headline) for d, x in scorers.items()})
    return agg.select("*", label.alias("headline_metric"), headline.alias("headline_value"),
                      X.format_percent1(headline).alias("headline_text"), m.isin(*scorers).alias("scored"))


def long_report(report: DataFrame, domain_col: str = "domain") -> DataFrame:
    """S7, long form: ``domain, metric, value`` of each metric that applies, whatever the scorers name, and the overall total.

    ``report`` has a row per domain: windows over all of it give the total
    without a second evaluation."""
    metrics = [c for c in report.columns if c not in (domain_col, "n_rows", "headline_metric", "headline_value", "headline_text", "scored")]
    everything = Window.partitionBy()
    rep = (report.withColumn("_all", F.sum(F.when(F.col("scored"), F.col("total_samples"))).over(everything))
           .withColumn("_first", F.col(domain_col).eqNullSafe(F.min(domain_col).over(everything))))

    def item(domain: Column, metric: str, value: Column, keep: Column) -> Column:
        return F.when(keep & value.isNotNull(), F.struct(domain.alias("domain"), F.lit(metric).alias("metric"),
                                                         value.cast("double").alias("value")))

    items = [item(F.col(domain_col), m, F.col(m), F.col("scored")) for m in metrics]
    items.append(item(F.lit("ALL"), "total_samples", F.col("_all"), F.col("_first")))
    stacked = rep.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("m"))
    return stacked.select("m.domain", "m.metric", "m.value")


def overall_total(report: DataFrame) -> DataFrame:
    """Sum of the per-domain totals of scored domains."""
    return report.filter(F.col("scored")).agg(F.sum("total_samples").alias("total_samples"))
