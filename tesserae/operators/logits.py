"""Distillation numerics over stored logits (W4, L1-L9), as a batch audit.

Per-position terms are computed row-wise with array functions; the losses
are grouped aggregates whose denominators follow the reference's three
conventions (valid positions, all positions, sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import logits as LG
from tesserae.functions.tokens import IGNORE_INDEX


def with_top_k(df: DataFrame, logits_col: str, k: int = 20, prefix: str = "top_k") -> DataFrame:
    """``top_k_values`` / ``top_k_indices`` per position (value descending)."""
    t = LG.top_k(logits_col, k)
    return (df.withColumn("_tk", t)
            .withColumn(f"{prefix}_values", F.transform("_tk", lambda s: s["value"]))
            .withColumn(f"{prefix}_indices", F.transform("_tk", lambda s: s["index"]))
            .drop("_tk"))


def align_positions(teacher: DataFrame, student: DataFrame, keys: list[str]) -> DataFrame:
    """Keep positions present on both sides (cut to the shorter sequence)."""
    return teacher.join(student, keys, "inner")


def position_terms(df: DataFrame, teacher_col: str, student_col: str, label_col: str,
                   mask_col: str, temperature: float = 2.0) -> DataFrame:
    """Per position: KL(teacher_T || student_T), student CE at T = 1, validity."""
    t = float(temperature)
    ce = F.when(F.col(label_col) != IGNORE_INDEX,
                -LG.pick(LG.log_softmax(student_col, 1.0), F.col(label_col)))
    return (df.withColumn("kl", LG.kl_position(teacher_col, student_col, t))
            .withColumn("ce", ce)
            .withColumn("valid", (F.col(label_col) != IGNORE_INDEX) & (F.col(mask_col) != 0)))


def shift_labels(df: DataFrame, seq_col: str, pos_col: str, label_col: str,
                 out_col: str | None = None) -> DataFrame:
    """L5 ``shift`` option: the logits at position p predict the label at p+1
    (causal LM convention); the last position gets -100.  The window is one
    sequence, bounded by its length."""
    from pyspark.sql import Window

    w = Window.partitionBy(seq_col).orderBy(pos_col)
    return df.withColumn(out_col or label_col,
                         F.coalesce(F.lead(F.col(label_col)).over(w), F.lit(IGNORE_INDEX)))


def kd_losses(terms: DataFrame, group_cols: list[str], seq_col: str, temperature: float = 2.0,
              alpha: float = 0.5) -> DataFrame:
    """L2-L6 per group.

    kl_masked = sum(kl over valid) / #valid * T^2 (0 when none is valid);
    kl_unmasked = sum(kl) / #positions * T^2;
    kl_per_sequence = sum(kl) / #sequences * T^2;
    ce = mean CE over labels != -100 (masked-out positions still count);
    total = (1 - alpha) * ce + alpha * kl_masked.
    """
    t2 = float(temperature) ** 2
    n_valid = F.count_if("valid")
    agg = terms.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_positions"), n_valid.alias("n_valid"),
        F.count_distinct(seq_col).alias("n_sequences"),
        F.sum(F.when(F.col("valid"), F.col("kl"))).alias("_kl_valid"),
        F.sum("kl").alias("_kl_all"), F.avg("ce").alias("ce"))
    masked = F.when(F.col("n_valid") > 0, F.col("_kl_valid") / F.col("n_valid") * t2).otherwise(F.lit(0.0))
    return (agg.withColumn("kl_masked", masked)
            .withColumn("kl_unmasked", F.col("_kl_all") / F.col("n_positions") * t2)
            .withColumn("kl_per_sequence", F.col("_kl_all") / F.col("n_sequences") * t2)
            .withColumn("total", (1.0 - alpha) * F.coalesce(F.col("ce"), F.lit(0.0)) + alpha * F.col("kl_masked"))
            .drop("_kl_valid", "_kl_all"))


def soft_label_table(positions: DataFrame, seq_col: str, pos_col: str, topk_values: str, topk_indices: str,
                     input_id_col: str, label_col: str, mask_col: str) -> DataFrame:
    """L8 + T6: nest per-position top-k back into per-sequence arrays in
    position order, then cut every array to the true length (mask sum).

    One group per sequence, bounded by the sequence length.
    """
    nested = positions.groupBy(seq_col).agg(F.sort_array(F.collect_list(F.struct(
        F.col(pos_col).alias("pos"), F.col(topk_values).alias("v"), F.col(topk_indices).alias("i"),
        F.col(input_id_col).alias("id"), F.col(label_col).alias("label"), F.col(mask_col).alias("m")))).alias("_p"))
    n = F.aggregate(F.transform("_p", lambda s: s["m"]), F.lit(0), lambda a, x: a + x)
    cut = F.slice("_p", 1, n)
    return nested.select(
        seq_col, F.size("_p").alias("n_positions"), n.alias("true_length"),
        F.transform(cut, lambda s: s["v"]).alias("top_k_values"),
        F.transform(cut, lambda s: s["i"]).alias("top_k_indices"),
        F.transform(cut, lambda s: s["id"]).alias("input_ids"),
        F.transform(cut, lambda s: s["label"]).alias("labels"))


def offline_kd_terms(df: DataFrame, topk_values: str, topk_indices: str, student_col: str,
                     temperature: float = 2.0) -> DataFrame:
    """L9 (extension; undefined in the reference): KL over the k stored teacher
    entries, renormalised over those k, against the full student softmax,
    times T^2.  Output column ``kl_topk`` plus ``teacher_kept_mass``=1 by
    construction of the renormalisation, so the loss is stated as renormalised."""
    t = float(temperature)
    kl = LG.let(LG.softmax_pair(topk_values, t), lambda tp: LG.kl_terms(
        tp["p"], tp["logp"], LG.gather(LG.log_softmax(student_col, t), F.col(topk_indices))))
    return df.withColumn("kl_topk", kl * (t * t))
