"""Logit queries over ``embeddings`` read as logits.

Derivation: each row's 64 floats are one position's logits over a 64-token
vocabulary.  Even ``vec_id`` rows are the teacher, the next odd row the
student at the same position; ``pair = vec_id div 2``, sequence =
``pair div 4``, position = ``pair % 4``; label = the teacher row's label (0
means ignored, -100), attention = 0 where the student row's label is 9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import logits as LO
from tesserae.plans.registry import query, table

T = 2.0
ALPHA = 0.5
K = 20


def _stages(prefix: str, arr: str, temp: float) -> str:
    """DuckDB: z, max-shifted exp, log-softmax and softmax of ``arr / temp``."""
    z = f"{prefix}z"
    return (f"list_transform({arr}, lambda x: CAST(x AS DOUBLE) / {temp}) AS {z}")


def pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    role_even = F.pmod(F.col("vec_id"), F.lit(2)) == 0
    t = e.filter(role_even).select((F.col("vec_id") / 2).cast("long").alias("pair_id"),
                                   F.col("embedding").alias("teacher"), F.col("label").alias("t_label"))
    s = e.filter(~role_even).select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id"),
                                    F.col("embedding").alias("student"), F.col("label").alias("s_label"))
    p = LO.align_positions(t, s, ["pair_id"])
    return p.select("pair_id", F.floor(F.col("pair_id") / 4).cast("long").alias("seq_id"),
                    F.pmod(F.col("pair_id"), F.lit(4)).alias("pos"), "teacher", "student",
                    F.when(F.col("t_label") == 0, F.lit(-100)).otherwise(F.col("t_label")).alias("label"),
                    F.when(F.col("s_label") == 9, F.lit(0)).otherwise(F.lit(1)).alias("attn"))


PAIRS_SQL = """
t AS (SELECT vec_id // 2 AS pair_id, embedding AS teacher, label AS t_label FROM embeddings WHERE vec_id % 2 = 0),
s AS (SELECT vec_id // 2 AS pair_id, embedding AS student, label AS s_label FROM embeddings WHERE vec_id % 2 = 1),
p AS (SELECT pair_id, pair_id // 4 AS seq_id, pair_id % 4 AS pos, teacher, student,
             CASE WHEN t_label = 0 THEN -100 ELSE t_label END AS label,
             CASE WHEN s_label = 9 THEN 0 ELSE 1 END AS attn
      FROM t JOIN s USING (pair_id))"""


def _lsm_sql(src: str, arr: str, temp: float, tag: str) -> str:
    """CTE chain computing ``{tag}_logp`` and ``{tag}_p`` for ``arr / temp``."""
    return f"""
{tag}1 AS (SELECT *, list_transform({arr}, lambda x: CAST(x AS DOUBLE) / {temp}) AS {tag}_z FROM {src}),
{tag}2 AS (SELECT *, list_max({tag}_z) AS {tag}_m FROM {tag}1),
{tag}3 AS (SELECT *, list_transform({tag}_z, lambda v: exp(v - {tag}_m)) AS {tag}_e FROM {tag}2),
{tag}4 AS (SELECT *, list_reduce({tag}_e, lambda a, b: a + b) AS {tag}_s FROM {tag}3),
{tag}5 AS (SELECT *, list_transform({tag}_z, lambda v: (v - {tag}_m) - ln({tag}_s)) AS {tag}_logp,
                 list_transform({tag}_e, lambda v: v / {tag}_s) AS {tag}_p FROM {tag}4)"""


TERMS_SQL = f"""{PAIRS_SQL},{_lsm_sql('p', 'teacher', T, 'ta')},{_lsm_sql('ta5', 'student', T, 'st')},
{_lsm_sql('st5', 'student', 1.0, 'sc')},
terms AS (
  SELECT pair_id, seq_id, pos, label, attn, seq_id // 4 AS batch_id,
    list_reduce(list_transform(ta_p, lambda x, i: x * (ta_logp[i] - st_logp[i])), lambda a, b: a + b) AS kl,
    CASE WHEN label <> -100 THEN -sc_logp[label + 1] END AS ce,
    label <> -100 AND attn <> 0 AS valid
  FROM sc5)"""


def position_terms(spark, sf_dir) -> DataFrame:
    return LO.position_terms(pairs(spark, sf_dir), "teacher", "student", "label", "attn", T) \
        .withColumn("batch_id", F.floor(F.col("seq_id") / 4).cast("long"))


LOSS_SQL = f"""
WITH {TERMS_SQL}
SELECT batch_id, count(*) AS n_positions, CAST(count_if(valid) AS BIGINT) AS n_valid,
  count(DISTINCT seq_id) AS n_sequences,
  round(CASE WHEN count_if(valid) > 0 THEN sum(CASE WHEN valid THEN kl END) / count_if(valid) * {T * T} ELSE 0.0 END, 6)
    AS kl_masked,
  round(sum(kl) / count(*) * {T * T}, 6) AS kl_unmasked,
  round(sum(kl) / count(DISTINCT seq_id) * {T * T}, 6) AS kl_per_sequence,
  round(avg(ce), 6) AS ce,
  round({1 - ALPHA} * coalesce(avg(ce), 0.0) + {ALPHA} *
        CASE WHEN count_if(valid) > 0 THEN sum(CASE WHEN valid THEN kl END) / count_if(valid) * {T * T} ELSE 0.0 END, 6)
    AS total
FROM terms GROUP BY batch_id
"""

LOSS_COLS = ["kl_masked", "kl_unmasked", "kl_per_sequence", "ce", "total"]


def _losses(spark, sf_dir) -> DataFrame:
    out = LO.kd_losses(position_terms(spark, sf_dir), ["batch_id"], "seq_id", T, ALPHA)
    return out.select("batch_id", "n_positions", "n_valid", "n_sequences",
                      *[F.round(c, 6).alias(c) for c in LOSS_COLS])


def _loss_query(cols: list[str]):
    def fn(spark, sf_dir):
        return _losses(spark, sf_dir).select("batch_id", "n_positions", "n_valid", "n_sequences", *cols)
    return fn


def _loss_sql(cols: list[str]) -> str:
    return (f"SELECT batch_id, n_positions, n_valid, n_sequences, {', '.join(cols)} FROM ({LOSS_SQL})")


query("kd_loss_masked", "L1 L2 F5 L7", sql=_loss_sql(["kl_masked"]))(_loss_query(["kl_masked"]))
query("kd_loss_unmasked", "L1 L3", sql=_loss_sql(["kl_unmasked"]))(_loss_query(["kl_unmasked"]))
query("kd_loss_per_sequence", "L1 L4", sql=_loss_sql(["kl_per_sequence"]))(_loss_query(["kl_per_sequence"]))
query("distillation_loss", "L5 L6 L2", sql=_loss_sql(["kl_masked", "ce", "total"]))(
    _loss_query(["kl_masked", "ce", "total"]))


# ------------------------------------------------------------- L5 shift / L7 unequal lengths
@query("kd_loss_shifted", "L5 (shift) L2 L7 (unequal lengths)", sql=f"""
WITH {PAIRS_SQL},
cut AS (SELECT * EXCLUDE (label), coalesce(lead(label) OVER (PARTITION BY seq_id ORDER BY pos), -100) AS label FROM p WHERE pos < 2 + seq_id % 3),
{_lsm_sql('cut', 'teacher', T, 'ta')},{_lsm_sql('ta5', 'student', T, 'st')},{_lsm_sql('st5', 'student', 1.0, 'sc')},
terms AS (
  SELECT seq_id // 4 AS batch_id, label <> -100 AND attn <> 0 AS valid, CASE WHEN label <> -100 THEN -sc_logp[label + 1] END AS ce,
    list_reduce(list_transform(ta_p, lambda x, i: x * (ta_logp[i] - st_logp[i])), lambda a, b: a + b) AS kl
  FROM sc5)
SELECT batch_id, count(*) AS n_positions, CAST(count_if(valid) AS BIGINT) AS n_valid, round(avg(ce), 6) AS ce,
  round(CASE WHEN count_if(valid) > 0 THEN sum(CASE WHEN valid THEN kl END) / count_if(valid) * {T * T} ELSE 0.0 END, 6) AS kl_masked
FROM terms GROUP BY batch_id
""")
def kd_loss_shifted(spark, sf_dir):
    """Teacher sequences of two to four positions against students of four: both are cut to the shorter one, then labels are shifted."""
    p = pairs(spark, sf_dir)
    teacher = p.filter(F.col("pos") < 2 + F.pmod("seq_id", F.lit(3))).select("seq_id", "pos", "teacher", "label", "attn")
    both = LO.align_positions(teacher, p.select("seq_id", "pos", "student"), ["seq_id", "pos"])
    terms = LO.position_terms(LO.shift_labels(both, "seq_id", "pos", "label"), "teacher", "student", "label", "attn", T)
    out = LO.kd_losses(terms.withColumn("batch_id", F.floor(F.col("seq_id") / 4).cast("long")), ["batch_id"], "seq_id", T, ALPHA)
    return out.select("batch_id", "n_positions", "n_valid", F.round("ce", 6).alias("ce"), F.round("kl_masked", 6).alias("kl_masked"))


# ------------------------------------------------------------- W4 / L1
TOPK_SQL = f"""
top AS (
  SELECT vec_id, embedding,
    list_slice(list_sort(list_transform(embedding, lambda x, i: {{'neg': -CAST(x AS DOUBLE), 'idx': i - 1}})), 1, {K})
      AS tk
  FROM embeddings)"""


@query("logit_topk", "W4 L1", sql=f"""
WITH {TOPK_SQL},{_lsm_sql('top', 'embedding', T, 'e')}
SELECT vec_id, array_to_string(list_transform(tk, lambda s: s.idx), ',') AS top_indices,
  round(-tk[1].neg, 6) AS top1_value,
  round(list_reduce(list_transform(tk, lambda s: e_p[s.idx + 1]), lambda a, b: a + b), 6) AS topk_mass
FROM e5
""")
def logit_topk(spark, sf_dir):
    from tesserae.functions import logits as LG

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    tk = LO.with_top_k(e, "embedding", K)
    mass = LG.array_sum(LG.gather(LG.softmax("embedding", T), F.col("top_k_indices")))
    return tk.select("vec_id", F.array_join(F.col("top_k_indices").cast("array<string>"), ",").alias("top_indices"),
                     F.round(F.col("top_k_values")[0], 6).alias("top1_value"), F.round(mass, 6).alias("topk_mass"))


# ------------------------------------------------------------- L8 / T6
@query("soft_labels", "L8 T6 W4", sql=f"""
WITH {PAIRS_SQL},
tk AS (
  SELECT seq_id, pos, label, attn, pair_id AS input_id,
    array_to_string(list_transform(list_slice(list_sort(list_transform(teacher,
      lambda x, i: {{'neg': -CAST(x AS DOUBLE), 'idx': i - 1}})), 1, 5), lambda s: s.idx), ',') AS idx5,
    sum(attn) OVER (PARTITION BY seq_id) AS true_length,
    count(*) OVER (PARTITION BY seq_id) AS n_positions,
    row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS rn
  FROM p)
SELECT seq_id, n_positions, CAST(true_length AS INTEGER) AS true_length,
  coalesce(string_agg(idx5, '|' ORDER BY pos) FILTER (WHERE rn <= true_length), '') AS top_k_indices,
  coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE rn <= true_length), '') AS labels,
  coalesce(string_agg(CAST(input_id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE rn <= true_length), '') AS input_ids
FROM tk GROUP BY seq_id, n_positions, true_length
""")
def soft_labels(spark, sf_dir):
    p = LO.with_top_k(pairs(spark, sf_dir), "teacher", 5)
    sl = LO.soft_label_table(p, "seq_id", "pos", "top_k_values", "top_k_indices", "pair_id", "label", "attn")
    return sl.select(
        "seq_id", F.col("n_positions").cast("bigint").alias("n_positions"), "true_length",
        F.array_join(F.transform("top_k_indices", lambda a: F.array_join(a.cast("array<string>"), ",")), "|")
        .alias("top_k_indices"),
        F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"))


# ------------------------------------------------------------- L9
@query("offline_kd", "L9 W4", sql=f"""
WITH {PAIRS_SQL},
tk AS (SELECT pair_id, student, list_slice(list_sort(list_transform(teacher,
         lambda x, i: {{'neg': -CAST(x AS DOUBLE), 'idx': i - 1}})), 1, {K}) AS tk FROM p),
v AS (SELECT pair_id, student, list_transform(tk, lambda s: -s.neg) AS vals,
             list_transform(tk, lambda s: s.idx) AS idx FROM tk),
{_lsm_sql('v', 'vals', T, 'tv')},{_lsm_sql('tv5', 'student', T, 'sq')}
SELECT pair_id, round(list_reduce(list_transform(tv_p, lambda x, i: x * (tv_logp[i] - sq_logp[idx[i] + 1])),
                                  lambda a, b: a + b) * {T * T}, 6) AS kl_topk
FROM sq5
""")
def offline_kd(spark, sf_dir):
    p = LO.with_top_k(pairs(spark, sf_dir), "teacher", K)
    out = LO.offline_kd_terms(p, "top_k_values", "top_k_indices", "student", T)
    return out.select("pair_id", F.round("kl_topk", 6).alias("kl_topk"))
