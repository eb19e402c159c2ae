"""Token queries (T1-T7) over prompt/response pairs taken from conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.functions import tokens as TK
from tesserae.operators import tokens as TO
from tesserae.operators.sampling import assign_batches
from tesserae.plans import sqlgen as Q
from tesserae.plans.chat import PAIRS_SQL, turn_pairs, user_prompts, with_answers
from tesserae.plans.registry import query

MAX_LEN = 512
BATCH = 8


def ids_md5(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.array_join(c.cast("array<string>"), ","))


TEXT_SQL = (f"{Q.lit(R.SECTION_QUESTION)} || prompt || {Q.lit(R.SECTION_ANSWER)} || coalesce(response, '')")
PREFIX_SQL = f"{Q.lit(R.SECTION_QUESTION)} || prompt || {Q.lit(R.SECTION_ANSWER)}"



def _examples_sql(max_len: int | None) -> str:
    ids = "full_ids" if max_len is None else f"full_ids[1:{max_len}]"
    return f"""
{PAIRS_SQL},
ex0 AS (SELECT conv_id, turn, {Q.tokens(TEXT_SQL)} AS full_ids, len({Q.tokens(PREFIX_SQL)}) AS prompt_len FROM pairs),
ex AS (
  SELECT conv_id, turn, prompt_len, len(full_ids) AS full_len, {ids} AS input_ids,
    list_transform({ids}, lambda x, i: CASE WHEN i - 1 < prompt_len THEN -100 ELSE x END) AS labels,
    row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx
  FROM ex0)"""


EXAMPLES_SQL = _examples_sql(MAX_LEN)


def _mask_sql(max_len: int | None) -> str:
    return f"""
WITH {_examples_sql(max_len)}
SELECT conv_id, turn, len(input_ids) AS n_ids, prompt_len,
  len(list_filter(labels, lambda x: x = -100)) AS n_masked, {Q.int_list_md5('input_ids')} AS ids_md5,
  {Q.int_list_md5('labels')} AS labels_md5
FROM ex
"""


def tokenise(pairs, max_len: int | None = MAX_LEN):
    return TO.supervised_examples(pairs.withColumn("id", F.concat_ws("-", "conv_id", "turn")), "prompt", "response", max_len,
                                  domain_col=None)


def batched_pairs(spark, sf_dir):
    """Pairs with their batch: the user turns alone are numbered, then the answers are joined to them."""
    return with_answers(assign_batches(user_prompts(spark, sf_dir), ["conv_id", "turn"], BATCH), spark, sf_dir)


def _mask(ex):
    return ex.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"),
                     F.col("prompt_len").cast("bigint").alias("prompt_len"),
                     F.size(F.filter("labels", lambda x: x == TK.IGNORE_INDEX)).cast("bigint").alias("n_masked"),
                     ids_md5("input_ids").alias("ids_md5"), ids_md5("labels").alias("labels_md5"))


@query("token_mask", "T1 T2 T3 F5", sql=_mask_sql(MAX_LEN))
def token_mask(spark, sf_dir):
    return _mask(tokenise(turn_pairs(spark, sf_dir)))


@query("token_mask_uncut", "T1 T2 T3 F5 (whole texts)", sql=_mask_sql(None))
def token_mask_uncut(spark, sf_dir):
    return _mask(tokenise(turn_pairs(spark, sf_dir), None))


@query("pad_batch", "T4 M9 W1", sql=f"""
WITH {EXAMPLES_SQL},
b AS (SELECT *, idx // {BATCH} AS batch_id, max(len(input_ids)) OVER (PARTITION BY idx // {BATCH}) AS width FROM ex)
SELECT conv_id, turn, batch_id, width, width - len(input_ids) AS n_pad,
  {Q.int_list_md5('list_resize(input_ids, width, 0)')} AS ids_md5,
  {Q.int_list_md5('list_resize(labels, width, -100)')} AS labels_md5,
  len(input_ids) AS mask_sum
FROM b
""")
def pad_batch(spark, sf_dir):
    ex = tokenise(batched_pairs(spark, sf_dir)).withColumn("_n", F.size("input_ids"))
    padded = TO.pad_batches(ex)
    return padded.select("conv_id", "turn", "batch_id", F.col("width").cast("bigint").alias("width"),
                         (F.col("width") - F.col("_n")).cast("bigint").alias("n_pad"),
                         ids_md5("input_ids").alias("ids_md5"), ids_md5("labels").alias("labels_md5"),
                         TK.true_length("attention_mask").cast("bigint").alias("mask_sum"))


@query("length_profile", "T7", sql=f"""
WITH {EXAMPLES_SQL},
x AS (SELECT idx // {BATCH} AS batch_id, full_len, prompt_len, m AS max_length, least(full_len, m) AS kept
      FROM ex, (SELECT unnest([64, 128, {MAX_LEN}]) AS m)),
pb AS (SELECT max_length, batch_id, count(*) AS rows_, sum(kept) AS real_, max(kept) AS w,
              count_if(full_len > max_length) AS truncated, count_if(prompt_len >= kept) AS fully_masked
       FROM x GROUP BY max_length, batch_id)
SELECT max_length, CAST(sum(rows_) AS BIGINT) AS n_rows, round(sum(truncated) / sum(rows_), 6) AS truncation_rate,
  CAST(sum(fully_masked) AS BIGINT) AS fully_masked_rows,
  round(1.0 - sum(real_) / sum(w * rows_), 6) AS padding_waste
FROM pb GROUP BY max_length
""")
def length_profile(spark, sf_dir):
    ex = tokenise(batched_pairs(spark, sf_dir))
    prof = TO.length_profile(ex, "full_len", [64, 128, MAX_LEN])
    return prof.select("max_length", F.col("n_rows").cast("bigint").alias("n_rows"),
                       F.round("truncation_rate", 6).alias("truncation_rate"),
                       F.col("fully_masked_rows").cast("bigint").alias("fully_masked_rows"),
                       F.round("padding_waste", 6).alias("padding_waste"))


@query("prompt_only", "T5 P10", sql=f"""
WITH {PAIRS_SQL},
w AS (SELECT conv_id, turn, CASE WHEN starts_with(prompt, '<|im_start|>') THEN prompt
           ELSE {Q.lit(R.CHATML_USER)} || prompt || {Q.lit(R.CHATML_END_ASSISTANT)} END AS wrapped FROM pairs)
SELECT conv_id, turn, len({Q.tokens('wrapped')}[1:{MAX_LEN}]) AS n_ids,
  {Q.int_list_md5(Q.tokens('wrapped') + f'[1:{MAX_LEN}]')} AS ids_md5
FROM w
""")
def prompt_only(spark, sf_dir):
    ex = TO.prompt_only_examples(turn_pairs(spark, sf_dir), "prompt", MAX_LEN)
    return ex.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"),
                     ids_md5("labels").alias("ids_md5"))
