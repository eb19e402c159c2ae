"""Token operators (T3, T4, T5, T7): supervised examples, padded batches,
prompt-only examples and the length profile.

All per-row work is higher-order array functions; only a tokenizer of another
library is Python, on Arrow batches.  Padding needs
the maximum length of each batch: a window over ``batch_id``, whose partition
size is bounded by the batch size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.functions import tokens as TK
from tesserae.operators.sampling import assign_batches, content_hash, with_index


def supervised_examples(df: DataFrame, prompt_col: str = "prompt", response_col: str = "response",
                        max_length: int | None = None, tokenizer: TK.Tokenizer = TK.DEFAULT_TOKENIZER,
                        id_col: str = "id", domain_col: str | None = "domain") -> DataFrame:
    """Sections template -> encode -> mask the prompt part.

    Emits ``input_ids``, ``attention_mask``, ``labels`` (equal lengths),
    ``prompt_len`` and ``full_len``, the length before the cut to
    ``max_length`` (none by default).  Text and prefix are encoded once each,
    and every other column is made of those ids.  The domain defaults to
    ``unknown``, a missing id to the row's index in the order of the rows'
    content (W1), which no file layout changes.
    """
    text, prefix = R.render_sections(F.col(prompt_col), F.coalesce(F.col(response_col), F.lit("")))
    domain = F.coalesce(F.col(domain_col), F.lit("unknown")) if domain_col and domain_col in df.columns \
        else F.lit("unknown")
    out = df
    if id_col not in df.columns:
        out, _ = with_index(df.withColumn("_content", content_hash(df)), ["_content"], id_col)
        out = out.withColumn(id_col, F.col(id_col).cast("string")).drop("_content")
    full = F.col("_full")
    ids = full if max_length is None else F.slice(full, 1, max_length)
    encoded = out.select("*", tokenizer(text).alias("_full"), tokenizer(prefix).alias("_prefix"))
    return (encoded.withColumn("prompt_len", F.size("_prefix")).withColumn("full_len", F.size(full)).withColumn("input_ids", ids).drop("_full", "_prefix")
            .withColumn("attention_mask", TK.ones_like("input_ids"))
            .withColumn("labels", TK.mask_prompt("input_ids", F.col("prompt_len")))
            .withColumn("domain", domain))


def prompt_only_examples(df: DataFrame, prompt_col: str = "prompt", max_length: int | None = None,
                         tokenizer: TK.Tokenizer = TK.DEFAULT_TOKENIZER) -> DataFrame:
    """T5: ChatML-wrapped prompt (idempotent), labels = ids, nothing masked;
    the response is never used.  Cut to ``max_length`` ids (no cut by default)."""
    ids = TK.encode(R.ensure_chatml(F.col(prompt_col)), max_length, tokenizer)
    return (df.withColumn("input_ids", ids)
            .withColumn("attention_mask", TK.ones_like("input_ids"))
            .withColumn("labels", F.col("input_ids")))


def pad_batches(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """T4: right-pad ids with 0, mask with 0, labels with -100 to the batch max."""
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch_col))
    return (df.withColumn("width", width)
            .withColumn("input_ids", TK.pad_to("input_ids", F.col("width"), TK.PAD_ID))
            .withColumn("attention_mask", TK.pad_to("attention_mask", F.col("width"), 0))
            .withColumn("labels", TK.pad_to("labels", F.col("width"), TK.IGNORE_INDEX)))


def batch_and_pad(df: DataFrame, order_cols: list[str], batch_size: int) -> DataFrame:
    """M9 + T4: contiguous batches in a fixed order, then padding."""
    return pad_batches(assign_batches(df, order_cols, batch_size, "batch_id", "_bidx").drop("_bidx"))


def length_profile(examples: DataFrame, full_len_col: str, max_lengths: list[int],
                   batch_col: str = "batch_id") -> DataFrame:
    """Per candidate ``max_length``: truncation rate, fully-masked rows and
    padding waste of the batches (1 - real tokens / padded tokens)."""
    # each row is expanded once per candidate (a fixed, small factor)
    x = examples.select(batch_col, full_len_col, "prompt_len").withColumn(
        "max_length", F.explode(F.array(*[F.lit(int(m)) for m in max_lengths])))
    kept = F.least(F.col(full_len_col), F.col("max_length"))
    x = x.withColumn("kept", kept)
    per_batch = x.groupBy("max_length", batch_col).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("kept").alias("real"), F.max("kept").alias("w"),
        F.count_if(F.col(full_len_col) > F.col("max_length")).alias("truncated"),
        F.count_if(F.col("prompt_len") >= F.col("kept")).alias("fully_masked"))
    return per_batch.groupBy("max_length").agg(
        F.sum("rows").alias("n_rows"),
        (F.sum("truncated") / F.sum("rows")).alias("truncation_rate"),
        F.sum("fully_masked").alias("fully_masked_rows"),
        (F.lit(1.0) - F.sum("real") / F.sum(F.col("w") * F.col("rows"))).alias("padding_waste"))
