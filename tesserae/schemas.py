"""Record schemas (1.3): one struct for every domain, all optional fields nullable."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA_FIELDS = [
    ("source", "string"),
    ("original_index", "bigint"),
    ("task_id", "string"),
    ("test_cases", "string"),
    ("entry_point", "string"),
    ("scenario", "string"),
    ("fix_plan", "array<string>"),
]

METADATA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("original_index", T.LongType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("test_cases", T.StringType()),
    T.StructField("entry_point", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("fix_plan", T.ArrayType(T.StringType())),
])

# R1 unified / R2 prepared / R3 taught / R4 with provenance, as one schema.
RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
    T.StructField("original_answer", T.StringType()),
    T.StructField("teacher_response", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("instance_id", T.IntegerType()),
    T.StructField("batch_id", T.IntegerType()),
])

# R7 eval-normalised, read permissively (both input shapes).
EVAL_INPUT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("teacher_response", T.StringType()),
    T.StructField("original_answer", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
])

TOKENISED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
    T.StructField("labels", T.ArrayType(T.IntegerType())),
])

TEXT_LOSSES = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("text_id", T.StringType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("n_tokens", T.LongType()),
])

TRAINING_LOG = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("total_loss", T.DoubleType()),
    T.StructField("ce_loss", T.DoubleType()),
    T.StructField("kl_loss", T.DoubleType()),
])
