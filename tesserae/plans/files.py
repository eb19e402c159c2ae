"""Round trips through the file sources and sinks (S1-S3): what is written is read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.registry import query, table
from tesserae.session import scratch_path
from tesserae.sources import jsonl as J

FIELDS = "doc_id long, text string, lang string, tags array<struct<k:string,v:long>>, missing string"
_SQL = """
SELECT doc_id, md5(text) AS text_md5, lang, lang || '=' || n_chars || '|' || coalesce(source, '') || '=' || doc_id AS tags, NULL::VARCHAR AS missing
FROM documents
"""


def nested_documents(spark, sf_dir):
    """documents with a nested array and a field that the reader does not ask for."""
    tag = lambda k, v: F.struct(F.coalesce(F.col(k), F.lit("")).alias("k"), F.col(v).alias("v"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.array(tag("lang", "n_chars"), tag("source", "doc_id")).alias("tags"), F.col("source").alias("extra"))


def digest(df):
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["k"], F.lit("="), t["v"].cast("string"))), "|")
    return df.select("doc_id", F.md5("text").alias("text_md5"), "lang", tags.alias("tags"), "missing")


@query("jsonl_round_trip", "S1 S2", sql=_SQL)
def jsonl_round_trip(spark, sf_dir):
    out = scratch_path(spark, "jsonl")
    J.write_jsonl(nested_documents(spark, sf_dir), out)
    return digest(J.read_jsonl(spark, out, FIELDS))


@query("json_array_round_trip", "S3", sql=_SQL)
def json_array_round_trip(spark, sf_dir):
    out = scratch_path(spark, "json-array")
    J.write_json_array(nested_documents(spark, sf_dir), out)
    return digest(J.read_json_array(spark, out, FIELDS))
