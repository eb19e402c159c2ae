"""JSON Lines sources and sinks.

Reads never infer: a schema is passed and malformed lines fail the job.
Writes are directories of part files committed by Spark's output committer,
so a crashed write never leaves a half file behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import py_strip
from tesserae.schemas import EVAL_INPUT
from tesserae.sources.json_array import read_json_array  # noqa: F401  (S3)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines skipped; a malformed line is an error;
    missing keys are null, extra keys dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> None:
    """UTF-8, non-ASCII unescaped, nulls kept as ``null``."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3 write side: a folder of files that each hold one JSON array, a file for each task.

    A record a line between the brackets; nulls kept, non-ASCII unescaped."""
    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            lines = []
            for text in b.column(0).to_pylist():
                lines.append(before + text)
                before = ","
            yield pa.RecordBatch.from_pydict({"value": lines})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]})

    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(record.alias("value")).mapInArrow(bracketed, "value string").write.mode(mode).text(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any path that a glob stands for, exists."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hpath)
    return found is not None and len(found) > 0


def load_eval_records(spark: SparkSession, path: str, default_df: DataFrame | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """Read both eval-record shapes and normalise them (accepted, rejected).

    A missing path gives ``default_df`` (the explicit stand-in for the
    reference's built-in prompt list).  Blank lines fail, as in the reference.
    """
    from tesserae.operators.records import normalize_eval_records

    if not path_exists(spark, path):
        if default_df is None:
            raise FileNotFoundError(path)
        return default_df, default_df.limit(0)
    parsed = spark.read.text(path).select(F.when(
        py_strip(F.col("value")) == "", F.raise_error(F.lit(f"blank line in {path}")).cast(EVAL_INPUT))
        .otherwise(F.from_json("value", EVAL_INPUT, {"mode": "FAILFAST"})).alias("r"))
    return normalize_eval_records(parsed.select("r.*"))


def merge_frames(frames: list[DataFrame], id_col: str, order_col: str) -> DataFrame:
    """S5 core: union shards by name, keep one row per id: of the latest shard
    (largest ``order_col``), and of several rows there the one whose JSON text is
    the largest, so that the choice does not depend on the layout.

    A null id is an error, raised while the rows are read.  The rows of an id
    combine map-side (``max_by``), so an id that every shard repeats is a row for
    each task, and no group is sorted.
    """
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    message = F.raise_error(F.lit(f"merge: null ids in column {id_col}")).cast(u.schema[id_col].dataType)
    checked = u.withColumn(id_col, F.when(F.col(id_col).isNull(), message).otherwise(F.col(id_col)))
    whole = F.struct(*[F.col(c) for c in u.columns])
    last = checked.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(whole, F.struct(F.col(order_col), F.to_json(whole))).alias("_row"))
    return last.select("_row.*")


def merge_shards(spark: SparkSession, paths: list[str], schema: T.StructType | str, out: str,
                 id_col: str = "id") -> DataFrame:
    """Union the shard outputs that exist, dedupe by id, write one result.

    An unreadable shard is an error (not skipped), and inputs are never
    deleted here: the caller removes them after checking the output.
    """
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        raise FileNotFoundError("no shard exists")
    frames = [read_jsonl(spark, p, schema).withColumn("_shard", F.lit(i)) for i, p in enumerate(present)]
    merged = merge_frames(frames, id_col, "_shard").drop("_shard")
    write_jsonl(merged, out, "overwrite")
    return read_jsonl(spark, out, schema)


def write_detailed_results(scored: DataFrame, path: str, domain_col: str = "domain",
                           mode: str = "overwrite") -> None:
    """Per-row verdicts (``scoring.with_verdicts``), one folder per domain."""
    write_jsonl(scored, path, mode, partition_by=[domain_col])


def report_record(report: DataFrame, settings: dict | None = None, header: dict | None = None) -> DataFrame:
    """Header (model and data paths), totals, per-domain metrics and generation settings as one nested record.

    ``report`` is the per-domain table from ``scoring.evaluate``; it has one
    row per domain, so folding it into one record is bounded by the domain count.
    """
    metrics = [c for c in report.columns if c != "domain"]
    nested = report.agg(
        F.sum(F.when(F.col("scored"), F.col("total_samples"))).alias("total_samples"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("domain", F.lit("unknown")), F.struct(*metrics))))
        .alias("domain_results"))
    nested = nested.select(*[F.lit(v).alias(k) for k, v in (header or {}).items()], "*")
    if settings:
        nested = nested.withColumn("generation_config", F.create_map(
            *[x for k, v in settings.items() for x in (F.lit(k), F.lit(str(v)))]))
    return nested


def write_report(report: DataFrame, path: str, settings: dict | None = None, mode: str = "overwrite",
                 header: dict | None = None) -> DataFrame:
    """Write :func:`report_record` as one JSON line."""
    nested = report_record(report, settings, header)
    write_jsonl(nested.coalesce(1), path, mode)
    return nested
