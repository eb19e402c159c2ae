"""Generation as a Structured Streaming job over a growing folder of prompts.

Ids seen are keyed streaming state: ``dropDuplicates`` on the id passes the
first row of each and looks up only the ids of the micro-batch, so no batch
reads earlier answers.  Rows whose model call failed are written to a retry
folder, which is itself a stream source, and come back with a later
micro-batch (or the next run) until they are answered or out of attempts.
Every micro-batch owns a folder of the output and one of the retries, named by
the query and the epoch; a batch that is replayed after a crash finds what it
has committed and changes nothing.

For many ids, set ``spark.sql.streaming.stateStore.providerClass`` to the
RocksDB provider: the state then lies on disk and in the checkpoint."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.inference import ModelFactory, generate, read_generated
from tesserae.sources.jsonl import path_exists

ATTEMPT = "attempt"


def _committed(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def answer_epoch(batch: DataFrame, folder: str, out_path: str, retry_path: str, model_factory: ModelFactory, prompt_col: str,
                 batch_size: int = 512, params: dict | None = None, render=None, max_attempts: int = 3) -> None:
    """One micro-batch: its answers, and of its failed rows those with attempts left, each written once to ``folder``."""
    spark = batch.sparkSession
    out, retry = f"{out_path}/{folder}", f"{retry_path}/{folder}"
    prompt = F.col(prompt_col)
    staged = batch.withColumn("_rendered", render(prompt) if render else prompt)
    gen = generate(staged, model_factory, "_rendered", batch_size, params).drop("_rendered")
    if not _committed(spark, out):
        gen.write.mode("overwrite").partitionBy("status").parquet(out)
    else:  # a replay: only the streaming state has to see the batch again
        batch.write.format("noop").mode("overwrite").save()
    if not _committed(spark, retry):
        failed = spark.read.schema(gen.schema).parquet(out).filter((F.col("status") == "failed") & (F.col(ATTEMPT) < max_attempts))
        if not failed.isEmpty():  # an empty file would call for a batch of its own
            again = failed.select(*[F.col(c) for c in batch.columns if c != ATTEMPT], (F.col(ATTEMPT) + 1).alias(ATTEMPT))
            again.write.mode("overwrite").parquet(retry)


def watched(spark: SparkSession, source_path: str) -> tuple[str, dict]:
    """The folder to stream and the reader's options: a path that is one file is that file alone in its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source_path)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if found is None or len(found) != 1 or found[0].isDirectory():
        return source_path, {}
    file = found[0].getPath()
    return file.getParent().toString(), {"pathGlobFilter": re.sub(r"([][{}*?\\\\])", r"\\\1", file.getName())}


def generate_stream(spark: SparkSession, source_path: str, schema: T.StructType | str, out_path: str,
                    checkpoint_path: str, model_factory: ModelFactory, id_col: str = "id",
                    prompt_col: str = "prompt", fmt: str = "json", options: dict | None = None,
                    batch_size: int = 512, params: dict | None = None, render=None,
                    available_now: bool = True, timeout_s: float | None = None, max_attempts: int = 3):
    """Start (and, with ``available_now``, run to completion) the stream.

    ``source_path`` is a folder that grows (a table's own, with its part files) or one file.
    A null id fails the batch; of rows with one id the first to arrive is
    answered.  A row is tried at most ``max_attempts`` times, once a batch; with
    ``available_now`` a row that fails is tried again by the next run.  Read the
    answers with :func:`read_answers`.  Returns the ``StreamingQuery``.
    """
    out_path, retry_path = out_path.rstrip("/"), f"{checkpoint_path.rstrip('/')}-retry"
    reader = spark.readStream.schema(schema).format(fmt)
    folder, chosen = watched(spark, source_path)
    for k, v in {**(options or {}), **chosen}.items():
        reader = reader.option(k, v)
    src = reader.load(folder)
    checked = F.when(F.col(id_col).isNull(), F.raise_error(F.lit(f"null ids in column {id_col}"))).otherwise(F.col(id_col))
    fresh = src.withColumn(id_col, checked.cast(src.schema[id_col].dataType)).dropDuplicates([id_col])
    first = fresh.withColumn(ATTEMPT, F.lit(1))
    # the folder has to be there before the stream can watch it
    if not path_exists(spark, retry_path):
        spark.createDataFrame([], first.schema).write.parquet(f"{retry_path}/start")
    retries = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(retry_path)
    rows = first.unionByName(retries)

    def process(batch: DataFrame, epoch: int) -> None:
        # the query's id outlives restarts and is new with a new checkpoint
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint_path.rstrip('/')}/metadata").first()[0])["id"]
        answer_epoch(batch, f"batch={query}-{epoch}", out_path, retry_path, model_factory, prompt_col, batch_size, params, render,
                     max_attempts)

    writer = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination(timeout_s)
    return q


def read_answers(spark: SparkSession, out_path: str, id_col: str = "id") -> DataFrame:
    """The stream's output, one row per id: its answer, or else its last failure."""
    return read_generated(spark, out_path, id_col).drop("batch")
