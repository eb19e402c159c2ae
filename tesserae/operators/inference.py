"""Batch inference over partitions (G1-G3, G5-G8) with a pluggable model.

A model is a factory ``() -> fn(prompts: list[str], params: dict) -> list[str]``.
The factory runs once per Python worker (cached across tasks), the function
once per batch.  Rows stream through Arrow batches (``mapInPandas``).  When a
batch column is given, rows are dealt out and sorted by it first and every run
of one value is a batch, which makes batch membership reproducible.

Only the model call is Python; rendering, filtering and resume anti-joins
run before it in the JVM, so pushdown still reaches the scan.
"""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import py_strip

ModelFn = Callable[[list, dict], list]
ModelFactory = Callable[[], ModelFn]

# Per-Python-worker cache of loaded models (worker processes are reused).
_MODELS: dict[str, ModelFn] = {}

# Generation defaults of the teacher run.
DEFAULT_PARAMS = {"temperature": 0.3, "top_p": 0.9, "max_new_tokens": 256}

_OUT_FIELDS = [
    T.StructField("response", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("batch_seconds", T.DoubleType()),
    T.StructField("batch_rows", T.IntegerType()),
    T.StructField("batch_key", T.StringType()),
    T.StructField("batch_started", T.DoubleType()),
    T.StructField("batch_ended", T.DoubleType()),
]
#: Columns that :func:`generate` adds to say how its batches ran.
BATCH_COLUMNS = [f.name for f in _OUT_FIELDS[3:]]

#: Rows in an Arrow batch: a worker holds a few copies of one, not of Spark's 10,000 rows, whatever the task reads.
FRAME_ROWS = 500

# Tasks for each core that prompts are spread over where the scan gives fewer.
TASKS_PER_CORE = 2


def _model(factory: ModelFactory, key: str) -> ModelFn:
    m = _MODELS.get(key)
    if m is None:
        m = factory()
        _MODELS[key] = m
    return m


def _factory_key(factory: ModelFactory) -> str:
    """Identity of a model factory, closures included (driver side)."""
    import hashlib

    from pyspark import cloudpickle

    return hashlib.md5(cloudpickle.dumps(factory)).hexdigest()


def _run_batch(model: ModelFn, prompts: list, params: dict) -> tuple[list, str, str | None, float, float]:
    """Responses, status, error, and when the call began and ended (seconds since 1970)."""
    t0 = time.time()
    try:
        out = list(model(prompts, params))
        if len(out) != len(prompts):
            raise ValueError(f"model returned {len(out)} responses for {len(prompts)} prompts")
        return out, "ok", None, t0, max(t0, time.time())
    except Exception as e:  # noqa: BLE001 - recorded per row (G6)
        return [None] * len(prompts), "failed", f"{type(e).__name__}: {e}", t0, max(t0, time.time())


def _emit(pdf: pd.DataFrame, edges: list[int], prompt_col: str, model: ModelFn, params: dict) -> pd.DataFrame:
    """``pdf`` with the output columns; its batches lie between consecutive ``edges``."""
    prompts = pdf[prompt_col].tolist()
    responses, per_row = [], []
    for a, z in itertools.pairwise(edges):
        out, status, err, began, ended = _run_batch(model, prompts[a:z], params)
        responses += out
        per_row += [(status, err, ended - began, z - a, uuid.uuid4().hex, began, ended)] * (z - a)
    res = pdf.copy(deep=False)
    res["response"] = pd.Series(responses, dtype=object)
    for field, values in zip(_OUT_FIELDS[1:], zip(*per_row)):
        res[field.name] = values
    return res


def _batches(it: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames and the edges of the batches in them: consecutive rows, ``size`` each
    (the last may be smaller).  Only a tail is copied on, and frames stay as large as they come."""
    tail = None
    for pdf in it:
        frame = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        whole = len(frame) - len(frame) % size
        if whole:
            yield frame.iloc[:whole].reset_index(drop=True), list(range(0, whole + 1, size))
        tail = frame.iloc[whole:] if whole < len(frame) else None
    if tail is not None:
        yield tail.reset_index(drop=True), [0, len(tail)]


def require_ids(df: DataFrame, id_col: str = "id", unique: bool = True) -> DataFrame:
    """``df``, or an error that counts its null (and repeated) ids: rows are paired and resumed by id."""
    nulls = df.filter(F.col(id_col).isNull()).count()
    repeats = df.groupBy(id_col).count().filter(F.col(id_col).isNotNull() & (F.col("count") > 1)).count() if unique else 0
    if nulls or repeats:
        raise ValueError(f"column {id_col}: {nulls} null ids, {repeats} ids that repeat")
    return df


def _runs(it: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames and the edges of the runs in them: consecutive rows with one value of ``column``; nulls are one value."""
    tail = None
    for pdf in it:
        frame = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        if not len(frame):
            continue
        value = frame[column]
        last = value.shift()
        change = (value.ne(last) & ~(value.isna() & last.isna())).to_numpy()
        change[0] = True
        edges = change.nonzero()[0].tolist()
        if len(edges) > 1:
            yield frame.iloc[:edges[-1]].reset_index(drop=True), edges
        tail = frame.iloc[edges[-1]:]  # the last run may go on
    if tail is not None:
        yield tail.reset_index(drop=True), [0, len(tail)]


def small_frames(spark) -> None:
    """Let Arrow batches be of FRAME_ROWS rows at most; a model's batches may span several."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= FRAME_ROWS:  # 0 and less: no bound
        spark.conf.set(name, str(FRAME_ROWS))


def spread_tasks(df: DataFrame) -> int | None:
    """How many tasks to deal prompts out to, or None where the scan's own splits are enough.

    A model call costs far more than moving its prompt, and one 128 MB split
    holds 100,000 prompts, so a small table should still use every core."""
    from tesserae.operators.sampling import TARGET_PARTITION_BYTES, _input_bytes

    wanted = TASKS_PER_CORE * int(df.sparkSession.sparkContext.defaultParallelism)
    return wanted if _input_bytes(df) < wanted * TARGET_PARTITION_BYTES else None


def generate(df: DataFrame, model_factory: ModelFactory, prompt_col: str = "prompt",
             batch_size: int = 512, params: dict | None = None, batch_col: str | None = None,
             model_key: str | None = None, num_partitions: int | None = None,
             resource_profile=None) -> DataFrame:
    """G1: append ``response``, ``status`` ('ok'/'failed'), ``error``,
    and its batch's key, start, end, seconds and rows to every input row.

    Responses are stripped (X7) in the JVM after the Python step.  A failed
    batch marks its rows instead of shifting or dropping later rows (G6).
    ``num_partitions`` spreads the work (one model instance per worker; by
    default see :func:`spread_tasks`; 0 keeps the input's partitions).
    ``resource_profile`` (a ``pyspark.resource.ResourceProfile``, e.g. one GPU
    per task) applies stage-level scheduling to the model stage only, so the
    relational stages around it keep running on plain executors.
    """
    from tesserae.session import ship_package

    ship_package(df.sparkSession)
    small_frames(df.sparkSession)
    p = dict(DEFAULT_PARAMS)
    p.update(params or {})
    key = model_key or _factory_key(model_factory)
    schema = T.StructType(list(df.schema.fields) + _OUT_FIELDS)
    tasks = spread_tasks(df) if num_partitions is None else num_partitions
    if batch_col is not None:
        src = (df.repartition(tasks, batch_col) if tasks else df.repartition(batch_col)).sortWithinPartitions(batch_col)
    else:
        src = df.repartition(tasks) if tasks else df

    def per_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_factory, key)
        for part, edges in _batches(it, batch_size) if batch_col is None else _runs(it, batch_col):
            yield _emit(part, edges, prompt_col, model, p)

    out = (src.mapInPandas(per_partition, schema, profile=resource_profile) if resource_profile is not None
           else src.mapInPandas(per_partition, schema))
    return out.withColumn("response", py_strip(F.col("response")))


def failure_rate(generated: DataFrame) -> float:
    """Share of rows whose batch failed (one aggregate)."""
    r = generated.agg(F.avg(F.when(F.col("status") == "failed", 1.0).otherwise(0.0)).alias("r")).first()
    return float(r["r"] or 0.0)


def check_failures(generated: DataFrame, max_rate: float = 0.0) -> DataFrame:
    """Fail the job when more than ``max_rate`` of the rows failed."""
    rate = failure_rate(generated)
    if rate > max_rate:
        raise RuntimeError(f"generation failure rate {rate:.3f} exceeds {max_rate:.3f}")
    return generated


def generate_dataset(items: DataFrame, model_factory: ModelFactory, render: Callable | None = None,
                     id_col: str = "id", prompt_col: str = "prompt", batch_size: int = 512,
                     params: dict | None = None, answer_field: str = "expected_answer") -> DataFrame:
    """Render -> G1 -> attach (P13): ``teacher_response`` added and the
    expected answer overwritten; failed rows keep their answer."""
    from tesserae.functions.render import render_single_turn

    r = render or render_single_turn
    staged = items.withColumn("_rendered", r(F.col(prompt_col)))
    gen = generate(staged, model_factory, "_rendered", batch_size, params)
    ok = F.col("status") == "ok"
    out = (gen.withColumn("teacher_response", F.when(ok, F.col("response")))
           .withColumn(answer_field, F.when(ok, F.col("response")).otherwise(F.col(answer_field))))
    return out.drop("_rendered", "response", *BATCH_COLUMNS)


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hp)) and len(fs.listStatus(hp)) > 0


def done_ids(spark, out_path: str, id_col: str = "id", chunks: list[int] | None = None) -> DataFrame | None:
    """Ids with an answer (of these chunks); a failed row is not done and is tried again by the next run."""
    paths = [out_path] if chunks is None else [f"{out_path}/chunk={c}" for c in chunks]
    paths = [p for p in paths if _exists(spark, p)]
    if not paths:
        return None
    return spark.read.parquet(*paths).filter((F.col("status") == "ok") & F.col(id_col).isNotNull()).select(id_col)


MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "chunk int, n_chunks int, n_ok long, n_failed long, ids_digest long"


def _chunk_state(rows: DataFrame) -> DataFrame:
    """Per chunk the number of ids and a digest of them that no order changes."""
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.col("_id"))).alias("ids_digest"))


def read_manifest(spark, out_path: str) -> dict[int, dict]:
    """The last manifest entry of each chunk: ``n_chunks, n_ok, n_failed, ids_digest``; a row for each chunk and run."""
    path = f"{out_path.rstrip('/')}/{MANIFEST}"
    if not _exists(spark, path):
        return {}
    # the entry with the most answers is the latest: answers are only ever added
    rows = spark.read.schema(_MANIFEST_SCHEMA).option("recursiveFileLookup", True).parquet(path).groupBy("chunk").agg(
        F.max_by(F.struct("n_chunks", "n_ok", "n_failed", "ids_digest"), F.struct("n_ok", -F.col("n_failed"))).alias("e"))
    return {r["chunk"]: r["e"].asDict() for r in rows.collect()}


def generate_incremental(items: DataFrame, out_path: str, model_factory: ModelFactory,
                         id_col: str = "id", prompt_col: str = "prompt", batch_size: int = 512,
                         params: dict | None = None, chunk_rows: int = 10_000_000, parallel: int = 8) -> DataFrame:
    """Resumable generation into ``out_path`` (Parquet, a folder for each chunk of ids).

    Fails on null or repeated ids.  Ids are dealt to chunks by hash; the first
    run fixes how many.  Up to ``parallel`` chunks run side by side, each one
    Spark write that is committed as a whole and then entered in the manifest
    beside the results with the number and a digest of its answered ids, so a
    crash loses the chunks in flight only.  A later run compares the manifest
    with the digests of its input: chunks whose ids are all answered are not
    looked at again; in the others the answered ids are read from the chunk's
    own folder and only the rest (new and failed rows, F3/J3) is generated.
    Running twice equals running once.  Returns the merged output, one row per id.
    """
    from pyspark import inheritable_thread_target

    from tesserae.session import scratch_path

    spark, out_path = items.sparkSession, out_path.rstrip("/")
    todo = require_ids(items, id_col)
    known = read_manifest(spark, out_path)
    n_chunks = next((e["n_chunks"] for e in known.values()), None) or max(1, -(-todo.count() // chunk_rows))
    chunked = todo.withColumn("chunk", F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_chunks)).cast("int"))
    state = {r["chunk"]: r for r in _chunk_state(chunked.withColumn("_id", F.col(id_col))).collect()}  # a row for each chunk
    left = sorted(c for c, r in state.items() if c not in known or (known[c]["n_ok"], known[c]["ids_digest"]) != (r["n"], r["ids_digest"]))
    if left:
        chunked = chunked.filter(F.col("chunk").isin(left))
        if _exists(spark, out_path):  # reads the folders of these chunks only
            done = done_ids(spark, out_path, id_col, left)
            chunked = chunked.join(done.distinct(), id_col, "left_anti") if done is not None else chunked
        if len(left) > 1:  # staged once, so that a chunk reads its own folder instead of all items
            staging = scratch_path(spark, "generate-staging")
            chunked.write.partitionBy("chunk").parquet(staging)
            chunked = spark.read.schema(chunked.schema).parquet(staging)

        def run(c: int) -> None:
            path = f"{out_path}/chunk={c}"
            gen = generate(chunked.filter(F.col("chunk") == c).drop("chunk"), model_factory, prompt_col, batch_size, params)
            gen.write.mode("append").parquet(path)
            merged = read_generated(spark, path, id_col).withColumn("chunk", F.lit(c)).withColumn("_id", F.col(id_col))
            ok = F.col("status") == "ok"
            entry = merged.agg(F.lit(c).alias("chunk"), F.lit(n_chunks).alias("n_chunks"), F.count_if(ok).alias("n_ok"),
                               F.count_if(~ok).alias("n_failed"), F.bit_xor(F.when(ok, F.xxhash64(F.col("_id")))).alias("ids_digest"))
            # a folder of its own: chunks commit side by side
            entry.coalesce(1).write.parquet(f"{out_path}/{MANIFEST}/{c}-{uuid.uuid4().hex}")

        with ThreadPoolExecutor(max(1, min(parallel, len(left)))) as pool:
            for f in [pool.submit(inheritable_thread_target(spark)(run), c) for c in left]:
                f.result()
    return read_generated(spark, out_path, id_col)


def read_generated(spark, out_path: str, id_col: str = "id") -> DataFrame:
    """Merged incremental output: one row per id (an ok row wins over a failed one)."""
    from pyspark.sql import Window

    df = spark.read.parquet(out_path)
    w = Window.partitionBy(id_col).orderBy(F.when(F.col("status") == "ok", 0).otherwise(1))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "chunk")


def evaluate_batched(df: DataFrame, model_factory: ModelFactory, model_name: str, prompt_col: str = "prompt",
                     batch_size: int = 8, params: dict | None = None) -> DataFrame:
    """Responses plus per-row time (batch time / batch size), as
    ``<model>_response`` / ``<model>_time``."""
    gen = generate(df, model_factory, prompt_col, batch_size, params)
    return (gen.withColumn(f"{model_name}_response", F.col("response"))
            .withColumn(f"{model_name}_time", F.col("batch_seconds") / F.col("batch_rows"))
            .drop("response", "status", "error", "batch_key", "batch_started", "batch_ended"))


def evaluation_rows(pred: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Generated eval records (``response``) as rows with their verdict columns, for S6 and S7.

    ``verdicts``: ``id, passed`` and perhaps ``error``, what running the code of a
    row's answer gave; paired by id, more than one for an id is an error."""
    from tesserae.functions import render as R
    from tesserae.functions import text as X
    from tesserae.operators.scoring import with_verdicts

    entry = F.col("metadata.entry_point")
    rows = pred.select(
        "id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.col("response").alias("prediction"),
        R.training_response("expected_answer", "original_answer").alias("reference"),
        F.when(F.col("domain") == "code", X.extract_code("response", F.coalesce(entry, F.lit("")))).alias("extracted_code"))
    if verdicts is None:
        rows = rows.withColumn("passed", F.lit(None).cast("boolean")).withColumn("error", F.lit(None).cast("string"))
    else:
        error = F.col("error").cast("string") if "error" in verdicts.columns else F.lit(None).cast("string")
        once = verdicts.filter(F.col("id").isNotNull()).groupBy("id").agg(
            F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(F.col("passed").cast("boolean").alias("passed"), error.alias("error"))).alias("_v"))
        message = F.concat(F.lit("more than one verdict for "), F.col("id").cast("string"))
        once = once.select("id", F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.col("_v.passed")).alias("passed"),
                           F.col("_v.error").alias("error"))
        rows = rows.join(once, "id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return with_verdicts(rows)


def generate_many(df: DataFrame, models: dict[str, ModelFactory], prompt_col: str = "prompt",
                  batch_size: int = 8, params: dict | None = None) -> DataFrame:
    """Every model over the same Arrow batches in one pass: adds
    ``batch_rows``, ``batch_key`` and, per model, ``<model>_response`` (stripped),
    ``<model>_status``, ``<model>_time`` (batch time / batch rows) and the
    call's ``<model>_started`` and ``<model>_ended``.  No second scan and no join."""
    from tesserae.session import ship_package

    ship_package(df.sparkSession)
    small_frames(df.sparkSession)
    p = dict(DEFAULT_PARAMS)
    p.update(params or {})
    keys = {m: _factory_key(f) for m, f in models.items()}
    fields = list(df.schema.fields) + [T.StructField("batch_rows", T.IntegerType()), T.StructField("batch_key", T.StringType())]
    for m in models:
        fields += [T.StructField(f"{m}_response", T.StringType()), T.StructField(f"{m}_status", T.StringType()),
                   *[T.StructField(f"{m}_{x}", T.DoubleType()) for x in ("time", "started", "ended")]]
    schema, added = T.StructType(fields), [f.name for f in fields[len(df.schema.fields):]]

    def per_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {m: _model(f, keys[m]) for m, f in models.items()}

        for pdf, edges in _batches(it, batch_size):
            res = pdf.copy(deep=False)
            prompts, columns = pdf[prompt_col].tolist(), {name: [] for name in added}
            for a, z in itertools.pairwise(edges):
                columns["batch_rows"] += [z - a] * (z - a)
                columns["batch_key"] += [uuid.uuid4().hex] * (z - a)
                for m, model in loaded.items():
                    out, status, _, began, ended = _run_batch(model, prompts[a:z], p)
                    columns[f"{m}_response"] += out
                    for name, v in (("status", status), ("time", (ended - began) / (z - a)), ("started", began), ("ended", ended)):
                        columns[f"{m}_{name}"] += [v] * (z - a)
            for name, values in columns.items():
                res[name] = pd.Series(values, dtype=object) if name.endswith("_response") else values
            yield res

    tasks = spread_tasks(df)
    out = (df.repartition(tasks) if tasks else df).mapInPandas(per_partition, schema)
    return out.select(*[py_strip(F.col(c)).alias(c) if c.endswith("_response") and c[:-9] in models
                        else F.col(c) for c in out.columns])


def compare_models(df: DataFrame, models: dict[str, ModelFactory], id_col: str = "id",
                   prompt_col: str = "prompt", batch_size: int = 8, params: dict | None = None,
                   single_pass: bool = True) -> DataFrame:
    """Every model over the same rows as a P14 comparison record (first
    model's record plus the ``<model>_*`` columns of the others, J2).

    ``single_pass`` (default) calls every model on the same batches in one
    scan, so the legs need no join.  ``single_pass=False`` runs one stage
    per model (e.g. each with its own ``resource_profile``) and joins the
    legs on id.
    """
    from tesserae.operators.records import comparison_columns, comparison_record, side_by_side

    names = list(models)
    if single_pass:
        gen = generate_many(df, models, prompt_col, batch_size, params)
        if prompt_col != "prompt" and "prompt" not in gen.columns:
            gen = gen.withColumn("prompt", F.col(prompt_col))
        first = comparison_columns(gen, names[0], f"{names[0]}_response", f"{names[0]}_time", id_col)
        others = [F.col(f"{m}_{x}") for m in names[1:] for x in ("response", "time")]
        return gen.select(*first, *others)
    legs = []
    for m in names:
        gen = generate(df, models[m], prompt_col, batch_size, params)
        gen = gen.withColumn("_t", F.col("batch_seconds") / F.col("batch_rows"))
        if prompt_col != "prompt" and "prompt" not in gen.columns:
            gen = gen.withColumn("prompt", F.col(prompt_col))
        legs.append(comparison_record(gen, m, "response", "_t", id_col))
    out = legs[0]
    for m, leg in zip(names[1:], legs[1:]):
        out = side_by_side(out, leg, prefix=f"{m}_", id_col=id_col)
    return out
