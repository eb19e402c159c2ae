"""Row identity, scratch tables and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import scratch_path, ship_package

#: Bytes of text that a task works on at once (a longer single document is worked on alone).
BLOCK = 1 << 20


#: Rows in an Arrow batch, so that a worker holds few texts at a time.
BATCH_ROWS = 1000

#: Spark's setting by which the shuffle files of a write go when it ends, not when the driver next collects garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Marks of ids by which rows are sifted before a join, 64 in a broadcast row.
MARKS = 1 << 26


def ready(spark: SparkSession) -> None:
    """Send the package to the executors and keep Arrow batches small."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What a worker keeps for later tasks of the same operator.
KEPT: dict[str, object] = {}

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Give freed memory back to the system: numpy and Arrow hold on to it, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _tidied(run, it: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    if not keep and KEPT:
        KEPT.clear()
        let_go()
    try:
        yield from run(it)
    finally:
        let_go()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False):
    """``run`` as a task that leaves its worker small for the stages that follow.

    Workers are shared by all stages of a session.  Tasks that don't ``keep``
    what earlier tasks kept let it go."""
    return lambda it: _tidied(run, it, keep)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again.

    Cuts the lineage with files that outlive executors, and makes a result
    that several branches read be computed once.  The shuffles behind it are
    removed as soon as it is written."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, wanted: DataFrame, id_col: str = "rid") -> DataFrame:
    """``rows`` with a column ``marked``: false only where the id is not among those of ``wanted``.

    The marks are a hash of the ids into MARKS values, so the broadcast is of
    bounded size, and no row is shuffled.  Where more than the ids wanted may
    pass, an exact join of the marked rows has to follow."""
    mark = F.pmod(F.xxhash64(id_col), F.lit(MARKS))
    word, bit = F.shiftright(mark, 6).cast("int"), mark.bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(word.alias("_word"), bit.alias("_bit")).select("_word", F.expr("shiftleft(1L, _bit)").alias("_one"))
    marks = marks.groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    found = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(marks), "_word", "left")
    return found.withColumn("marked", F.coalesce(F.expr("getbit(_bits, _bit) = 1"), F.lit(False))).drop("_word", "_bit", "_bits")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``rid, id, text`` and those of ``keep``: ``rid`` is unique, not null and ordered as ``id``.

    Unique non-null ids are their own ``rid``.  Otherwise (null or repeated
    ids) the rows are sorted by id (nulls last), text and input position and
    numbered once, in the scratch folder, so that each row is a document of
    its own.  Other columns, whatever their names, are left out."""
    ready(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    odd = base.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count()
    if not odd:
        return base.select(F.col("id").alias("rid"), "id", "text", *keep)
    rows = base.withColumn("at", F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("id").asc_nulls_last(), "text", "at")
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "text", *keep), "identified")


def with_rid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, text, row``: as :func:`identified`, with all columns of ``docs`` kept in the struct ``row``."""
    ready(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    odd = base.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count()
    if not odd:
        return base.select(F.col("id").alias("rid"), "text", "row")
    rows = base.withColumn("at", F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("id").asc_nulls_last(), "text", "at")
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "text", "row"), "identified")


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` for consecutive rows of about ``size`` bytes."""
    data, off = binary_parts(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def batch(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)],
                                      names=list(schema))


def ddl(schema: dict[str, pa.DataType]) -> str:
    """The Spark schema of an Arrow one."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary",
             pa.bool_(): "boolean", pa.float64(): "double"}
    of = lambda t: f"array<{names[t.value_type]}>" if pa.types.is_list(t) else names[t]
    return ", ".join(f"{k} {of(t)}" for k, t in schema.items())


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(df: DataFrame, rows_bytes: float = 1.0) -> int:
    """A shuffle width: the session's, or more when ``df`` reads files whose size asks for it (64 MB a task)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().doubleValue())
    return n if size > 1e18 else max(n, int(size * rows_bytes / (64 << 20)))
