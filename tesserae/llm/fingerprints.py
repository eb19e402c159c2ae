"""Exact duplicates by composable polynomial fingerprints.

The normalised text (A-Z lower-cased) is hashed in chunks; the fingerprint of
a concatenation is ``h(left) * base**len(right) + h(right)``, so chunks can be
hashed apart, in any order, and joined.  Documents of equal fingerprint and
length are then compared chunk by chunk; a group that differs anywhere is
split by its texts' SHA-256."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import batch, binary_parts, ddl, identified, lower_ascii, stored, tidy, with_rid
from tesserae.llm.words import LOWER

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253)
CHUNK = 1 << 16

_power: dict[int, np.ndarray] = {}


def _descending(base: int) -> np.ndarray:
    if base not in _power:
        p, out = 1, np.empty(CHUNK, np.uint64)
        for i in range(CHUNK - 1, -1, -1):
            out[i] = p
            p = p * base % PRIME
        _power[base] = out
    return _power[base]


def chunk_hash(chunk: np.ndarray, base: int) -> int:
    """Polynomial in ``base`` modulo PRIME over ``byte + 1`` (so that zero bytes count), at most CHUNK bytes."""
    return int(np.dot(chunk.astype(np.uint64) + np.uint64(1), _descending(base)[CHUNK - len(chunk):])) % PRIME


def combine(left: int, right: int, right_len: int, base: int) -> int:
    """The fingerprint of a concatenation from those of its halves."""
    return (left * pow(base, right_len, PRIME) + right) % PRIME


def fingerprint(data: np.ndarray) -> int:
    """62-bit fingerprint of any number of bytes."""
    h = [0, 0]
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK]
        h = [combine(x, chunk_hash(part, b), len(part), b) for x, b in zip(h, BASES, strict=True)]
    return h[0] << 31 | h[1]


_PRINTS = {"rid": pa.int64(), "id": pa.int64(), "fp": pa.int64(), "n_bytes": pa.int64(), "sha": pa.string()}


def _prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        data, off = binary_parts(b.column("text"))
        data = LOWER[data]
        texts = [data[off[i]:off[i + 1]] for i in range(len(off) - 1)]
        yield batch(_PRINTS, b.column("rid"), b.column("id"), [fingerprint(t) for t in texts], np.diff(off),
                    [hashlib.sha256(t).hexdigest() for t in texts])


def _groups(base: DataFrame) -> DataFrame:
    """``rid, id, sha, fp, n_bytes, part, keep, size``: each row with the kept rid and the size of its group."""
    rows = stored(base.mapInArrow(tidy(_prints), ddl(_PRINTS)), "fingerprints")
    twins = rows.groupBy("fp", "n_bytes").agg(F.count("*").alias("size")).where("size > 1")
    doubtful = rows.join(twins, ["fp", "n_bytes"]).select("rid", "fp", "n_bytes")
    whole = base.select("rid", "text").join(doubtful, "rid").where("n_bytes > 0")
    parts = (whole.select("fp", "n_bytes", lower_ascii(F.col("text")).cast("binary").alias("text"))
             .select("fp", "n_bytes", "text", F.explode(F.expr(f"sequence(0, (n_bytes - 1) div {CHUNK})")).alias("no"))
             .select("fp", "n_bytes", "no", F.expr(f"substring(text, cast(no * {CHUNK} + 1 as int), {CHUNK})").alias("chunk")))
    same = parts.groupBy("fp", "n_bytes", "no").agg(F.min("chunk").alias("a"), F.max("chunk").alias("z"))
    clash = same.where("a <> z").select("fp", "n_bytes").distinct().withColumn("clash", F.lit(True))
    keyed = stored(rows.join(clash, ["fp", "n_bytes"], "left")
                   .withColumn("part", F.when(F.col("clash"), F.col("sha")).otherwise(F.lit("")))
                   .drop("clash"), "keyed")
    key = ["fp", "n_bytes", "part"]
    groups = keyed.groupBy(*key).agg(F.max("rid").alias("keep"), F.max("id").alias("keep_id"), F.count("*").alias("size"))
    return keyed.join(groups, key)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty (all empty texts are one group).  The largest id
    of a group stays; of repeated ids one row stays, and a null id comes after
    all others, so a row with a null id stays before any other (``keep_id`` is
    then null).  An empty table gives an empty result."""
    g = _groups(identified(docs, id_col, text_col))
    last = F.col("rid") == F.col("keep")
    return g.select(F.col("id").alias("doc_id"), F.col("keep_id"), F.col("size").cast("long").alias("group_size"),
                    last.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rules of :func:`exact_duplicates`."""
    rows = with_rid(docs, id_col, text_col)
    g = _groups(rows.select("rid", F.col("rid").alias("id"), "text"))
    return rows.join(g.where("rid <> keep").select("rid"), "rid", "left_anti").select("row.*")
