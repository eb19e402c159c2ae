"""Vector codes: each vector as 16 one-byte indices into small integer codebooks.

The nearest codebook entry of a part is searched by slicing and intersecting:
the entries' coordinates are sorted in each dimension, and every position of
that order carries the uint64 mask of the entries before it.  The distance to a
first guess is a radius within which the nearest entry must lie; in each
dimension the entries of that range are the difference of two prefix masks, and
the masks of all dimensions, ANDed, name the only entries whose distances are
computed.  All arithmetic is on integers and exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ddl, stored
from tesserae.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose masks are worked on at once.
CHUNK = 1 << 13


class Slices:
    """The entries of one part's codebook (at most 64), sorted in each dimension, with their prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, 0)
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        np.bitwise_or.accumulate(np.uint64(1) << self.order.astype(np.uint64), axis=0, out=self.prefix[1:])

    def distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - self.entries[entry]
        return (d * d).sum(1)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries no further than ``radius`` from ``x`` in any dimension."""
        mask = np.full(len(x), self.prefix[-1, 0] if x.shape[1] else (1 << len(self.entries)) - 1, np.uint64)
        for d in range(x.shape[1]):
            first = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            stop = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[stop, d] & ~self.prefix[first, d]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, ties to the lower index, and its squared distance."""
        best, far = np.zeros(len(x), np.int64), self.distance(x, np.zeros(len(x), np.int64))
        for d in range(x.shape[1]):  # the guess: of the neighbours in each dimension's order the closest
            at = np.minimum(np.searchsorted(self.sorted[:, d], x[:, d]), len(self.entries) - 1)
            far = np.minimum(far, self.distance(x, self.order[at, d]))
        mask = self.candidates(x, np.floor(np.sqrt(far.astype(float))).astype(np.int64) + 1)
        far += 1  # entries at the guess's own distance must count again: the lowest of them wins
        rows = np.arange(len(x))
        while len(rows):  # candidates from the lowest index up, so that a tie never replaces
            low = mask & (~mask + np.uint64(1))
            entry = np.frexp(low.astype(float))[1].astype(np.int64) - 1
            dist = self.distance(x[rows], entry)
            closer = dist < far[rows]
            best[rows[closer]], far[rows[closer]] = entry[closer], dist[closer]
            mask ^= low
            more = mask != 0
            rows, mask = rows[more], mask[more]
        return best, far


def _limit(dim: int) -> int:
    """Integers below this have squared distances over ``dim`` dimensions that fit 64 bits."""
    return math.isqrt((1 << 61) // max(1, dim))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column)
    if len(column) and (pc.min(lengths).as_py(), pc.max(lengths).as_py()) != (dim, dim):
        raise ValueError(f"vectors must all have {dim} components, as the one of the smallest id has")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)
    if x.size and max(int(x.max()), -int(x.min())) >= _limit(dim):
        raise ValueError(f"components must be below {_limit(dim) / SCALE:g} in size")
    return x


def _assigned(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """``(part, rows, entry, squared distance)`` for all parts of all rows; ``books``: parts x entries x width."""
    width = books.shape[2]
    for part, entries in enumerate(books):
        slices = Slices(entries)
        for i in range(0, len(x), CHUNK):
            rows = slice(i, i + CHUNK)
            yield part, rows, *slices.nearest(x[rows, part * width:(part + 1) * width])


_SUMS = {"cell": pa.int64(), "total": pa.int64(), "n": pa.int64()}
_CODES = {"vec_id": pa.int64(), "label": pa.string(), "code": pa.string(), "error": pa.int64()}


def _sums(shared):
    """Per task one row for each component of each entry used: the sum and number of its parts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, k, width = books.shape
        total, n = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for b in it:
            x = _matrix(b.column("v"), parts * width)
            for part, rows, entry, _ in _assigned(x, books):
                np.add.at(total, part * k + entry, x[rows, part * width:(part + 1) * width])
                n += np.bincount(part * k + entry, minlength=parts * k)
        used = np.flatnonzero(n)
        cells = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cells, total[used].ravel(), np.repeat(n[used], width))], names=list(_SUMS))

    return run


_HEX = np.array([f"{i:02x}" for i in range(ENTRIES)], "S2")


def _codes(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, _, width = books.shape
        for b in it:
            code, error = np.zeros((b.num_rows, parts), np.int64), np.zeros(b.num_rows, np.int64)
            for part, rows, entry, dist in _assigned(_matrix(b.column("v"), parts * width), books):
                code[rows, part] = entry
                error[rows] += dist
            text = np.ascontiguousarray(_HEX[code]).view(f"S{2 * parts}").ravel().astype(str) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(error)], names=list(_CODES))

    return run


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v`` of the rows whose vector has only finite components; ``v``: floor(256 x) of each."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` rounds over all vectors.

    They start as the parts of the vectors of smallest id (null ids last, equal
    ids in the order of their vectors).  A round is one pass that sends a row
    for each component of an entry per task; the driver holds the codebooks and their
    sums, at most ``entries`` vectors in size."""
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a mask has a bit for each of at most {ENTRIES} entries")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    dim = len(first[0]["v"]) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    start = _matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())), dim)
    books = np.ascontiguousarray(start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    context = kept.sparkSession.sparkContext
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(context.broadcast(books)), ddl(_SUMS))
        flat = books.ravel().copy()
        for cell, total, n in sums.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")), F.sum("n")).collect():
            flat[cell] = int(total) // n
        books = flat.reshape(books.shape)
    return books


def codebook_text(books: np.ndarray) -> str:
    """All components by part, entry and position, in decimal, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Rows whose vector is null or has a null or non-finite component are left
    out.  Repeated ids are vectors of their own; a null id stays null and comes
    last where ids are ordered.  Fewer vectors than entries make smaller
    codebooks; no vector, no row.  Vectors without components have error 0.
    Vectors of unequal length, of a length that the parts don't divide or with
    components too large for exact 64-bit sums raise ValueError."""
    spark = vectors.sparkSession
    ship_package(spark)
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = train_codebooks(kept, parts, entries, rounds)
    coded = stored(kept.mapInArrow(_codes(spark.sparkContext.broadcast(books)), ddl(_CODES)), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
