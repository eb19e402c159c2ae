"""S3: a splittable reader of files that hold one JSON array of objects.

A JSON parser has to know, at any byte, whether it is inside a string and how
deep the brackets are; that is why one file is usually one task.  Here the
files are read as pieces that end at a ``}``, which Spark's text source splits
anywhere, and the state is found by a prefix scan:

1. every split of a file reports, for both possible states at its start, how
   it changes the bracket depth, the lowest depth it reaches and whether it
   ends inside a string (a row for each split);
2. the driver runs over these rows, file by file, and gets each split's true
   state at its start;
3. every split cuts its pieces into elements from there.  Whole elements are
   passed on at once; only the parts of elements that lie across splits are
   shuffled, a few for each split, and put together.

Each element is then parsed alone."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPE = re.compile(r"\\.", re.S)
_OUTSIDE = " \t\r\n,[]"

_SUMMARY = "file string, start long, depth0 long, low0 long, depth1 long, low1 long, quotes long"
_PARTS = "file string, element string, part long, text string"


def _brackets(piece: str, inside: int) -> list[int]:
    """Signed brackets outside strings, in order; ``inside``: the piece begins within a string."""
    return [1 if c in "{[" else -1 for part in piece.split('"')[inside::2] for c in re.findall(r"[{}\[\]]", part)]


def _steps(piece: str, closed: bool, inside: int) -> tuple[int, int, int]:
    """Change of depth, lowest depth on the way (from 0) and quotes of a piece with its final ``}``."""
    if "\\" in piece:
        piece = _ESCAPE.sub("", piece)
    quotes = piece.count('"')
    depth = low = 0
    for b in _brackets(piece, inside):
        depth += b
        low = min(low, depth)
    if closed and not (inside + quotes) % 2:
        depth -= 1
        low = min(low, depth)
    return depth, low, quotes


def _rows(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in it:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in fields])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def _summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: what it does to the state, from outside (0) and inside (1) a string."""
    now, rows = None, []
    for file, start, piece in _rows(it, "file", "start", "value"):
        if now is None or now[:2] != [file, start]:
            now = [file, start, 0, 0, 0, 0, 0]
            rows.append(now)
        for inside in (0, 1):
            at = 2 + 2 * inside
            depth, low, quotes = _steps(piece, True, (now[6] + inside) % 2)
            now[at + 1] = min(now[at + 1], now[at] + low)
            now[at] += depth
        now[6] += quotes
    yield _batch(rows, _SUMMARY)


def split_states(summaries: list) -> list[tuple[str, int, int, int, str, int]]:
    """``(file, start, inside, depth, element, last)`` of each split: the state at its
    beginning, the name of the element that goes on there, and whether it is its file's last.

    A file's last piece ends with the file, not with a bracket, which the
    summary counted; so a file that ends well is left one below the ground."""
    out = []
    for file, rows in itertools.groupby(sorted(summaries, key=lambda r: (r["file"], r["start"])), key=lambda r: r["file"]):
        inside, depth, element = 0, 0, ""
        for r in rows:
            out.append((file, r["start"], inside, depth, element, 0))
            low = depth + (r["low1"] if inside else r["low0"])
            depth += r["depth1"] if inside else r["depth0"]
            inside = (inside + r["quotes"]) % 2
            if low <= 1:  # no element came from before and lasts to the end, so one that is open began here
                element = str(r["start"])
        out[-1] = (*out[-1][:-1], 1)
        if (inside, depth) != (0, -1):
            raise ValueError(f"{file}: the JSON array does not end")
    return out


def _elements(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole elements (``element`` null), and the parts of those that cross splits with the element's name."""
    rows, split, buffer, inside, depth, element, carried = [], None, [], 0, 0, "", False

    def rest() -> list[tuple]:
        text = "".join(buffer)
        if depth <= 1 and not inside and not carried:
            if text.strip(_OUTSIDE):
                raise ValueError(f"{split[0]}: not an object of the JSON array: {text.strip(_OUTSIDE)[:80]!r}")
            return []
        return [(split[0], element, split[1], text if carried else text.lstrip(_OUTSIDE))]

    coming = itertools.pairwise(itertools.chain(_rows(it, "file", "start", "value", "inside", "depth", "element", "last"), [(None,) * 7]))
    for (file, start, value, inside0, depth0, element0, last), after in coming:
        if split != (file, start):
            if inside0 is None:
                raise ValueError(f"{file}: its splits are no longer those that were scanned (files or spark.sql.files settings changed)")
            if split:
                rows += rest()
            split, buffer, inside, depth = (file, start), [], inside0, depth0
            carried = depth > 1 or inside == 1
            element = element0 if carried else str(start)
        closed = not (last and after[:2] != (file, start))
        change, _, quotes = _steps(value, closed, inside)
        inside, depth = (inside + quotes) % 2, depth + change
        buffer.append(value + "}" if closed else value)
        if closed and depth == 1 and not inside:
            text = "".join(buffer)
            rows.append((file, element, start, text) if carried else (file, None, None, text.lstrip(_OUTSIDE)))
            buffer, element, carried = [], str(start), False
        if len(rows) >= 1000:
            yield _batch(rows, _PARTS)
            rows = []
    if split:
        rows += rest()
    yield _batch(rows, _PARTS)


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The elements of the arrays in ``path`` as JSON text (``text``), files read split by split.

    Elements must be objects.  An array that does not end, or anything else
    between its elements, is an error.  The scan runs at once; if the splits
    change before the result is read, that is an error too."""
    from tesserae.session import ship_package

    ship_package(spark)
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    states = split_states(raw.mapInArrow(_summaries, _SUMMARY).collect())  # a row for each split of the files
    if not states:
        return spark.createDataFrame([], "text string")
    known = spark.createDataFrame(states, "file string, start long, inside int, depth long, element string, last int")
    parts = raw.join(F.broadcast(known), ["file", "start"], "left").mapInArrow(_elements, _PARTS)
    crossing = parts.where("element IS NOT NULL").groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"))
    joined = crossing.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return parts.where("element IS NULL").select("text").unionAll(joined)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """S3: the objects of files that each hold one JSON array, many tasks a file.

    Missing keys are null, extra keys dropped, an element that does not fit
    the schema is an error."""
    return array_elements(spark, path).select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
