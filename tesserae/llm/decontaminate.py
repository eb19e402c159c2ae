"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every document.

Words: :mod:`tesserae.llm.words`.  A window is 13 consecutive words of an
item; an item of fewer words (but not none) is one window.  Every hash hit is
verified against the window's words before it counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import batch, blocks, ddl, identified, tidy, with_rid
from tesserae.llm.words import LOWER, windows, words

WINDOW = 13
#: Windows in one broadcast (about 150 bytes each); more are scanned slice by slice.
MAX_WINDOWS = 1_000_000

_GRAMS = {"item_id": pa.int64(), "n": pa.int32(), "name": pa.int64(), "gram": pa.binary()}
_HITS = {"rid": pa.int64(), "id": pa.int64(), "n_words": pa.int64(), "spans": pa.list_(pa.int64()),
         "items": pa.list_(pa.int64())}
_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(),
        "items_sha256": pa.string(), "contaminated": pa.bool_()}


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids = b.column("item_id").to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for i, _, data, off in blocks(b.column("text")):
            name, s, e, row = words(data, off)
            low = LOWER[data].tobytes()
            for r in np.unique(row):
                at = np.flatnonzero(row == r)
                n = min(WINDOW, len(at))
                for k, h in enumerate(windows(name[at], n).view(np.int64)):
                    out.append((ids[i + r], n, h, b" ".join(low[s[j]:e[j]] for j in at[k:k + n])))
        if out:
            yield batch(_GRAMS, *zip(*out, strict=True))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``n, name, gram, items``: the distinct windows; rows with a null id or without words have none."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    grams = rows.where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(tidy(_grams), ddl(_GRAMS))
    return grams.groupBy("n", "name", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _scan(lookup):
    """A task's scan: documents against the windows of one broadcast."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup.value
        by_n = {n: np.sort(np.array([h for k, h in table if k == n], np.int64)) for n in {k for k, _ in table}}
        for b in it:
            ids, total = b.column("id").to_pylist(), b.num_rows
            n_words, spans, items = np.zeros(total, np.int64), [[] for _ in range(total)], [set() for _ in range(total)]
            for i, j, data, off in blocks(b.column("text")):
                name, s, e, row = words(data, off)
                n_words[i:j] = np.bincount(row, minlength=j - i)
                begin = np.searchsorted(row, np.arange(j - i))
                low = None
                for n, known in by_n.items():
                    h = windows(name, n).view(np.int64)
                    if not len(h):
                        continue
                    at = np.searchsorted(known, h)
                    at[at == len(known)] = 0
                    for k in np.flatnonzero((known[at] == h) & (row[:len(h)] == row[n - 1:])):
                        low = low if low is not None else LOWER[data].tobytes()
                        gram = b" ".join(low[x:y] for x, y in zip(s[k:k + n], e[k:k + n], strict=True))
                        if found := table[(n, int(h[k]))].get(gram):
                            r = int(row[k])
                            spans[i + r] += (int(k - begin[r]), int(k - begin[r] + n))
                            items[i + r].update(found)
            yield batch(_HITS, b.column("rid"), ids, n_words, [merged(x) for x in spans], [sorted(x) for x in items])

    return run


def merged(flat: list[int]) -> list[int]:
    """Starts and ends, flat, with overlapping or touching spans joined."""
    out: list[int] = []
    for a, z in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += (a, z)
    return out


def hits(base: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``rid, id, n_words, spans, items`` of every document.

    ``spans`` are the hit words (start, end, start, end, ...).  The windows go
    to the tasks in broadcasts of at most ``max_windows``; a larger benchmark
    takes one scan per slice, and the slices' spans are joined per document."""
    spark = base.sparkSession
    grams = benchmark_windows(benchmark).withColumn("u", F.pmod(F.col("name"), F.lit(1 << 20)))
    slices = max(1, -(-grams.count() // max_windows))
    scans = []
    for k in range(slices):
        table: dict = {}
        for r in grams.where(F.col("u") % slices == k).toLocalIterator():
            table.setdefault((r["n"], r["name"]), {})[bytes(r["gram"])] = list(r["items"])
        scans.append(base.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(table))), ddl(_HITS)))
    if slices == 1:
        return scans[0]
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    return every.groupBy("rid", "id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                                     F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _report(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for doc_id, n, spans, items in zip(*(b.column(c).to_pylist() for c in ("id", "n_words", "spans", "items")), strict=True):
            flat = merged(spans)
            hit = sum(flat[1::2]) - sum(flat[::2])
            names = ",".join(sorted(map(str, items)))
            out.append((doc_id, n, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), hit > 0 and 20 * hit >= n))
        if out:
            yield batch(_OUT, *zip(*out, strict=True))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and are clean.  Rows with null or
    repeated ids are judged row by row.  Repeated items share windows and each
    counts.  An empty benchmark contaminates nothing."""
    return hits(identified(docs, id_col, text_col), benchmark).mapInArrow(tidy(_report), ddl(_OUT))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated (fewer than one word in twenty hit), with all their columns."""
    rows = with_rid(docs, id_col, text_col)
    found = hits(rows.select("rid", F.col("rid").alias("id"), "text"), benchmark)
    bad = found.where("size(spans) > 0").mapInArrow(tidy(_report), ddl(_OUT)).where("contaminated").select(F.col("doc_id").alias("rid"))
    return rows.join(bad, "rid", "left_anti").select("row.*")
