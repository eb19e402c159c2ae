"""Source divergence audit: how the term frequencies of the sources of a language differ.

Count-cell ranking: the smoothed frequencies depend on counts only, so terms
are grouped by their cell (count in the group, count in the language), the
divergence is evaluated once a cell, and cells are ranked with the number of
their terms.  Cells of equal value are merged, and only those that reach the
ranks asked for are expanded to terms, in UTF-8 order.

For two sources the same holds: a term that one of them lacks depends on the
other's count alone, so it is summed by cells; only terms in both are looked at
one by one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import ddl, stored
from tesserae.session import ship_package

MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Distinct terms that a task counts before it passes them on, and pairs of rows that it evaluates at once.
HELD, PAIRS = 200_000, 1 << 19

#: Bytes of terms, A-Z lower-cased; every other byte parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}


def terms(text: str) -> list[bytes]:
    """The text's terms: runs of ASCII letters, lower-cased, and non-ASCII characters."""
    return text.encode().translate(_TERM_BYTES).split()


def _count_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term); the empty term stands for the group itself."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows() -> pa.RecordBatch:
        out = [(*g, t.decode(), k, docs[g][t]) for g, c in n.items() for t, k in c.items()]
        n.clear()
        docs.clear()
        columns = zip(*out, strict=True) if out else [[]] * len(_COUNTS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTS.values(), strict=True)], names=list(_COUNTS))

    held = 0
    for b in it:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            group = (lang, source)
            if group not in n:
                n[group], docs[group] = Counter({b"": 0}), Counter()
            found = Counter(terms(text))
            held += len(found) - len(found.keys() & n[group].keys())
            n[group].update(found)
            docs[group].update(found.keys())
            if held > HELD:
                yield rows()
                held = 0
    yield rows()


def _div(a: Column, b: Column) -> Column:
    """The whole quotient, rounded down, of numbers that are not negative."""
    return F.call_function("div", a, b)


def frequency(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (n + 1) / (total + kept))``, exactly; null where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(kept > 0, F.lit(1) + _div(wide(n + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + kept)))


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, n_sources, head`` of the terms in at least ``min_docs`` documents of their language.

    Each group also has a row of the empty term, with ``n`` 0.  ``head`` is
    true in one row of each (lang, term).  Tasks count before the one shuffle,
    by (lang, term), so a frequent term moves a row for each task and source."""
    ship_package(docs.sparkSession)
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count_terms, ddl(_COUNTS))
    one = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    seen = one.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"),
                      F.count("*").over(of_term).alias("n_sources"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"))
    return seen.where((F.col("term") == "") | (F.col("lang_docs") >= min_docs)).drop("lang_docs")


def group_totals(counts: DataFrame) -> DataFrame:
    """A row for each group: ``gid, lang, source``, its count ``total``, the language's ``lang_total`` and number ``kept`` of terms, ``p0``."""
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("head") & (F.col("term") != "")).alias("kept"))
    return groups.join(langs, "lang").select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "total", "lang_total", "kept",
                                             frequency(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p0"))


def ranked_terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The terms more frequent in a group than in its language, the ``top`` of each group, by count cells."""
    own = counts.where("term <> ''")
    cells = own.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    p, q = frequency(F.col("n"), F.col("total"), F.col("kept")), frequency(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    valued = cells.withColumn("p", p).withColumn("q", q).where("p > q").select("lang", "source", "n", "lang_n", "terms", divergence(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # each value has a term at least, so no more than the first `top` values can matter
    best = merged.withColumn("at", F.row_number().over(by_value)).where(F.col("at") <= top)
    before = F.coalesce(F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = best.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    wanted = valued.drop("terms").join(reached, ["lang", "source", "value"])
    expanded = own.select("lang", "source", "n", "lang_n", "term").join(wanted, ["lang", "source", "n", "lang_n"])
    of_value = Window.partitionBy("lang", "source", "value").orderBy("term")
    placed = expanded.withColumn("place", F.row_number().over(of_value)).where(F.col("place") <= top)
    rank = (F.col("before") + F.col("place")).cast("int")
    return placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= top)


_SHARED = {"gid": pa.int64(), "other": pa.int64(), "value": pa.int64()}


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact sums of ``value`` by (a, b)."""
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(value, first) if len(a) else value


def _shared_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (lang, term): for each two sources of a term, what sums by cells leave out, summed by sources."""

    def evaluated(t: pa.Table, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        gid, p, p0 = (t.column(c).to_numpy() for c in ("gid", "p", "p0"))
        size = np.diff(edge)
        size, start = np.repeat(size, size), np.repeat(edge[:-1], size)  # of each row: of its term's rows
        stop, i = np.cumsum(size), 0
        while i < len(gid):
            j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(i, j), size[i:j])
            b = np.arange(len(a)) - np.repeat(stop[i:j] - size[i:j] - (stop[i - 1] if i else 0), size[i:j]) + start[a]
            a, b = a[a != b], b[a != b]
            yield _summed(gid[a], gid[b], _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b]))
            i = j

    rest, found, held = None, [], 0

    def rows() -> pa.RecordBatch:
        sums = _summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in sums], names=list(_SHARED))

    for b in _with_end(it):
        t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if t is None or not t.num_rows:
            continue
        lang, term = (t.column(c).to_numpy() for c in ("lang", "term"))
        edge = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])])
        if b is not None:  # the last term may go on
            rest, t = t.slice(int(edge[-1])), t.slice(0, int(edge[-1]))
        else:
            edge = np.r_[edge, t.num_rows]
        for sums in evaluated(t, edge):
            found.append(sums)
            held += len(sums[0])
            if held > 2 * PAIRS:
                yield rows()
                held = 0
    if found:
        yield rows()


def _with_end(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from it
    yield None


def ranked_sources(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Each two sources of a language with their divergence over all kept terms.

    The sum over all kept terms is: what it is if neither source has any,
    corrected by the cells of either one's own terms, corrected by the terms
    that both have.  Only the last looks at single terms, in tasks that hold
    all sources of a term and pass on a sum for each two sources."""
    own = counts.join(groups, ["lang", "source"])
    p = frequency(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    shared = own.where("term <> '' AND n_sources > 1").select("lang", "term", "gid", p, "p0")
    shared = shared.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_shared_terms, ddl(_SHARED))
    cells = own.groupBy("lang", "gid", "n", "total", "kept", "p0").agg(F.count("*").alias("terms")).withColumn("p", p)
    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    wide = lambda c: c.cast("decimal(38,0)")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    neither = divergence(p0, q0)
    there = F.when(F.col("n") == 0, wide(F.col("kept")) * neither).otherwise(wide(F.col("terms")) * (divergence(p, q0) - neither))
    back = wide(F.col("terms")) * (divergence(q0, p) - divergence(q0, p0))
    both = cells.join(other, "lang").where("gid <> other").groupBy("gid", "other").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
    sums = (both.select("gid", "other", wide(F.col("there")).alias("value"))
            .unionAll(both.select(F.col("other").alias("gid"), F.col("gid").alias("other"), wide(F.col("back"))))
            .unionAll(shared.select("gid", "other", wide(F.col("value")))))
    total = sums.groupBy("gid", "other").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
    named = total.join(groups.select("gid", "lang", "source"), "gid").join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of the language, part ``term`` the group's terms.

    Null texts, langs and sources count as empty.  Repeated rows are documents
    of their own.  A language without kept terms has pairs of value 0 and no
    terms; a language of one source has no pairs.  Ties rank in UTF-8 order.
    Other columns are not read."""
    counts = stored(term_counts(docs, min_docs), "terms")
    groups = stored(group_totals(counts), "groups")
    return ranked_sources(counts, groups).unionByName(ranked_terms(counts, groups, top))
