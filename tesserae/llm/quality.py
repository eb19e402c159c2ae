"""Quality: a generalised additive model with pairwise interactions over measures of the whole text.

Each measure is cut into bins at quantiles of the sample.  Cyclic boosting
visits one measure after the other and fits a shallow tree (at most four
leaves) to the gradient in its bins; the trees of a measure add up to its
lookup table.  Then the pairs of measures whose best tree still gains most get
tables of their own in the same way.  A text's score is the logistic function
of one table entry for each measure and pair, added for a batch at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import blocks, ddl, ready
from tesserae.llm.words import windows, words

#: Labelled ids of which the model is fitted at most (those of lowest id hash): the bound of what the driver gathers.
N_ROWS = 20_000
THRESHOLD = 0.5
#: Bins of a measure, pairs with tables of their own, rounds over all measures and over all pairs, step of a tree.
BINS, N_PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 120, 60, 0.15
#: Least weight of a leaf and the ridge added to it.
LEAST, RIDGE = 2.0, 1.0

MEASURES = (
    "log_bytes", "words_per_byte", "upper", "digits", "marks", "stops", "other_bytes", "blanks", "lines_per_word",
    "mark_runs", "mean_word", "long_words", "short_words", "same_as_last", "same_as_second_last", "distinct_words",
    "top_word", "repeated_triples", "repeated_lines", "capital_words", "joined_marks",
)

_KIND = np.zeros(256, np.uint8)  # 0: control and blank, 1: lower, 2: upper, 3: digit, 4: other ASCII mark, 5: stop, 6: other bytes
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[ord(c) for c in ".,;:?!'"]] = 5
_KIND[ord("!")] = 4


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each of the texts ``data[off[i]:off[i + 1]]``; an empty text has only zeros."""
    rows = len(off) - 1
    size = np.diff(off)
    per_byte = lambda flags: _per_row(flags, off) / np.maximum(size, 1)
    kind = _KIND[data]
    mark, upper = kind == 4, kind == 2
    again = np.zeros(len(data), bool)
    again[1:] = mark[1:] & mark[:-1]
    name, start, end, row = words(data, off)
    n = np.bincount(row, minlength=rows)
    per_word = lambda flags, least=1: np.bincount(row[:len(flags)][flags], minlength=rows) / np.maximum(n, least)
    length = end - start
    line = data == 10
    newlines = _per_row(line, off)
    after = np.zeros(len(data) + 1, np.uint8)
    after[:-1] = kind
    follows = after[end] == 4  # a mark right behind the word
    order = np.lexsort((name, row))
    top = _top_and_distinct(name[order], row[order], rows)[0]
    place = np.arange(len(name)) - (np.cumsum(n) - n)[row]
    distinct = _distinct_nearby(name, row, place // 64, rows)
    triple = windows(name, 3)
    inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    t_name, t_row, t_place = (x[:len(triple)][inside] for x in (triple, row, place))
    t_distinct = _distinct_nearby(t_name, t_row, t_place // 256, rows)
    triples = np.bincount(t_row, minlength=rows)
    lines, lines_distinct = _lines(data, off, name, start, row)
    return np.column_stack([
        np.log1p(size), n / np.maximum(size, 1), per_byte(upper), per_byte(kind == 3), per_byte(mark), per_byte(kind == 5),
        per_byte(kind == 6), per_byte(kind == 0), newlines / np.maximum(n, 1), per_byte(again),
        np.bincount(row, length, rows) / np.maximum(n, 1), per_word(length >= 12), per_word(length <= 3),
        per_word(_same(name, row, 1)), per_word(_same(name, row, 2)), distinct / np.maximum(n, 1), top / np.maximum(n, 1),
        1 - t_distinct / np.maximum(triples, 1) * (triples > 0) - (triples == 0), 1 - lines_distinct / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
        per_word(upper[start]), per_word(follows),
    ]).reshape(rows, len(MEASURES))


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _same(name: np.ndarray, row: np.ndarray, back: int) -> np.ndarray:
    """Words equal to the one ``back`` before them in their row."""
    out = np.zeros(len(name), bool)
    out[back:] = (name[back:] == name[:-back]) & (row[back:] == row[:-back])
    return out


def _top_and_distinct(name: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of names sorted within rows: the count of a row's commonest name, and its number of names."""
    if not len(name):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])])
    count, of = np.diff(np.r_[first, len(name)]), row[first]
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, count)
    return top, np.bincount(of, minlength=rows)


def _distinct_nearby(name: np.ndarray, row: np.ndarray, stretch: np.ndarray, rows: int) -> np.ndarray:
    """The different names of each stretch of a row, summed by row; so their share does not fall with the length of a text."""
    order = np.lexsort((name, stretch, row))
    name, stretch, row = name[order], stretch[order], row[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (stretch[1:] != stretch[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def _lines(data: np.ndarray, off: np.ndarray, name: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with words, and different ones by the words they hold, of each row."""
    rows = len(off) - 1
    if not len(name):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    line = np.cumsum(data == 10)[start] + row * 0
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
    place = (np.arange(len(name)) - np.repeat(first, np.diff(np.r_[first, len(name)]))).astype(np.uint64)
    text = np.add.reduceat(name * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), first)
    order = np.lexsort((text, row[first]))
    return np.bincount(row[first], minlength=rows), _top_and_distinct(text[order], row[first][order], rows)[1]


@dataclass
class Model:
    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)  # of each measure, rising
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of measures."""
        z, at = np.full(len(x), self.bias), self.bins(x)
        for table, b in zip(self.tables, at, strict=True):
            z += table[b]
        for grid, (j, k) in zip(self.grids, self.pairs, strict=True):
            z += grid[at[j], at[k]]
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of bins along the last axis, and its gain: ``-1`` and 0 where no cut gains."""
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    all_g, all_h = g.sum(-1)[..., None], h.sum(-1)[..., None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain = np.where((left_h >= LEAST) & (right_h >= LEAST), gain, 0.0)
    if not gain.shape[-1]:
        return np.full(gain.shape[:-1], -1), np.zeros(gain.shape[:-1])
    at = gain.argmax(-1)
    best = np.take_along_axis(gain, at[..., None], -1)[..., 0]
    return np.where(best > 1e-9, at, -1), np.where(best > 1e-9, best, 0.0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The tree of at most two levels over one measure's bins, as a value for each bin."""
    out, (at, _) = np.zeros(len(g)), _cut(g, h)
    for side in ([slice(0, int(at) + 1), slice(int(at) + 1, len(g))] if at >= 0 else []):
        second, _ = _cut(g[side], h[side])
        edge = side.start + int(second) + 1 if second >= 0 else side.stop
        for leaf in (slice(side.start, edge), slice(edge, side.stop)):
            if leaf.start < leaf.stop:
                out[leaf] = _leaf(g[leaf], h[leaf])
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts one measure, then each side by the other, as values of a grid; its gain."""
    best, value = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        up_g, up_h = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]  # rows up to each first cut, summed by the other measure
        down_g, down_h = a.sum(0) - up_g, b.sum(0) - up_h
        (u, gain_u), (d, gain_d) = _cut(up_g, up_h), _cut(down_g, down_h)
        score = lambda x, y: x.sum(-1)**2 / (y.sum(-1) + RIDGE)
        gain = gain_u + gain_d + score(up_g, up_h) + score(down_g, down_h) - a.sum()**2 / (b.sum() + RIDGE)
        if not len(gain) or gain.max() <= best + 1e-9:
            continue
        i, out = int(gain.argmax()), np.zeros_like(a)
        best = float(gain[i])
        for rows, cut in ((slice(0, i + 1), int(u[i])), (slice(i + 1, len(a)), int(d[i]))):
            edge = cut + 1 if cut >= 0 else a.shape[1]
            for columns in (slice(0, edge), slice(edge, a.shape[1])):
                if columns.start < columns.stop:
                    out[rows, columns] = _leaf(a[rows, columns], b[rows, columns])
        value = out.T if turned else out
    return value, best


def fit(x: np.ndarray, label: np.ndarray, bins: int = BINS, n_pairs: int = N_PAIRS, rounds: int = ROUNDS,
        pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Model:
    """A model of rows of measures with labels 0 and 1.  One label only, or no rows, gives a constant score."""
    if not len(label) or label.min() == label.max():
        base = (label.sum() + 0.5) / (len(label) + 1.0)
        return Model(math.log(base / (1 - base)))
    model = Model(math.log(label.mean() / (1 - label.mean())))
    steps = np.arange(1, bins) / bins
    for column in x.T:
        values = np.unique(column)
        edges = np.unique(np.quantile(column, steps, method="lower"))
        near = np.searchsorted(values, edges)  # halfway to the next value seen, so that a cut is no value itself
        model.cuts.append(np.unique((values[near] + values[np.minimum(near + 1, len(values) - 1)]) / 2))
    at = model.bins(x)
    size = [len(c) + 1 for c in model.cuts]
    z = np.full(len(x), model.bias)
    model.tables = [np.zeros(n) for n in size]

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(z)
        return label - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = gradient()
            step = rate * _tree(np.bincount(b, g, size[j]), np.bincount(b, h, size[j]))
            model.tables[j] += step
            z += step[b]
    cell = lambda j, k: at[j] * size[k] + at[k]
    square = lambda v, j, k: np.bincount(cell(j, k), v, size[j] * size[k]).reshape(size[j], size[k])
    g, h = gradient()
    gains = {(j, k): _grid_tree(square(g, j, k), square(h, j, k))[1] for j in range(len(size)) for k in range(j + 1, len(size))}
    model.pairs = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs] if gains[p] > 0]
    model.grids = [np.zeros((size[j], size[k])) for j, k in model.pairs]
    for _ in range(pair_rounds):
        for grid, (j, k) in zip(model.grids, model.pairs, strict=True):
            g, h = gradient()
            step = rate * _grid_tree(square(g, j, k), square(h, j, k))[0]
            grid += step
            z += step[at[j], at[k]]
    return model


_ROWS = {"h": pa.int64(), "label": pa.int32(), "x": pa.list_(pa.float64())}
_SCORES = {"doc_id": pa.int64(), "score": pa.float64()}


def _measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i, j, data, off in blocks(b.column("text")):
            x = pa.FixedSizeListArray.from_arrays(pa.array(measures(data, off).ravel()), len(MEASURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("h")[i:j], b.column("label")[i:j], x], names=list(_ROWS))


def _scorer(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = np.zeros(b.num_rows)
            for i, j, data, off in blocks(b.column("text")):
                score[i:j] = shared.value.score(measures(data, off))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=list(_SCORES))

    return run


def held_out(doc_id: Column) -> Column:
    """Rows never trained on: those whose id's CRC-32 leaves 1 modulo 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train_on(docs: DataFrame, labels: DataFrame, n_rows: int = N_ROWS) -> Model:
    """A model fitted on the documents of at most ``n_rows`` labelled ids that are not held out.

    The ids are drawn by hash from the labels alone, so that the documents are
    read once and joined with a table of bounded size, without a shuffle of
    texts.  Labels other than 0 and 1 and null ids are left out; an id labelled
    twice is good if both say so.  Rows of equal text and label count once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select(F.xxhash64("text").alias("h"), "label", "text")
    once = rows.mapInArrow(_measured, ddl(_ROWS)).groupBy("h", "label").agg(F.min("x").alias("x"))
    found = sorted(once.collect(), key=lambda r: (r["h"], r["label"]))
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(MEASURES))
    return fit(x, np.array([r["label"] for r in found], float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_rows: int = N_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null texts count as empty; an empty text has the score of a text whose
    measures are all 0.  Rows with null or repeated ids are scored row by row;
    a null id has no label.  Without labels every score is one half.  Columns
    other than the id and the text are not read."""
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(train_on(docs, labels, n_rows))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = base.mapInArrow(_scorer(model), ddl(_SCORES))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_rows: int = N_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns, in one pass over them."""
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(train_on(docs, labels, n_rows))
    text = F.col("text").cast("string")

    @F.pandas_udf("double")
    def score(texts):
        out = np.zeros(len(texts))
        for i, j, data, off in blocks(pa.array(texts, pa.string())):
            out[i:j] = model.value.score(measures(data, off))
        return type(texts)(out)

    return docs.where(score(text) >= threshold)
