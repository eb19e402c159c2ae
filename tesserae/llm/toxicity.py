"""Toxicity: a logistic classifier whose score must not change when identity terms are swapped.

Features are the presence of informative words and word beginnings in the whole text.  Training
minimises the labelled rows' log loss, an L2 term and, for each labelled
sentence that names a group, the squared change of its score when the group's
term, with its stems, is replaced by another of the same kind and when it is
left out (else the other term, where it is never seen, would only be given the
same weight)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import batch, blocks, ddl, identified, marked, ready, stored, tidy, with_rid
from tesserae.llm.forest import RECALL, SIMILARITY, _classes
from tesserae.llm.words import span_names, words

#: Kinds of identity terms; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("immigrant", "citizen"), ("immigrants", "citizens"),
    ("disabled", "abled"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: Bounds of what the driver gathers: words kept, labelled rows and identity sentences in the sample.
N_WORDS, N_ROWS, N_SENTENCES = 1024, 20_000, 20_000
#: A word is kept if it is in so many labelled rows and its chi-square against the label is so large.
MIN_ROWS, MIN_GAIN = 5, 20.0
#: Weight of a row without near copies; whole numbers, so that sums do not depend on their order.
ONE = 1 << 20
#: Bytes of the word beginnings that are features like whole words.
STEMS = (4, 5, 6, 7)
#: Bytes of text whose features a worker holds at once: five and more arrays of eight bytes a word and stem.
SPAN = 1 << 18
#: Labels of 16 bytes that are broadcast; with more, the documents that their marks leave are joined by a shuffle.
BROADCAST_LABELS = 500_000
THRESHOLD = 0.3


def name_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]))[0].view(np.int64)[0])


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, start, row)`` of the words of a block and of the longer words' stems, in text order."""
    _, start, end, row = words(data, off)
    found = span_names(data, start, end, *(np.minimum(end, start + n) for n in STEMS))
    names, at, rows = [found[0]], [start], [row]
    for n, x in zip(STEMS, found[1:], strict=True):
        long = end - start > n
        names.append(x[long] ^ np.uint64(0xA24BAED4963EE407))
        at.append(start[long])
        rows.append(row[long])
    start = np.concatenate(at)
    order = np.argsort(start, kind="stable")
    return np.concatenate(names)[order].view(np.int64), start[order], np.concatenate(rows)[order]


def features_of(word: str) -> list[int]:
    data = np.frombuffer(word.encode(), np.uint8)
    return features(data, np.array([0, len(data)]))[0].tolist()


@dataclass
class Model:
    names: np.ndarray  # sorted word names (int64)
    weight: np.ndarray
    bias: float = 0.0
    threshold: float = THRESHOLD

    def score(self, name: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Scores of ``rows`` texts whose words are ``name``, of row ``row``."""
        z = np.full(rows, self.bias)
        if len(self.names) and len(name):
            at = np.searchsorted(self.names, name)
            at[at == len(self.names)] = 0
            known = self.names[at] == name
            pairs = np.unique(row[known] * len(self.names) + at[known])  # presence: a word counts once
            z += np.bincount(pairs // len(self.names), self.weight[pairs % len(self.names)], rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Swaps:
    """Of sentences: what a swap takes away, what it adds, and the rest (indices into the words kept).

    A swap changes every feature of the term, its stems like the word itself,
    but those that another word of the sentence has too."""

    gone: list[list[int]] = field(default_factory=list)
    come: list[list[int]] = field(default_factory=list)
    context: list[list[int]] = field(default_factory=list)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The members of all lists and the list that each is of."""
    sizes = np.array([len(x) for x in lists], np.int64)
    members = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
    return members, np.repeat(np.arange(len(lists)), sizes)


def fit(rows: list[list[int]] | tuple[np.ndarray, np.ndarray], label: np.ndarray, weight: np.ndarray, n: int, swaps: Swaps, l2: float = 2e-4, counterfactual: float = 1.0,
        steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam steps; ``rows``: the word indices of each text
    (or all of them, and the text that each is of), which stands for ``weight`` texts."""
    if not len(label) or label.min() == label.max():
        base = ((label * weight).sum() + 0.5) / (weight.sum() + 1.0)
        return np.zeros(n), math.log(base / (1 - base))
    col, row = rows if isinstance(rows, tuple) else _flat(rows)
    prior = (label * weight).sum() / weight.sum()
    w, b, vw, vb = np.zeros(n), math.log(prior / (1 - prior)), np.zeros(n), 0.0
    n_swaps = len(swaps.gone)
    (gone, g_row), (come, c_row), (s_col, s_row) = _flat(swaps.gone), _flat(swaps.come), _flat(swaps.context)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        p = sigmoid(b + np.bincount(row, w[col], len(label)))
        d = (p - label) * weight / weight.sum()
        gw = np.bincount(col, d[row], n) + l2 * w
        gb = d.sum()
        if n_swaps:
            rest = b + np.bincount(s_row, w[s_col], n_swaps)
            minus, plus = np.bincount(g_row, w[gone], n_swaps), np.bincount(c_row, w[come], n_swaps)
            one, two = sigmoid(rest + minus), sigmoid(rest + plus)
            e = 2 * counterfactual * (one - two) / n_swaps
            linear = 2 * counterfactual * (minus - plus) / n_swaps  # saturated scores keep a slope
            d1, d2 = e * one * (1 - one), -e * two * (1 - two)
            gw += np.bincount(gone, (d1 + linear)[g_row], n) + np.bincount(come, (d2 - linear)[c_row], n)
            gw += np.bincount(s_col, (d1 + d2)[s_row], n)
            gb += (d1 + d2).sum()
        g = np.r_[gw, gb]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


_COUNTS = {"name": pa.int64(), "n1": pa.int64(), "n0": pa.int64()}
_ROWS = {"h": pa.int64(), "label": pa.int32(), "weight": pa.int64(), "found": pa.list_(pa.int64())}
_SENTENCES = {"term": pa.int64(), "found": pa.list_(pa.int64())}
_SCORES = {"doc_id": pa.int64(), "score": pa.float64()}


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        label, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
        for i, j, data, off in blocks(b.column("text"), SPAN):
            name, _, row = features(data, off)
            order = np.lexsort((row, name))
            name, row = name[order], row[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
            found, inverse = np.unique(name[new], return_inverse=True)
            toxic, each = label[i:j][row[new]], weight[i:j][row[new]]
            n1 = np.bincount(inverse, toxic * each, len(found)).astype(np.int64)
            yield batch(_COUNTS, found, n1, np.bincount(inverse, each, len(found)).astype(np.int64) - n1)


def _kept_words(names: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, label, weight = (b.column(c).to_pylist() for c in ("h", "label", "weight"))
            out = []
            for i, j, data, off in blocks(b.column("text"), SPAN):
                name, _, row = features(data, off)
                keep = np.isin(name, names)
                name, row = name[keep], row[keep]
                out += [(h[i + r], label[i + r], weight[i + r], np.unique(name[row == r]).tolist()) for r in range(j - i)]
            yield batch(_ROWS, *zip(*out, strict=True))

    return run


def _identity_sentences(names: np.ndarray, terms: np.ndarray):
    """Of each sentence with an identity term: the term and the kept features of the other words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for _, _, data, off in blocks(b.column("text"), SPAN):
                name, start, row = features(data, off)
                stop = np.r_[0, np.cumsum(np.isin(data, np.frombuffer(b".!?\n", np.uint8)))]
                sentence = stop[start] + row * (stop[-1] + 1)
                for k in np.flatnonzero(np.isin(name, terms)):
                    a, z = np.searchsorted(sentence, [sentence[k], sentence[k] + 1])
                    near, begin = name[a:z], start[a:z]
                    other = ~np.isin(begin, begin[near == name[k]])  # a term's stems begin where the term does
                    out.append((name[k], np.unique(near[np.isin(near, names) & other]).tolist()))
            if out:
                yield batch(_SENTENCES, *zip(*out, strict=True))

    return run


def train(labelled: DataFrame, threshold: float = THRESHOLD, identity=IDENTITY, n_words: int = N_WORDS,
          n_rows: int = N_ROWS, n_sentences: int = N_SENTENCES, counterfactual: float = 1.0) -> Model:
    """A model from ``text, label`` (0 or 1; other labels are left out, null text is empty).

    Words are counted over all labelled rows, each by its ``weight`` in parts
    of ONE where there is such a column.  The weights are fitted on at
    most ``n_rows`` rows and ``n_sentences`` identity sentences, those of
    lowest text hash; equal texts of equal label count once at most.  One label only,
    or no rows, gives a constant score."""
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(ONE)
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), weight.cast("long").alias("weight"))
    rows = rows.where("label IN (0, 1)").withColumn("h", F.xxhash64("text"))
    rows = stored(rows, "labelled")
    totals = rows.groupBy("label").agg((F.sum("weight") / ONE).alias("n")).collect()
    n1, n0 = (next((r["n"] for r in totals if r["label"] == k), 0) for k in (1, 0))
    terms = {name_of(t): name_of(kind[(i + 1) % len(kind)]) for kind in identity for i, t in enumerate(kind)}
    counts = rows.mapInArrow(tidy(_word_counts), ddl(_COUNTS)).groupBy("name").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # chi-square of presence against the label
    a, c = F.col("n1") / ONE, F.col("n0") / ONE
    gain = F.pow(a * (n0 - c) - c * (n1 - a), F.lit(2)) * (n1 + n0) / ((a + c) * (n1 + n0 - a - c + 1) * float(max(1, n1 * n0)))
    best = counts.where(a + c >= MIN_ROWS).select("name", gain.alias("gain")).where(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "name").limit(n_words)
    names = np.array(sorted({r["name"] for r in best.collect()} | set(terms)), np.int64)
    at = {x: k for k, x in enumerate(names.tolist())}
    lowest = rows.select("h", "label").distinct().orderBy("h", "label").limit(n_rows).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(lowest))
    found = chosen.mapInArrow(tidy(_kept_words(names)), ddl(_ROWS)).groupBy("label", "found", "h").agg(F.least(F.sum("weight"), F.lit(ONE)).alias("n"))
    found = found.groupBy("label", "found").agg((F.sum("n") / ONE).alias("n")).orderBy("label", "found").toArrow()
    near = chosen.mapInArrow(tidy(_identity_sentences(names, np.array(list(terms), np.int64))), ddl(_SENTENCES))
    parts = {name_of(t): [x for x in features_of(t) if x in at] for kind in identity for t in kind}
    swaps = Swaps()
    for r in near.orderBy(F.xxhash64("term", "found"), "term").limit(n_sentences).collect():
        rest = set(r["found"])
        gone, come = ([at[x] for x in parts[t] if x not in rest] for t in (r["term"], terms[r["term"]]))
        swaps.gone += [gone, gone]
        swaps.come += [come, []]
        swaps.context += [[at[x] for x in r["found"]]] * 2
    lists = found.column("found").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    sample = np.searchsorted(names, lists.flatten().to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    weight, bias = fit(sample, found.column("label").to_numpy().astype(float), found.column("n").to_numpy().astype(float), len(names), swaps,
                       counterfactual=counterfactual)
    return Model(names, weight, bias, threshold)


def _scorer(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = np.zeros(b.num_rows)
            for i, j, data, off in blocks(b.column("text"), SPAN):
                name, _, row = features(data, off)
                score[i:j] = shared.value.score(name, row, j - i)
            yield batch(_SCORES, b.column("rid"), score)

    return run


def held_out(doc_id):
    """Rows never trained on: those whose id's CRC-32 leaves 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train_on(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> Model:
    """Train on the labelled documents that are not held out; a document labelled twice is toxic if either says so.

    Every row counts.  A class of near copies (similarity 0.8, verified) has
    the weight of one row for each of its labels, so that the words of a much
    copied text don't pass for signs of its label."""
    ready(docs.sparkSession)
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
             .where(~held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    known = stored(known, "labels")
    few = known.count() <= BROADCAST_LABELS
    rows = rows.join(F.broadcast(known), "doc_id") if few else marked(rows, known, "doc_id").where("marked").join(known, "doc_id")
    base = stored(identified(rows, keep=("label",)), "known")
    kin = stored(_classes(base, SIMILARITY, RECALL, at_once=True).join(base.select("rid", "label"), "rid").select("rid", "class", "label"), "kin")
    # only rows that share their weight need it joined; all other texts stay where they are
    copies = kin.groupBy("class", "label").agg(F.count("*").alias("n")).where("n > 1")
    copies = copies.select("class", "label", F.greatest(F.lit(1), F.round(F.lit(ONE) / F.col("n"))).cast("long").alias("weight"))
    shared = stored(kin.join(copies, ["class", "label"]).select("rid", "weight"), "shared")
    rows = marked(base.select("rid", "text", "label"), shared)
    alone = rows.where("NOT marked").select("text", "label", F.lit(ONE).cast("long").alias("weight"))
    others = rows.where("marked").join(shared, "rid", "left").select("text", "label", F.coalesce("weight", F.lit(ONE)).cast("long").alias("weight"))
    return train(alone.unionByName(others), threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have the score of a text without known words.  Rows
    with null or repeated ids are scored row by row; a null id has no label.
    Without labels every score is one half."""
    model = docs.sparkSession.sparkContext.broadcast(train_on(docs, labels, threshold))
    base = docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text"))
    scored = base.mapInArrow(tidy(_scorer(model)), ddl(_SCORES))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train_on(docs, labels, threshold))
    rows = with_rid(docs)
    bad = rows.select("rid", "text").mapInArrow(tidy(_scorer(model)), ddl(_SCORES)).where(F.col("score") >= threshold)
    return rows.join(bad.select(F.col("doc_id").alias("rid")), "rid", "left_anti").select("row.*")
