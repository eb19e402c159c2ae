"""The quality model: its parts by brute force, its scores on held-out rows, awkward rows."""

import math
import re
import zlib

import numpy as np
import pytest

from tesserae.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, label int, h long, score double"


def prose(rng, n=60):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def junk(rng, n=60):
    return " ".join(f"{w}{'###' if rng.random() < 0.5 else '&&&'}" for w in prose(rng, n).split())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    good = [(i, prose(rng), 1) for i in range(0, 600, 2)]
    bad = [(i, junk(rng) if i % 4 == 1 else ("buy now " * 40 if i % 8 == 3 else prose(rng).upper()), 0) for i in range(1, 600, 2)]
    return good + bad


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 0.5) for i, t, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r["doc_id"]: r for r in Q.quality(docs, labels).collect()}
    assert len(got) == len(corpus)
    held = [(got[i], q) for i, _, q in corpus if got[i]["held_out"]]
    assert 100 < len(held) < 300
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(r["predicted"] == q for r, q in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert Q.keep_good(docs, labels).count() == sum(r["predicted"] for r in got.values())
    assert Q.keep_good(docs, labels).columns == docs.columns


def test_held_out_labels_are_never_seen(spark, corpus):
    docs, labels = frames(spark, corpus)
    turned = frames(spark, [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, t, q in corpus])[1]
    scores = [sorted(tuple(r) for r in Q.quality(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_awkward_rows(spark, corpus):
    rows = corpus + [(None, None, 1), (None, "", 0), (5, "another row of id five", 1), (5, "another row of id five", 1), (9000, "é" * 5000, None), (9001, " ".join(prose(np.random.default_rng(i)) for i in range(1500)), None),
                     (9002, "...", 3), (9003, "\n\n\n", 1), (9004, "", None)]
    docs, labels = frames(spark, rows)
    got = Q.quality(docs, labels).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, _, _ in rows if i is not None)
    assert sum(r["doc_id"] is None for r in got) == 2
    assert len({r["score"] for r in got if r["doc_id"] in (None, 9004)}) == 1  # null and empty texts alike
    assert next(r for r in got if r["doc_id"] == 9001)["predicted"] == 1


def test_empty_tables_and_one_label(spark, corpus):
    docs, labels = frames(spark, corpus[:20])
    assert Q.quality(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    one = {r["score"] for r in Q.quality(*frames(spark, corpus[:20])).collect()}
    assert len(one) == 1 and one.pop() > 0.8  # all of label 1


def test_the_bound_holds_and_copies_count_once(spark, corpus, monkeypatch):
    docs, labels = frames(spark, corpus + [(10_000 + i, "copied " * 9, 1) for i in range(200)])
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, y: seen.append(len(y)) or Q.Model())
    Q.train_on(docs, labels, n_rows=50)
    Q.train_on(docs, labels)
    assert 10 < seen[0] <= 50
    assert seen[1] <= 1 + sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in corpus)


def test_scores_are_table_entries_added_up():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single measure tells
    m = Q.fit(x, y, rounds=20, pair_rounds=40)
    assert (0, 1) in m.pairs
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95
    for row, s in zip(x[:30], m.score(x[:30]), strict=True):
        at = [sum(c <= v for c in cuts) for v, cuts in zip(row, m.cuts, strict=True)]
        z = m.bias + sum(t[b] for t, b in zip(m.tables, at, strict=True)) + sum(g[at[j], at[k]] for g, (j, k) in zip(m.grids, m.pairs, strict=True))
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


def test_trees_are_the_best_by_brute_force():
    rng = np.random.default_rng(4)
    gain = lambda parts: sum(g.sum()**2 / (h.sum() + Q.RIDGE) for g, h in parts)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.uniform(1, 9, 9)
        at, best = Q._cut(g, h)
        brute = [gain([(g[:i], h[:i]), (g[i:], h[i:])]) - gain([(g, h)]) for i in range(1, 9) if h[:i].sum() >= Q.LEAST and h[i:].sum() >= Q.LEAST]
        assert best == pytest.approx(max([0, *brute]))
        grid_g, grid_h = rng.normal(size=(4, 5)), rng.uniform(3, 9, (4, 5))
        found = 0
        for a, b in ((grid_g, grid_h), (grid_g.T, grid_h.T)):
            for i in range(1, len(a)):
                sides = [max([gain([(s, t)])] + [gain([(s[:, :j], t[:, :j]), (s[:, j:], t[:, j:])]) for j in range(1, a.shape[1])])
                         for s, t in ((a[:i], b[:i]), (a[i:], b[i:]))]
                found = max(found, sum(sides) - gain([(a, b)]))
        value, best = Q._grid_tree(grid_g, grid_h)
        assert best == pytest.approx(found)
        assert len(np.unique(value.round(12))) <= 4


def test_measures_by_plain_python():
    texts = ["", "One two, two\none two\n\nThree### x!! 12", "ÄÖ ä", "a\na\nb\na", "no end", "x y z " * 90, "q " * 70]
    data = [t.encode() for t in texts]
    x = Q.measures(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    assert x.shape == (len(texts), len(Q.MEASURES)) and not x[0].any()
    at = {k: i for i, k in enumerate(Q.MEASURES)}
    for row, t, d in zip(x[1:], texts[1:], data[1:], strict=True):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        lines = [tuple(re.findall(r"\w+", line.lower())) for line in t.split("\n")]
        lines = [line for line in lines if line]
        assert row[at["log_bytes"]] == pytest.approx(math.log1p(len(d)))
        assert row[at["words_per_byte"]] == pytest.approx(len(w) / len(d))
        assert row[at["upper"]] == pytest.approx(len(re.findall("[A-Z]", t)) / len(d))
        assert row[at["marks"]] == pytest.approx(len(re.findall("[#!]", t)) / len(d))
        assert row[at["distinct_words"]] == pytest.approx(len({(i // 64, x) for i, x in enumerate(w)}) / len(w))
        assert row[at["top_word"]] == pytest.approx(max(map(w.count, w)) / len(w))
        assert row[at["same_as_last"]] == pytest.approx(sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w))
        assert row[at["repeated_lines"]] == pytest.approx(1 - len(set(lines)) / len(lines))
        triples = list(zip(w, w[1:], w[2:], strict=False))
        near = {(i // 256, x) for i, x in enumerate(triples)}
        assert row[at["repeated_triples"]] == pytest.approx(1 - len(near) / len(triples) if triples else 0)
