"""Source divergence against its definition in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, gid long, value long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def by_rule(docs, min_docs=3, top=200):
    docs = [(t or "", lang or "", source or "") for t, lang, source in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [(TERM.findall(lower(t)), s) for t, x, s in docs if x == lang]
        df = Counter(w for ws, _ in own for w in set(ws))
        kept = sorted(w for w in df if df[w] >= min_docs)
        v, counts = len(kept), {}
        for s in {s for _, s in own} | {None}:
            c = Counter(w for ws, x in own if s in (None, x) for w in ws if df[w] >= min_docs)
            n = sum(c.values())
            counts[s] = c, {w: 1 + 10**9 * (c[w] + 1) // (n + v) for w in kept}
        for s in counts.keys() - {None}:
            p = counts[s][1]
            pairs = [(sum((p[w] - q[w])**2 // q[w] for w in kept), o) for o, (_, q) in counts.items() if o not in (None, s)]
            q = counts[None][1]
            ranked = [((p[w] - q[w])**2 // q[w], w) for w in kept if counts[s][0][w] and p[w] > q[w]]
            for part, found, last in (("pair", pairs, None), ("term", ranked, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:last])}
    return out


def table(spark, docs):
    return spark.createDataFrame([(i, *d, "x", 1, 2, 3) for i, d in enumerate(docs)], SCHEMA)


def check(spark, docs, **kw):
    got = D.source_divergence(table(spark, docs), **kw).collect()
    rows = {tuple(r) for r in got}
    assert len(rows) == len(got)
    assert rows == by_rule(docs, **kw)
    return rows


def corpus(seed, n, sources, words=60, length=30):
    rng = np.random.default_rng(seed)
    names = [f"{'äzé日'[i % 4]}t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    return [(" ".join(names[min(x, words - 1)] for x in rng.zipf(1.3, length)), "de" if rng.random() < 0.3 else "en", f"s{rng.integers(sources)}")
            for _ in range(n)]


@pytest.mark.parametrize("seed, sources, top", [(1, 4, 200), (2, 7, 5), (3, 1, 3)])  # a language of one source is its only group
def test_divergence_equals_its_definition(spark, seed, sources, top):
    rows = check(spark, corpus(seed, 60, sources), top=top)
    assert {r[2] for r in rows} == ({"pair", "term"} if sources > 1 else set())


def test_divergence_of_awkward_rows(spark):
    same = ("Aa bB,ä!cC", "en", "s1")
    docs = [same, same, same, same, (None, "en", "s2"), ("", None, None), ("aa", None, "s1"), ("aa AA", None, "s1"), ("aa", "", "s1"), (None, None, None),
            ("aa bb " * 5000, "en", "s3"), ("rare words only", "fr", "s1"), ("none kept", "fr", "s2"), ("1 2 3 _ []", "it", "s1"), ("x" * 100_000, "en", "s3")]
    rows = check(spark, docs)
    assert ("fr", "s1", "pair", "s2", 0, 1) in rows  # a language that keeps no term
    assert not any(r[0] == "it" for r in rows)  # of a single source and no terms


def test_divergence_of_ties_and_boundary_cells(spark):
    # 300 terms of one cell: the ranks cut through it in UTF-8 order
    tie = " ".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    docs = [(tie, "en", "s1")] * 3 + [("qaa zz zz", "en", "s1"), ("zz", "en", "s2"), ("zz qab", "en", "s2")]
    rows = check(spark, docs)
    assert max(r[5] for r in rows if r[1] == "s1" and r[2] == "term") == 200


def test_divergence_of_empty_tables_and_one_frequent_source(spark):
    assert D.source_divergence(table(spark, [])).collect() == []
    check(spark, [(t, lang, "s0" if i % 3 else s) for i, (t, lang, s) in enumerate(corpus(5, 90, 5))])


def test_tasks_pass_counts_on_and_pairs_come_in_pieces(spark, monkeypatch):
    docs = corpus(6, 50, 6)
    rows = [(lang, s, w, 1) for t, lang, s in docs for w in t.split()]
    batches = table(spark, docs).select("lang", "source", "text").toArrow().to_batches(max_chunksize=7)
    whole = Counter()
    monkeypatch.setattr(D, "HELD", 20)
    out = [b for b in D._count_terms(iter(batches))]
    assert len(out) > 3
    for b in out:
        for r in b.to_pylist():
            whole[r["lang"], r["source"], r["term"]] += r["n"]
    assert {k: n for k, n in whole.items() if k[2]} == Counter(r[:3] for r in rows)
    monkeypatch.setattr(D, "PAIRS", 3)
    g = spark.createDataFrame([("en", f"t{i // 5}", i % 5, 10 + i, 3 + i % 5) for i in range(40)], "lang string, term string, gid long, p long, p0 long").toArrow()
    found = Counter()
    for b in D._shared_terms(iter(g.to_batches(max_chunksize=3))):
        for r in b.to_pylist():
            found[r["gid"], r["other"]] += r["value"]
    f = lambda p, q: (p - q)**2 // q
    by_hand = Counter()
    for a in g.to_pylist():
        for b in g.to_pylist():
            if a["term"] == b["term"] and a["gid"] != b["gid"]:
                by_hand[a["gid"], b["gid"]] += f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"])
    assert found == by_hand


def test_frequencies_are_exact_beyond_64_bits(spark):
    n, total, kept = 9_000_000_000_000_000, 9_100_000_000_000_007, 12_345
    got = spark.range(1).select(D.frequency(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + kept)


def test_terms_are_ranked_behind_a_bounded_limit(spark):
    plan = D.ranked_terms(*(lambda c: (c, D.group_totals(c)))(D.term_counts(table(spark, corpus(7, 9, 2)))))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[lang[^\n]*\[term[^\n]*row_number\(\), 200, Partial", plan)  # a task sends at most so many terms of a value
    assert re.search(r"WindowGroupLimit \[lang[^\n]*value[^\n]*DESC[^\n]*row_number\(\), 200", plan)
