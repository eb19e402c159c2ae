"""Vector codes against plain Python, exactly."""

import hashlib
import math

import numpy as np
import pytest

from tesserae.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, v int, of string"


def by_rule(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * width:(j + 1) * width]
    books = [[cut(v, j) for _, v, _ in order[:entries]] for j in range(parts)]
    dist = lambda a, b: sum((x - y)**2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, j: min((dist(cut(v, j), e), k) for k, e in enumerate(books[j]))
    for _ in range(rounds):
        found = [[nearest(v, j)[1] for j in range(parts)] for _, v, _ in kept]
        new = []
        for j in range(parts):
            own = {k: [cut(v, j) for (_, v, _), f in zip(kept, found, strict=True) if f[j] == k] for k in range(len(books[j]))}
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[j])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        best = [nearest(v, j) for j in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return [(*r[:3], total[r[3]], digest) for r in out]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2, "y") for i, v, label in rows], SCHEMA)
    got = [tuple(r) for r in V.vector_codes(df, **kw).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(by_rule(rows, **kw), key=key)
    return got


def vectors(seed, n, dim=32, spread=0.2, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, spread, (n, dim))
    x = np.round(x / step) * step if step else x
    return [(int(i), v.tolist(), int(rng.integers(3)) if rng.random() < 0.8 else None) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("seed, n, step", [(1, 150, None), (2, 90, 0.1), (3, 40, None)])  # coarse steps make many ties; 40 < 64 entries
def test_codes_equal_their_definition(spark, seed, n, step):
    assert len(check(spark, vectors(seed, n, step=step))) == n


def test_codes_of_awkward_rows(spark):
    rows = vectors(4, 70)
    v = rows[0][1]
    rows += [(200, None, 1), (201, [None] + v[1:], 1), (202, [float("nan")] + v[1:], 1), (203, [float("inf")] + v[1:], None), (None, v, None), (None, v, 1),
             (rows[3][0], v, 2), (rows[3][0], v, 2), (-5, [-x for x in v], 0), (300, [1000.0] * 32, None), (301, [-0.001] * 32, 9)]
    got = check(spark, rows)
    assert len(got) == 70 + 7


def test_codes_of_equal_vectors_and_of_none(spark):
    assert {r[1] for r in check(spark, [(i, [0.5] * 16, None) for i in range(70)])} == {"00" * 16}
    assert check(spark, []) == []
    assert check(spark, [(1, None, 1), (2, [float("nan")] * 16, 1)]) == []
    assert [r[1:4] for r in check(spark, [(1, [], 1), (2, [], 2)])] == [("00" * 16, 0, 0)] * 2


def test_vectors_that_cannot_be_cut_are_refused(spark):
    for bad in ([(1, [0.1] * 17, 1)], [(1, [0.1] * 16, 1), (2, [0.1] * 32, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception, match="component"):
            V.vector_codes(spark.createDataFrame(bad, "vec_id long, embedding array<double>, label int")).collect()


def test_other_sizes(spark):
    check(spark, vectors(5, 60, dim=12), parts=4, entries=9, rounds=3)


@pytest.mark.parametrize("width, entries", [(1, 64), (2, 7), (4, 64), (9, 33)])
def test_slices_give_the_nearest_entry_and_few_candidates(width, entries):
    rng = np.random.default_rng(width)
    for scale in (3, 1000):
        book, x = rng.integers(-scale, scale, (entries, width)), rng.integers(-scale, scale, (3000, width))
        s = V.Slices(book)
        d = ((x[:, None] - book[None])**2).sum(2)
        entry, dist = s.nearest(x)
        assert (entry == d.argmin(1)).all() and (dist == d.min(1)).all()
        box = np.abs(x[:, None] - book[None]).max(2) <= scale // 3
        masks = s.candidates(x, np.full(len(x), scale // 3))
        assert (masks == (box * (np.uint64(1) << np.arange(entries, dtype=np.uint64))).sum(1, dtype=np.uint64)).all()
