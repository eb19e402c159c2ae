"""Logit-array expressions (L1 and the per-position parts of L2-L9).

Dense per-position logits stay arrays and are processed with higher-order
functions, so nothing multiplies rows by the vocabulary size.  Softmax is
max-shifted; sums are left folds in index order.

Row-level reductions (max, sum) are bound once with :func:`let` before the
element-wise lambda uses them; written inline, Catalyst would re-evaluate the
reduction for every element (O(V^2) per position).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scaled(arr, temperature: float = 1.0) -> Column:
    """logits / T as doubles (float32 inputs are widened exactly)."""
    t = float(temperature)
    return F.transform(_col(arr), lambda x: x.cast("double") / F.lit(t))


def array_sum(arr) -> Column:
    return F.aggregate(_col(arr), F.lit(0.0), lambda acc, x: acc + x)


def _lsm(z: Column, m: Column) -> Column:
    """log softmax of z given its max m: ``(v - m) - ln(sum exp(v - m))``."""
    return let(F.log(array_sum(F.transform(z, lambda v: F.exp(v - m)))),
               lambda lse: F.transform(z, lambda v: (v - m) - lse))


def _sm(z: Column, m: Column) -> Column:
    """softmax of z given its max m: ``exp(v - m) / sum``."""
    return let(F.transform(z, lambda v: F.exp(v - m)),
               lambda e: let(array_sum(e), lambda s: F.transform(e, lambda v: v / s)))


def log_softmax(arr, temperature: float = 1.0) -> Column:
    """L1: log_softmax(logits / T)."""
    return let(scaled(arr, temperature), lambda z: let(F.array_max(z), lambda m: _lsm(z, m)))


def softmax(arr, temperature: float = 1.0) -> Column:
    """L1: softmax(logits / T)."""
    return let(scaled(arr, temperature), lambda z: let(F.array_max(z), lambda m: _sm(z, m)))


def softmax_pair(arr, temperature: float = 1.0) -> Column:
    """``struct(p, logp)`` of logits / T, sharing the max and the scaled array."""
    return let(scaled(arr, temperature), lambda z: let(
        F.array_max(z), lambda m: F.struct(_sm(z, m).alias("p"), _lsm(z, m).alias("logp"))))


def kl_terms(p, logp, logq) -> Column:
    """Sum over the vocabulary of ``p * (log p - log q)`` for one position."""
    diff = F.zip_with(_col(logp), _col(logq), lambda a, b: a - b)
    return array_sum(F.zip_with(_col(p), diff, lambda a, b: a * b))


def kl_position(teacher, student, temperature: float) -> Column:
    """KL(softmax(t/T) || softmax(s/T)) at one position (no T^2 factor)."""
    return let(softmax_pair(teacher, temperature), lambda tp: let(
        log_softmax(student, temperature), lambda lq: kl_terms(tp["p"], tp["logp"], lq)))


def pick(arr, index) -> Column:
    """0-based element access; null when out of range."""
    i = index if isinstance(index, Column) else F.lit(index)
    return F.try_element_at(_col(arr), i + 1)


def gather(arr, indices) -> Column:
    """``arr[indices]`` (0-based) with ``arr`` evaluated once."""
    return let(_col(arr), lambda a: F.transform(_col(indices), lambda i: F.try_element_at(a, i + 1)))


def top_k(arr, k: int) -> Column:
    """W4 per position: the k largest logits, value descending, ties by index.

    Returns ``array<struct<value:double, index:int>>``.  Null and NaN logits
    come last.  The vocabulary is never sorted: it is cut into about
    ``sqrt(V k)`` stretches, and the k-th largest of their maxima is a threshold
    that at least k logits reach.  Logits above it lie in fewer than k
    stretches, so no more than about ``sqrt(V k)`` of them, and the first k equal
    to it, are sorted; all else is a few passes over the array."""
    lowest = F.lit(float("-inf"))

    def keyed(v: Column) -> Column:
        """The values negated, null and NaN as infinity, with their places."""
        return F.transform(v, lambda x, i: F.struct((-F.coalesce(F.nanvl(x.cast("double"), lowest), lowest)).alias("neg"), i.alias("index")))

    def selected(e: Column) -> Column:
        width = F.floor(F.sqrt(F.size(e).cast("double") / F.lit(float(k)))).cast("int")
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / width).cast("int")),
                           lambda j: F.array_min(F.slice(e, j * width + 1, width))["neg"])
        return let(F.element_at(F.sort_array(tops), k), lambda t: F.concat(
            F.filter(e, lambda s: s["neg"] < t), F.slice(F.filter(e, lambda s: s["neg"] == t), 1, k)))

    # beyond 4 k logits there are more than k stretches, of two logits or more
    best = let(keyed(_col(arr)), lambda e: F.when(F.size(e) <= 4 * k, e).otherwise(selected(e)))
    original = lambda s: F.element_at(_col(arr), s["index"] + 1).cast("double")
    return F.transform(F.slice(F.sort_array(best), 1, k), lambda s: F.struct(
        F.when(s["neg"] == float("inf"), original(s)).otherwise(-s["neg"]).alias("value"), s["index"].alias("index")))
