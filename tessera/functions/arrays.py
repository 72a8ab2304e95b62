"""Array-valued math over score vectors (logits, probabilities, weights).

Higher-order functions keep the per-row work inside the JVM; every function
here is a Column expression, so it composes into a single projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row: inside a lambda an expression is computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_sum_exp(logits: Column | str) -> Column:
    """ln(sum(exp(x))), shifted by the max for stability."""
    a = _c(logits)
    return let(F.array_max(a), lambda m: m + F.log(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))))


def softmax(logits: Column | str) -> Column:
    """M1: softmax of a score vector (max subtracted first)."""
    a = _c(logits)
    shares = lambda e: let(array_sum(e), lambda total: F.transform(e, lambda x: x / total))
    return let(F.array_max(a), lambda m: let(F.transform(a, lambda x: F.exp(x - m)), shares))


def argmax(scores: Column | str) -> Column:
    """M2: 0-based index of the largest score; ties go to the lowest index."""
    a = _c(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def topk_hit(scores: Column | str, true_idx: Column | str, k: int) -> Column:
    """M7: true class among the k largest scores.

    Ranking of a stable ascending sort read backwards: among equal scores the
    higher index ranks first.  The true class is a hit when fewer than ``k``
    classes rank before it.
    """
    a = _c(scores)
    t = _c(true_idx)
    s_true = F.element_at(a, t + 1)
    ahead = F.filter(a, lambda x, i: (x > s_true) | ((x == s_true) & (i > t)))
    return F.size(ahead) < k


def entropy(weights: Column | str) -> Column:
    """-sum(w ln w), with 0 ln 0 taken as 0."""
    w = _c(weights)
    return -F.aggregate(
        w, F.lit(0.0).cast("double"),
        lambda acc, x: acc + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)),
    )


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))
