"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns (element math in DOUBLE)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def maxsim(q_tokens, p_tokens) -> Column:
    """Late-interaction score: for every query token the best dot product
    over the passage tokens, summed. Both sides are zipped into the outer
    lambda's input so nothing outside the lambda is re-evaluated per token."""
    q = _c(q_tokens)
    pairs = F.arrays_zip(q.alias("qt"), F.array_repeat(_c(p_tokens), F.size(q)).alias("pm"))
    return _sum(F.transform(pairs, lambda z: F.array_max(F.transform(z["pm"], lambda pt: dot(z["qt"], pt)))))


def mean_vectors(arr_of_vectors) -> Column:
    """Element-wise mean of an ARRAY<ARRAY<...>> (bounded list)."""
    arr = _c(arr_of_vectors)
    first = F.transform(F.element_at(arr, 1), lambda x: x.cast("double") * 0.0)
    total = F.aggregate(arr, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.zip_with(total, F.array_repeat(F.size(arr).cast("double"), F.size(total)), lambda x, n: x / n)


def l2_normalize(a) -> Column:
    v = _c(a)
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)),
                      lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cut_tokens(vec, n_tokens: int) -> Column:
    """ARRAY of length n_tokens*d -> ARRAY<ARRAY> of n_tokens rows of d
    (``vec`` must be a plain column: it is read inside the lambda)."""
    v = _c(vec)
    d = F.size(v) / n_tokens
    return F.transform(F.sequence(F.lit(0), F.lit(n_tokens - 1)),
                       lambda i: F.slice(v, (i * d + 1).cast("int"), d.cast("int")))
