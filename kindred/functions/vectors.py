"""Vector algebra over ARRAY<DOUBLE> columns, for vectors that are already aggregated (a few numbers a row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays. The length is computed once, not for each number."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance); 1 for two zero vectors, 0 for one."""
    na, nb = norm(a), norm(b)
    distance = F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(1 / (1 + distance))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b."""
    return F.zip_with(a, b, lambda x, y: x * F.lit(alpha) + y * F.lit(1 - alpha))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors; null for an empty one."""
    n = F.size(vectors)
    added = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.try_element_at(vectors, F.lit(1)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(n > 0, F.transform(added, lambda x: x / n))


METRICS = {"cosine": cosine, "euclidean": euclidean_similarity, "dot": dot}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; use one of {sorted(METRICS)}")
    return METRICS[name]
