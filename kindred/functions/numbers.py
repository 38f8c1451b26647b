"""Scalar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def half_shift(x: Column) -> Column:
    """(x + 1) / 2: a cosine as a score in [0, 1]."""
    return (x + 1) / 2


def logistic_score(x: Column, middle: float = 0.5, spread: float = 0.15) -> Column:
    return 1 / (1 + F.exp(-(x - middle) / spread))


def from_distance(d: Column) -> Column:
    return 1 / (1 + d)


def normalize_to_01(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return clip01((x - low) / (high - low))


def distance_to_similarity(d: Column, most: float = 10.0) -> Column:
    return clip01(1 - d / most)


def information_content(senses: Column) -> Column:
    """log2(1 + senses) / log2(101); no sense counts as one that says everything, 1."""
    return F.when(senses == 0, 1.0).otherwise(F.log2(1 + senses.cast("double")) / F.log2(F.lit(101.0)))


def smooth_idf(documents: Column, containing: Column) -> Column:
    return F.ln((1 + documents) / (1 + containing)) + 1


def normalized_weights(first: float, second: float) -> tuple[float, float]:
    """Two weights scaled to sum 1; halves if they sum to 0."""
    whole = first + second
    return (first / whole, second / whole) if whole else (0.5, 0.5)


def safe_pearson(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; 0 where a side is constant (corr() fails there under ANSI mode)."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def z_score(x: Column, over) -> Column:
    """Population z-score in a window; 0 where it is constant."""
    return F.coalesce(F.try_divide(x - F.avg(x).over(over), F.stddev_pop(x).over(over)), F.lit(0.0))


def min_max(x: Column, over) -> Column:
    """Scaled to [0, 1] in a window; 0.5 where it is constant."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.5)


def average_rank(x, over) -> Column:
    """Rank with ties sharing their mean; `over` is a partitioned window without order, or None for all rows."""
    from pyspark.sql import Window as W

    base = W.partitionBy(*over) if over else W.partitionBy()
    ties = W.partitionBy(*over, x) if over else W.partitionBy(x)
    return F.rank().over(base.orderBy(x)) + (F.count(F.lit(1)).over(ties) - 1) / 2
