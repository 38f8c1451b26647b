"""Centroids: means of term vectors for each group.

Vectors are averaged in long form (group, place, value), so each map task combines its own rows first, a group's rows
never meet in one task, and a hot group costs as little as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V


def long_vectors(vectors: DataFrame, by: list[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    own = vectors.select(*by, (weight if weight is not None else F.lit(1.0)).alias("_w"), F.posexplode(V.as_doubles(F.col(vector))).alias("_i", "_v"))
    return own


def gathered(long: DataFrame, by: list[str], value: Column, name: str = "centroid") -> DataFrame:
    """One vector for each group from rows of `_i` and a value; as many numbers a group as the vectors have."""
    pairs = F.sort_array(F.collect_list(F.struct("_i", value.alias("_m"))))
    return long.groupBy(*by).agg(F.transform(pairs, lambda p: p["_m"]).alias(name))


def mean_centroids(vectors: DataFrame, by: str | list[str] = "domain", vector: str = "embedding") -> DataFrame:
    """`by..., centroid`: plain means. Repeated terms weigh as often as they come; groups without vectors are absent."""
    by = [by] if isinstance(by, str) else by
    means = long_vectors(vectors, by, vector).groupBy(*by, "_i").agg(F.avg("_v").alias("_m"))
    return gathered(means, by, F.col("_m"))


def weighted_centroids(vectors: DataFrame, weight: str, by: str | list[str] = "domain", vector: str = "embedding") -> DataFrame:
    """Means weighted by a column. A group whose weights sum to 0 is an error (division by zero)."""
    by = [by] if isinstance(by, str) else by
    sums = long_vectors(vectors, by, vector, F.col(weight).cast("double")).groupBy(*by, "_i").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return gathered(sums, by, F.col("_m"))


def unit_centroids(vectors: DataFrame, by: str | list[str] = "domain", vector: str = "embedding") -> DataFrame:
    """Means scaled to length 1; a zero mean stays."""
    return mean_centroids(vectors, by, vector).withColumn("centroid", V.unit(F.col("centroid")))


def described_centroids(vectors: DataFrame, by: str = "domain", vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """Centroids with `terms_count` and `used_weights`."""
    found = weighted_centroids(vectors, weight, by, vector) if weight else mean_centroids(vectors, by, vector)
    counts = vectors.groupBy(by).agg(F.count("*").alias("terms_count"))
    return found.join(counts, by).withColumn("used_weights", F.lit(weight is not None))


def as_long(centroids: DataFrame, *by: str, vector: str = "centroid") -> DataFrame:
    """`by..., i, value`: a vector column in long form."""
    return centroids.select(*by, F.posexplode(vector).alias("i", "value"))
