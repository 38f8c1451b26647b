"""Similarities of domains. Terms are aggregated to domains first; pairs are formed of centroids only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.functions.numbers import normalized_weights
from kindred.stores.lineage import kept


def domain_pairs(centroids: DataFrame, metric: str = "cosine", by: str = "domain", vector: str = "centroid") -> DataFrame:
    """`domain1, domain2, score` for domain1 < domain2: each unordered pair once.

    This is a product of domains by its nature: D domains have D (D - 1) / 2 pairs. It holds aggregates only, which are
    computed once and kept."""
    score = V.metric(metric)
    centroids = kept(centroids.select(by, vector))
    a = centroids.select(F.col(by).alias("domain1"), F.col(vector).alias("_a"))
    b = centroids.select(F.col(by).alias("domain2"), F.col(vector).alias("_b"))
    return a.join(b, F.col("domain1") < F.col("domain2")).select("domain1", "domain2", score(F.col("_a"), F.col("_b")).alias("score"))


def matrix(pairs: DataFrame, domains: DataFrame, by: str = "domain") -> DataFrame:
    """`d1, d2, score`: both directions of each pair, and 1 on the diagonal."""
    there = pairs.select(F.col("domain1").alias("d1"), F.col("domain2").alias("d2"), "score")
    back = pairs.select(F.col("domain2").alias("d1"), F.col("domain1").alias("d2"), "score")
    same = domains.select(F.col(by).alias("d1"), F.col(by).alias("d2"), F.lit(1.0).alias("score"))
    return there.unionByName(back).unionByName(same)


def above(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose unrounded score reaches the threshold, with the score rounded to four places."""
    return pairs.filter(F.col("score") >= threshold).withColumn("score", F.round("score", 4))


def top_pairs(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs by score, highest first, then by names; the first n of them."""
    ordered = pairs.orderBy(F.desc("score"), *[c for c in pairs.columns if c != "score"])
    return ordered if n is None else ordered.limit(n)


def ensemble(vector_pairs: DataFrame, gram_pairs: DataFrame, first: float, second: float) -> DataFrame:
    """`domain1, domain2, sbert_score, tfidf_score, similarity`: the weighted sum of two scores. The parts are rounded
    to four places, the sum is not; weights are scaled to sum 1."""
    first, second = normalized_weights(first, second)
    both = vector_pairs.withColumnRenamed("score", "_v").join(gram_pairs.withColumnRenamed("score", "_g"), ["domain1", "domain2"])
    return both.select("domain1", "domain2", F.round("_v", 4).alias("sbert_score"), F.round("_g", 4).alias("tfidf_score"), (F.col("_v") * first + F.col("_g") * second).alias("similarity"))


def ensemble_centroids(a: DataFrame, b: DataFrame, first: float, second: float, by: str = "domain") -> DataFrame:
    """Blends of two centroids of one length; the first alone where lengths differ or the second is missing."""
    first, _ = normalized_weights(first, second)
    joined = a.select(by, F.col("centroid").alias("_a")).join(b.select(by, F.col("centroid").alias("_b")), by, "left")
    return joined.select(by, F.when(F.size("_a") == F.size("_b"), V.blend(F.col("_a"), F.col("_b"), first)).otherwise(F.col("_a")).alias("centroid"))
