"""Exact nearest neighbours by inner product of unit vectors, and centroids augmented with neighbours.

Queries and corpus meet on a grid (`grid.best`): a cell's corpus streams past its queries in Arrow batches, each a matrix
product, and only the running best of each query are kept; the answers of a row's cells are then merged. The work is
|queries| x |corpus| by its nature. No task holds more than a row's queries and one batch, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators import grid
from kindred.operators.centroids import long_vectors, mean_centroids
from kindred.stores.lineage import kept

#: Queries of a grid row, corpus vectors that meet them at a time, and corpus vectors of a column. A task holds scores of a
#: row by a batch, a few times over, and a worker process keeps what it grew to: 4,096 by 512 doubles are 17 MB.
ROW, BATCH, COLUMN = 4_096, 512, 100_000


def index(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """`term, vector`: unit vectors of the distinct terms. Save it (`stores.indexes`) to use it often."""
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col(vector))).alias("vector"))
    return one.withColumn("vector", V.unit(F.col("vector")))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, block: int = ROW, column: int = COLUMN) -> DataFrame:
    """`query, neighbour, score, place`: of each query's k + 1 best in the corpus those with another id, k at most.

    `corpus` and `queries` are `term, vector` frames of unit vectors, a row for each term; ties go in order of id. Fewer
    rows come back where the corpus is smaller. block: queries of a grid row; column: corpus vectors of a column."""
    same = queries is corpus
    corpus = kept(corpus.select("term", "vector"))
    queries = corpus if same else kept(queries.select("term", "vector"))
    return grid.best(queries, corpus, k, lambda rows: grid.matrix(rows.column("vector")), lambda own, rows: own @ grid.matrix(rows.column("vector")).T, block, column, BATCH)


def neighbour_means(neighbours: DataFrame, vectors: DataFrame, vector: str = "embedding", with_self: bool = False) -> DataFrame:
    """`term, mean`: the mean of each query's neighbours' vectors, and of its own if `with_self`."""
    own = F.when(F.col("place") == 1, F.array("neighbour", "query")).otherwise(F.array("neighbour"))  # the query once
    links = neighbours.select(F.col("query").alias("owner"), F.explode(own if with_self else F.array("neighbour")).alias("term"))
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col(vector))).alias("embedding"))
    return mean_centroids(links.join(one, "term"), "owner").select(F.col("owner").alias("term"), F.col("centroid").alias("mean"))


def augmented_terms(vectors: DataFrame, neighbours: DataFrame, vector: str = "embedding") -> DataFrame:
    """`term, vector`: the unit mean of a term and its neighbours; the plain vector for a term without any."""
    vectors = kept(vectors)
    means = neighbour_means(neighbours, vectors, vector, with_self=True)
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col(vector))).alias("_own"))
    return one.join(means, "term", "left").select("term", F.coalesce(V.unit(F.col("mean")), F.col("_own")).alias("vector"))


def blended_terms(vectors: DataFrame, neighbours: DataFrame, alpha: float = 0.5, vector: str = "embedding") -> DataFrame:
    """`term, vector`: alpha times the term's vector plus 1 - alpha times its neighbours' mean; the plain vector for a
    term without neighbours."""
    means = neighbour_means(neighbours, vectors, vector)
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col(vector))).alias("_own"))
    return one.join(means, "term", "left").select("term", F.when(F.col("mean").isNull(), F.col("_own")).otherwise(V.blend(F.col("_own"), F.col("mean"), alpha)).alias("vector"))


def domain_means(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """`domain, centroid`: the unit mean of the domain's term vectors (`vectors` is `term, vector`)."""
    joined = terms.select("domain", "term").join(vectors, "term")
    return mean_centroids(joined, "domain", "vector").withColumn("centroid", V.unit(F.col("centroid")))


def index_status(index_: DataFrame, terms: DataFrame) -> DataFrame:
    """`terms_count, domains_count` of an index and the terms it was built for."""
    return index_.agg(F.count("*").alias("terms_count")).join(terms.agg(F.countDistinct("domain").alias("domains_count")))  # of one row each


__all__ = ["augmented_terms", "blended_terms", "domain_means", "index", "index_status", "long_vectors", "nearest", "neighbour_means"]
