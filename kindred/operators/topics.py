"""Topic methods on Spark ML and paragraph vectors. Seeded; their values are approximations, not fixed results."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import numbers as N
from kindred.functions import text as X
from kindred.functions import vectors as V
from kindred.operators.centroids import mean_centroids
from kindred.operators.metrics import cosine_of, predictions, with_vectors
from kindred.operators.paragraphs import Training, paragraph_vectors
from kindred.stores.lineage import kept


def words_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("word1").alias("term")).union(pairs.select(F.col("word2").alias("term"))).distinct()


def missing(pairs: DataFrame, method: str) -> DataFrame:
    return predictions(pairs, method, F.lit(None).cast("double"))


def clustered(pairs: DataFrame, vectors: DataFrame, seed: int = 42) -> DataFrame:
    """Pairs of one cluster of unit vectors score 0.9, others the shifted cosine of their clusters' means. Under five
    words all are missing."""
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col("embedding"))).alias("embedding"))
    own = kept(words_of(pairs).join(one, "term").withColumn("embedding", V.unit(F.col("embedding"))))
    n = own.count()
    if n < 5:
        return missing(pairs, "bertopic")
    model = KMeans(k=min(10, max(3, n // 5)), seed=seed, featuresCol="features", predictionCol="topic").fit(own.withColumn("features", array_to_vector("embedding")))
    topics = kept(model.transform(own.withColumn("features", array_to_vector("embedding"))).select("term", "topic", "embedding"))
    centres = mean_centroids(topics, "topic")
    placed = topics.select("term", "topic").join(centres, "topic")
    out = pairs
    for k in ("1", "2"):
        out = out.join(placed.select(F.col("term").alias(f"word{k}"), F.col("topic").alias(f"t{k}"), F.col("centroid").alias(f"c{k}")), f"word{k}", "left")
    score = F.when(F.col("t1").isNull() | F.col("t2").isNull(), None).when(F.col("t1") == F.col("t2"), 0.9).otherwise(N.half_shift(V.cosine(F.col("c1"), F.col("c2"))))
    return predictions(out, "bertopic", score)


def document_vectors(pairs: DataFrame, corpus: DataFrame | None = None, size: int = 100, seed: int = 42) -> DataFrame:
    """Shifted cosines of the terms' paragraph vectors, trained on the terms and the corpus; under three terms missing."""
    own = words_of(pairs)
    texts = own if corpus is None else own.unionByName(corpus.select("term")).distinct()
    if texts.limit(3).count() < 3:
        return missing(pairs, "doc2vec")
    found = paragraph_vectors(texts.select("term", X.document_tokens(F.col("term")).alias("tokens")), Training(size=size, seed=seed))
    return predictions(*scored(pairs, found, "doc2vec"))


def scored(pairs: DataFrame, vectors: DataFrame, method: str):
    """The pairs with their vectors, the method, and the shifted cosine."""
    rows = with_vectors(pairs, vectors)
    return rows, method, N.half_shift(cosine_of(rows))


def topic_mixtures(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Shifted cosines of the terms' topic mixtures; a mixture of next to no mass is missing."""
    own = kept(words_of(pairs).select("term", X.topic_tokens(F.col("term")).alias("tokens")))
    n = own.count()
    if n < 3:
        return missing(pairs, "lda")
    counted = kept(CountVectorizer(inputCol="tokens", outputCol="features").fit(own).transform(own))
    model = LDA(k=min(10, max(2, n // 3)), seed=seed, maxIter=10).fit(counted)
    dealt = counted.repartition(-(-n // Training.part))  # few bytes and much work, in as many tasks as the texts are worth
    mixed = model.transform(dealt).select("term", vector_to_array("topicDistribution").alias("embedding"))
    mixed = mixed.withColumn("embedding", F.when(V.total(F.col("embedding")) >= 0.1, F.col("embedding")))
    return predictions(*scored(pairs, mixed, "lda"))
