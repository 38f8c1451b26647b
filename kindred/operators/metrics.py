"""Benchmark methods: word pairs to scores, and scores to correlations with human judgements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import numbers as N
from kindred.functions import text as X
from kindred.functions import vectors as V
from kindred.operators.ranks import average_ranks
from kindred.stores.lineage import kept


def with_vectors(pairs: DataFrame, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The pairs (`word1, word2, human_score`, repeated ones too) with both words' vectors, null where a word has none.
    Words meet the vectors in one join, whichever side of a pair they are on."""
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col(vector))).alias("_v"))
    own = pairs.groupBy("word1", "word2", "human_score").agg(F.count("*").alias("_n"))
    pair = F.struct("word1", "word2", "human_score", "_n").alias("_p")
    sides = own.select(pair, F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("word1").alias("term")), F.struct(F.lit(2).alias("k"), F.col("word2").alias("term")))).alias("_s"))
    met = sides.select("_p", "_s.k", "_s.term").join(one, "term", "left")
    both = met.groupBy("_p").agg(*(F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"vector{k}") for k in (1, 2)))
    return both.select("_p.word1", "_p.word2", "_p.human_score", "vector1", "vector2", F.explode(F.array_repeat(F.lit(0), F.col("_p._n").cast("int"))).alias("_0")).drop("_0")


def predictions(rows: DataFrame, method: str, score: Column) -> DataFrame:
    return rows.select(F.lit(method).alias("method"), "word1", "word2", "human_score", score.cast("double").alias("score"))


def predictions_by(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Predictions of several methods from one frame of pairs, in one pass over it."""
    each = F.array(*(F.struct(F.lit(m).alias("method"), c.cast("double").alias("score")) for m, c in scores.items()))
    return rows.select("word1", "word2", "human_score", F.explode(each).alias("_m")).select("_m.method", "word1", "word2", "human_score", "_m.score")


def cosine_of(rows: DataFrame) -> Column:
    """The cosine of `vector1` and `vector2`, null where one is missing."""
    return F.when(F.col("vector1").isNotNull() & F.col("vector2").isNotNull(), V.cosine(F.col("vector1"), F.col("vector2")))


def vector_scores(cosine: Column, weight: Column | None = None) -> dict[str, Column]:
    """The vector methods' scores: the shifted cosine; the cosine weighted by the words' idf (without one half the
    cosine); the logistic curve over the cosine."""
    return {"sbert": N.half_shift(cosine), "sbert_tfidf": N.clip01(cosine * (0.5 + 0.5 * (F.lit(0.0) if weight is None else weight))), "sbert_zscore": N.logistic_score(cosine)}


def idf_weight(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """The rows with `_weight`: the mean of both words' idf, scaled to [0, 1] over all terms; a word without one has the
    least."""
    idf = kept(idf.select("term", "idf"))
    span = idf.agg(F.min("idf").alias("_low"), F.max("idf").alias("_high"))
    for k in ("1", "2"):
        rows = rows.join(idf.select(F.col("term").alias(f"word{k}"), F.col("idf").alias(f"_i{k}")), f"word{k}", "left")
    rows = rows.join(F.broadcast(span))  # of one row
    scaled = [F.coalesce(F.try_divide(F.coalesce(f"_i{k}", "_low") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) for k in ("1", "2")]
    return rows.withColumn("_weight", (scaled[0] + scaled[1]) / 2).drop("_i1", "_i2", "_low", "_high")


def vector_methods(pairs: DataFrame, vectors: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """Predictions of the vector methods, all from one join of pairs and vectors. A word without a vector makes a pair
    missing; without `idf` the idf method takes half the cosine."""
    rows = with_vectors(pairs, vectors)
    rows = rows.select("word1", "word2", "human_score", cosine_of(rows).alias("_cos"))
    if idf is not None:
        rows = idf_weight(rows, idf)
    return predictions_by(rows, vector_scores(F.col("_cos"), None if idf is None else F.col("_weight")))


def hybrid(sbert: DataFrame, lin: DataFrame) -> DataFrame:
    """The mean of the two scores where the taxonomy's is positive, else the vector score."""
    own = sbert.join(lin.select("word1", "word2", F.col("score").alias("_l")), ["word1", "word2"], "left")
    return predictions(own, "hybrid", F.when(F.col("_l") > 0, (F.col("score") + F.col("_l")) / 2).otherwise(F.col("score")))


def evaluated(scores: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """`by..., spearman, pearson, mse, missing, predictions_count` of `score` against `human_score`.

    Null and NaN scores count as missing. Under two predictions, or with a constant side, the three are 0, 0 and 1.
    Ranks share their mean at ties. They are those of the distinct values, by ranges (`ranks.average_ranks`), so that a
    method's rows never meet in one task. The predictions are computed once and kept."""
    by = list(by)
    scores = kept(scores.select(*by, F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")).alias("score"), "human_score"))
    ranked = valid = scores.filter(F.col("score").isNotNull())
    for value, name in (("score", "_rs"), ("human_score", "_rh")):
        ranked = ranked.join(average_ranks(valid, value, *by, name=name), [*by, value])
    found = ranked.groupBy(*by).agg(
        F.count("*").alias("_n"), N.safe_pearson(F.col("_rs"), F.col("_rh")).alias("_spearman"), N.safe_pearson(F.col("score"), F.col("human_score")).alias("_pearson"),
        F.avg(F.pow(F.col("score") - F.col("human_score"), F.lit(2.0))).alias("_mse"), F.stddev_pop("score").alias("_s1"), F.stddev_pop("human_score").alias("_s2"),
    )
    totals = scores.groupBy(*by).agg(F.count_if(F.col("score").isNull()).alias("missing"))
    fine = (F.col("_n") >= 2) & (F.col("_s1") > 0) & (F.col("_s2") > 0)
    return totals.join(found, by, "left").select(
        *by, F.when(fine, F.col("_spearman")).otherwise(0.0).alias("spearman"), F.when(fine, F.col("_pearson")).otherwise(0.0).alias("pearson"),
        F.when(fine, F.col("_mse")).otherwise(1.0).alias("mse"), "missing", F.coalesce("_n", F.lit(0)).alias("predictions_count"),
    )


def rank_ensemble(scores: DataFrame, weights: dict[str, float] | None = None, item: str = "item") -> DataFrame:
    """`item, score` in [0, 1]: each method's scores as average ranks, z-scored, scaled to [0, 1] (0.5 where constant)
    and summed by weight, equal ones by default. `scores` is `method, item, score`.

    Every method must score every item, and weights must be given for each method or for none. The scores are computed
    once and kept; ranks are by ranges, and the least and largest of a method come from one aggregate."""
    scores = kept(scores.select("method", item, "score"))
    counts = {r["method"]: r["n"] for r in scores.groupBy("method").agg(F.countDistinct(item).alias("n")).collect()}  # a row a method
    methods = sorted(counts)
    if weights is not None and set(weights) != set(methods):
        raise ValueError(f"weights are needed for {methods}")
    if not methods:
        return scores.select(item, "score")
    if len(set(counts.values())) > 1:
        raise ValueError("all methods must score the same items")
    whole = sum(weights.values()) if weights else float(len(methods))
    share = F.create_map(*(F.lit(x) for m in methods for x in (m, (weights[m] if weights else 1.0) / whole)))
    ranks = average_ranks(scores, "score", "method", name="_rank")
    span = ranks.groupBy("method").agg(F.min("_rank").alias("_low"), F.max("_rank").alias("_high"))
    scaled = F.coalesce(F.try_divide(F.col("_rank") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.5))
    ranks = ranks.join(F.broadcast(span), "method").select("method", "score", (scaled * share[F.col("method")]).alias("_x"))  # a row a method
    return scores.join(ranks, ["method", "score"]).groupBy(item).agg(F.sum("_x").alias("score"))


def method_matrix(results: DataFrame, datasets: list[str], value: str = "spearman") -> DataFrame:
    """`method` and a column for each data set; null where a method has no result."""
    return results.groupBy("method").pivot("dataset", datasets).agg(F.first(value))


def row_means(matrix: DataFrame, datasets: list[str]) -> DataFrame:
    """The matrix with `mean`, missing values counting as 0."""
    added = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{d}`"), F.lit(0.0)) for d in datasets))
    return matrix.withColumn("mean", added / len(datasets))


def method_averages(results: DataFrame, value: str = "spearman") -> DataFrame:
    return results.groupBy("method").agg(F.avg(value).alias("mean"))


def best_methods(results: DataFrame, value: str = "spearman") -> DataFrame:
    """`dataset, method`: the best of each data set, of equals the first by name."""
    at = F.struct(F.col(value).alias("v"), F.col("method").alias("m"))
    best = results.groupBy("dataset").agg(F.min_by("method", F.struct((-F.col(value)).alias("v"), "method")).alias("method"), F.max(at).alias("_b"))
    return best.select("dataset", "method", F.col("_b.v").alias("value"))


def top_methods(results: DataFrame, n: int = 3, value: str = "spearman") -> DataFrame:
    """The n best results, of equals the first by method and data set."""
    return results.orderBy(F.desc(value), "method", "dataset").limit(n)


def matrix_maximum(results: DataFrame, *values: str) -> DataFrame:
    """One row: the largest of each value over all methods and data sets."""
    return results.agg(*(F.max(v).alias(f"max_{v}") for v in values))


# The research questions' contrasts and success criteria.
CONTRASTS = [("RQ1", "sbert", "doc2vec"), ("RQ2", "wordnet_lin", "sbert"), ("RQ2", "wordnet_lin", "tfidf"), ("RQ3", "sbert", "rag_centroid"), ("RQ3", "tfidf", "rag_centroid")]
CRITERIA = [("RQ1", "sbert", 0.50), ("RQ1", "doc2vec", 0.00), ("RQ2", "sbert", 0.60), ("RQ2", "wordnet_lin", 0.20), ("RQ3", "rag_centroid", 0.50), ("RQ3", "sbert", 0.50)]
# The methods that a suite runs on each data set, and those that the matrix of all data sets shows.
RUSSIAN_METHODS = ("sbert", "sbert_tfidf", "sbert_zscore", "wordnet_lin", "wordnet_wup", "hybrid", "bertopic", "doc2vec", "lda")
ENGLISH_METHODS = ("sbert", "wordnet_lin_en", "wordnet_wup_en", "bertopic", "doc2vec", "lda")
DATASETS = {"hj-rg": RUSSIAN_METHODS, "simlex999_rus": RUSSIAN_METHODS, "simlex999": ENGLISH_METHODS}
MATRIX = {"hj-rg": RUSSIAN_METHODS[:6], "simlex999_rus": RUSSIAN_METHODS[:6], "simlex999": ENGLISH_METHODS[:3]}


def methods_of(dataset: str) -> tuple[str, ...]:
    """The methods of a data set; one that is not known gets the vectors' baseline alone."""
    return DATASETS.get(dataset, ("sbert",))


def contrasts(spark) -> DataFrame:
    return spark.createDataFrame(CONTRASTS, "rq string, method_a string, method_b string")


def criteria(spark) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "rq string, method string, min_spearman double")


def contrasts_with(spark, method: str) -> DataFrame:
    return contrasts(spark).filter((F.col("method_a") == method) | (F.col("method_b") == method))


def question_methods(spark) -> DataFrame:
    """`rq, method`: the distinct methods of each question."""
    c = contrasts(spark)
    return c.select("rq", F.col("method_a").alias("method")).union(c.select("rq", "method_b")).distinct()


def judged_questions(results: DataFrame) -> DataFrame:
    """`rq, dataset, method, spearman, min_spearman, met` for results that a question has a criterion for."""
    return results.join(F.broadcast(criteria(results.sparkSession)), "method").select("rq", "dataset", "method", "spearman", "min_spearman", (F.col("spearman") >= F.col("min_spearman")).alias("met"))


def question_summary(rq: str) -> str:
    """A question's contrasts and criteria as Markdown."""
    pairs = [f"- {a} vs {b}" for q, a, b in CONTRASTS if q == rq]
    goals = [f"- {m}: Spearman >= {v:.2f}" for q, m, v in CRITERIA if q == rq]
    return "\n".join([f"## {rq}", "", "Contrasts:", *pairs, "", "Criteria:", *goals])


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "reduce", "X")]
