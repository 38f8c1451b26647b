"""Whole suites: a data set's methods, graphs by method, embeddings from a provider, and runs with stored results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import DEFAULT_WEIGHTS, GRAPH_WEIGHTS
from kindred.functions import numbers as N
from kindred.operators import centroids as C
from kindred.operators import graph as G
from kindred.operators import knn as K
from kindred.operators import lexical as L
from kindred.operators import metrics as M
from kindred.operators import similarity as S
from kindred.operators import topics as TP
from kindred.stores.lineage import kept

def mean_pooled(tokens: DataFrame, by: str = "term", vector: str = "embedding", mask: str = "mask") -> DataFrame:
    """A text's vector from its tokens' vectors, tokens with mask 0 left out."""
    return C.mean_centroids(tokens.filter(F.col(mask) > 0), by, vector).withColumnRenamed("centroid", "embedding")


def cls_pooled(tokens: DataFrame, by: str = "term", vector: str = "embedding", at: str = "position") -> DataFrame:
    """A text's vector is that of its first token."""
    return tokens.groupBy(by).agg(F.min_by(vector, at).alias("embedding"))


#: Methods that come from a seeded model; the others come from one pass over the pairs.
SEEDED = ("bertopic", "doc2vec", "lda")
TAXONOMY = {"wordnet_lin": "lin", "wordnet_wup": "wup", "wordnet_lin_en": "lin", "wordnet_wup_en": "wup"}


def predictions_of(methods: tuple[str, ...], pairs: DataFrame, vectors: DataFrame, taxonomy: DataFrame | None = None, idf: DataFrame | None = None) -> DataFrame:
    """`method, word1, word2, human_score, score` of several methods. Those without a model of their own share one join of
    the pairs with `vectors` and one with `taxonomy`, and a pair's scores come as one array.

    `taxonomy` is `word1, word2, lin, wup`; a pair that it lacks scores 0. Without one its methods are missing everywhere
    and `hybrid` is the vector score."""
    if unknown := sorted(set(methods) - {"sbert", "sbert_tfidf", "sbert_zscore", "hybrid", *TAXONOMY, *SEEDED}):
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    pairs, frames = pairs.select("word1", "word2", "human_score"), []
    if plain := [m for m in methods if m not in SEEDED]:
        rows = M.with_vectors(pairs, vectors)
        rows = rows.select("word1", "word2", "human_score", M.cosine_of(rows).alias("_cos"))
        if idf is not None:
            rows = M.idf_weight(rows, idf)
        measures = {k: F.lit(None).cast("double") for k in ("lin", "wup")}
        if taxonomy is not None:
            rows = rows.join(taxonomy.select("word1", "word2", F.col("lin").alias("_lin"), F.col("wup").alias("_wup")), ["word1", "word2"], "left")
            measures = {k: F.coalesce(f"_{k}", F.lit(0.0)) for k in measures}
        scores = M.vector_scores(F.col("_cos"), None if idf is None else F.col("_weight"))
        scores |= {m: measures[k] for m, k in TAXONOMY.items()}
        scores["hybrid"] = F.when(measures["lin"] > 0, (scores["sbert"] + measures["lin"]) / 2).otherwise(scores["sbert"])
        frames.append(M.predictions_by(rows, {m: scores[m] for m in plain}))
    models = {"bertopic": lambda: TP.clustered(pairs, vectors), "doc2vec": lambda: TP.document_vectors(pairs), "lda": lambda: TP.topic_mixtures(pairs)}
    return reduce(DataFrame.unionByName, frames + [models[m]() for m in methods if m in SEEDED])


def run_suite(dataset: str, pairs: DataFrame, vectors: DataFrame, taxonomy: DataFrame | None = None, methods: tuple[str, ...] | None = None, seeded: bool = True) -> DataFrame:
    """`dataset, method, spearman, pearson, mse, missing, predictions_count` of a data set's methods, or of those given;
    without those of seeded models, if not `seeded`."""
    chosen = [m for m in methods or M.methods_of(dataset) if seeded or m not in SEEDED]
    return M.evaluated(predictions_of(tuple(chosen), pairs, vectors, taxonomy)).select(F.lit(dataset).alias("dataset"), "*")


def run_suites(datasets: dict[str, DataFrame], vectors: DataFrame, taxonomy: DataFrame | None = None, seeded: bool = True) -> DataFrame:
    """The suites of several data sets in one frame. Vectors and taxonomy are computed once for all of them."""
    vectors, taxonomy = kept(vectors), taxonomy if taxonomy is None else kept(taxonomy)
    return reduce(DataFrame.unionByName, (run_suite(name, pairs, vectors, taxonomy, seeded=seeded) for name, pairs in sorted(datasets.items())))


# The states that a job goes through, and how far it is in each.
STATES = ((0, "Loading dataset"), (20, "Running experiments"), (90, "Formatting results"), (100, "Completed"))
JOB_SCHEMA = "task_id string, dataset string, step int, progress int, status string, error string, ts timestamp"


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """`task_id, dataset, step, progress, status, error, ts`: the last state of each job stored under `path`."""
    rows = spark.read.schema(JOB_SCHEMA).parquet(f"{path}/jobs")
    return rows.groupBy("task_id").agg(F.max_by(F.struct("dataset", "step", "progress", "status", "error", "ts"), F.struct("step", "ts")).alias("_s")).select("task_id", "_s.*")


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """What the jobs under `path` stored: `task_id, dataset, method, spearman, ..., execution_time_sec, created_at`."""
    return spark.read.parquet(f"{path}/results")


def run_job(path: str, dataset: str, load: Callable[[], DataFrame], vectors: DataFrame, task_id: str | None = None, **options) -> str:
    """Run a suite as a job and return its `task_id`. Its states are appended under `path`, as is its result, which is
    seen once it is whole. `load` gives the pairs. A job that fails ends in the state `Failed` with the error's text and
    stores no result; the job, not its caller, has failed, so nothing is raised."""
    spark, task_id, began, at = vectors.sparkSession, task_id or uuid.uuid4().hex, time.time(), 0

    def tell(step: int, progress: int, status: str, error: str | None = None) -> None:
        row = spark.createDataFrame([(task_id, dataset, step, progress, status, error)], "task_id string, dataset string, step int, progress int, status string, error string")
        row.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/jobs")

    try:
        tell(0, *STATES[0])
        pairs = kept(load())
        at = 1
        tell(1, *STATES[1])
        found = kept(run_suite(dataset, pairs, vectors, **options))
        at = 2
        tell(2, *STATES[2])
        stamped = found.select(F.lit(task_id).alias("task_id"), "*", F.lit(time.time() - began).alias("execution_time_sec"), F.current_timestamp().alias("created_at"))
        stamped.coalesce(1).write.mode("append").parquet(f"{path}/results")  # a row a method
        tell(3, *STATES[3])
    except Exception as error:  # whatever ends the job is its result
        tell(len(STATES), STATES[at][0], "Failed", str(error).splitlines()[0] if str(error) else type(error).__name__)
    return task_id


def suite_matrix(results: DataFrame, value: str = "spearman") -> DataFrame:
    """`method, dataset, value` over the matrix's methods of each data set, null where there is no result; methods without
    any result are left out. The baseline comes once for the Russian data sets and once for the English one."""
    known = results.sparkSession.createDataFrame([(d, m) for d, ms in M.MATRIX.items() for m in ms], "dataset string, method string")
    known = known.join(results.select("method").distinct(), "method", "left_semi")
    return known.join(results.select("dataset", "method", F.col(value).alias("value")), ["dataset", "method"], "left")


GRAPH_METHODS = ("sbert", "rag", "bert", "wordnet", "tfidf", "ensemble")


def pairs_by_method(method: str, vectors: DataFrame, metric: str = "cosine", k: int = 5, weights: tuple[float, float] = GRAPH_WEIGHTS, taxonomy_weights: DataFrame | None = None) -> DataFrame:
    """`domain1, domain2, score` of all domain pairs under a graph method. tfidf and ensemble have their own scores and
    take no metric; `wordnet` compares `taxonomy_weights` (domain, synset_id, weight)."""
    if method in ("sbert", "bert"):
        return S.domain_pairs(C.mean_centroids(vectors), metric)
    if method == "rag":
        own = K.index(vectors)
        return S.domain_pairs(K.domain_means(vectors, K.blended_terms(vectors, K.nearest(own, own, k))), metric)
    terms = vectors.select(F.col("term").cast("string").alias("term"), "domain")
    if method == "wordnet":
        if taxonomy_weights is None:
            raise ValueError("the wordnet method needs taxonomy_weights")
        return L.sparse_cosines(taxonomy_weights.withColumnRenamed("synset_id", "gram"))
    if method == "tfidf":
        return L.ngram_similarity(terms)
    if method == "ensemble":
        found = S.ensemble(S.domain_pairs(C.mean_centroids(vectors), "dot"), L.ngram_similarity(terms), *weights)
        return found.select("domain1", "domain2", F.col("similarity").alias("score"))
    raise ValueError(f"unknown method {method!r}; use one of {GRAPH_METHODS}")


def graph_by_method(method: str, vectors: DataFrame, threshold: float = 0.5, show_terms: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph under a method."""
    return G.detailed(vectors, pairs_by_method(method, vectors, **options), threshold, show_terms)


def pair_similarity(vectors: DataFrame, a, b, metric: str = "cosine") -> float:
    """The similarity of two domains."""
    own = vectors.filter(F.col("domain").isin(a, b))
    row = S.domain_pairs(C.mean_centroids(own), metric).first()
    if row is None:
        raise ValueError(f"two known domains are needed, not {a!r} and {b!r}")
    return row["score"]


def domain_ensemble(vectors: DataFrame, weights: tuple[float, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """`domain1, domain2, sbert_score, tfidf_score, similarity`: dot products of unit means and n-gram similarities of the
    domains' terms, by weights scaled to sum 1."""
    terms = vectors.select(F.col("term").cast("string").alias("term"), "domain")
    return S.ensemble(unit_pairs(vectors), L.ngram_similarity(terms), *N.normalized_weights(*weights))


def unit_pairs(vectors: DataFrame) -> DataFrame:
    """Dot products of unit means, the vector part of the ensemble of two domains."""
    return S.domain_pairs(C.unit_centroids(vectors), "dot")


def dataset_status(results: DataFrame) -> DataFrame:
    """`dataset, methods, done`: how many of each data set's methods have results."""
    return suite_matrix(results).groupBy("dataset").agg(F.count("*").alias("methods"), F.count("value").alias("done"))
