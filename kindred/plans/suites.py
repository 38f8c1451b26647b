"""Queries on whole suites and graphs by method."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import knn as K
from kindred.operators import metrics as M
from kindred.operators import suite as SU
from kindred.operators import topics as TP
from kindred.plans.domains import KNN, LONG, PAIRS, SCORE, rounded
from kindred.plans.measures import EVAL, LCS, PATH, SYN, TAX, VP, taxonomy_scores
from kindred.sources import loaders
from kindred.sources import tables as D
from kindred.stores import embeddings as EM
from kindred.stores import indexes as IX
from kindred.stores.lineage import checkpoint_folder, kept


def own_folder(spark, name):
    """A new folder of this run, where all executors reach it."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def graph_by_method(spark, folder):
    """Edges of the graph under three methods."""
    v, out = D.vectors(spark, folder), None
    for method in ("sbert", "tfidf", "ensemble"):
        edges = SU.graph_by_method(method, v, 0.1, show_terms=False)[1].withColumn("method", F.lit(method))
        out = edges if out is None else out.unionByName(edges)
    return rounded(out, "weight")


def ensemble_units(spark, folder):
    return rounded(SU.unit_pairs(D.vectors(spark, folder)), "score")


def ensemble_domains(spark, folder):
    return rounded(SU.domain_ensemble(D.vectors(spark, folder)), "similarity")


def embedded_terms(spark, folder):
    """Names encoded by their length and first letter, in batches."""
    encoders = EM.Encoders("letters")
    encoders.register("letters", lambda: letters)
    found = encoders.encode(D.terms(spark, folder).select("term").distinct())
    return found.select("term", F.col("embedding")[0].cast("int").alias("size"), F.col("embedding")[1].cast("int").alias("first"))


def pooled_vectors(spark, folder):
    """Vectors with odd ids masked out, pooled by domain."""
    v = D.vectors(spark, folder).withColumn("mask", F.when(F.col("term") % 2 == 0, 1).otherwise(0))
    return rounded(SU.mean_pooled(v, "domain").select("domain", F.posexplode("embedding").alias("i", "value")), "value")


def pooled_first(spark, folder):
    """Each domain's first vector, as the first token's stands for a text."""
    v = D.vectors(spark, folder).withColumn("position", F.col("term"))
    return rounded(SU.cls_pooled(v, "domain").select("domain", F.posexplode("embedding").alias("i", "value")), "value")


def benchmark_idf(spark, folder):
    """The vector methods with idf: of a vector's domain among all vectors; those of domain 3 have none."""
    v = kept(D.vectors(spark, folder))
    size, df = v.agg(F.count("*").alias("_n")), v.groupBy("domain").agg(F.count("*").alias("_c"))
    idf = v.filter("domain <> 3").join(df, "domain").join(F.broadcast(size)).select("term", F.ln(F.col("_n") / F.col("_c")).alias("idf"))  # of one row
    found = M.vector_methods(D.vector_pairs(spark, folder), v, idf).filter("method = 'sbert_tfidf'")
    return rounded(found, "score")


def benchmark_matrix(spark, folder):
    """The matrix of every data set's methods, filled from events."""
    e = D.history(spark, folder).groupBy((F.col("id") % 3).alias("d"), (F.col("id") % 5).alias("m")).agg((F.avg("spearman") / 100).alias("spearman"))
    name = lambda words, key: F.element_at(F.array(*(F.lit(w) for w in words)), (F.col(key) + 1).cast("int"))
    results = e.select(name(("hj-rg", "simlex999_rus", "simlex999"), "d").alias("dataset"), name(("sbert", "wordnet_lin", "hybrid", "lda", "wordnet_lin_en"), "m").alias("method"), "spearman")
    return rounded(SU.suite_matrix(results), "value")


def suite_parts(spark, folder):
    """Pairs of suppliers, their vectors and their taxonomy."""
    pairs = kept(D.supplier_pairs(spark, folder, 1, 2, 5))
    return pairs, D.supplier_vectors(spark, folder), kept(taxonomy_scores(spark, folder, pairs))


def suite_rounded(found):
    return rounded(found, "spearman", "pearson", "mse")


def suite_russian(spark, folder):
    """The suite of a Russian data set, without its seeded methods."""
    pairs, vectors, taxonomy = suite_parts(spark, folder)
    return suite_rounded(SU.run_suite("hj-rg", pairs, vectors, taxonomy, seeded=False))


def suite_english(spark, folder):
    pairs, vectors, taxonomy = suite_parts(spark, folder)
    return suite_rounded(SU.run_suite("simlex999", pairs, vectors, taxonomy, seeded=False))


def suite_all(spark, folder):
    """Three data sets at once, one of them not known."""
    pairs, vectors, taxonomy = suite_parts(spark, folder)
    return suite_rounded(SU.run_suites({"hj-rg": pairs, "simlex999": pairs.filter("human_score > 0"), "other": pairs.filter("human_score < 10")}, vectors, taxonomy, seeded=False))


def suite_without_taxonomy(spark, folder):
    """Taxonomy methods without a taxonomy are missing everywhere, and the hybrid is the vector score."""
    pairs, vectors, _ = suite_parts(spark, folder)
    return suite_rounded(SU.run_suite("hj-rg", pairs, vectors, seeded=False))


def suite_whole(spark, folder):
    """All nine methods of a Russian data set."""
    pairs, vectors, taxonomy = suite_parts(spark, folder)
    return SU.run_suite("hj-rg", pairs, vectors, taxonomy)


def suite_jobs(spark, folder):
    """Suites run as jobs: what they stored, with the state each job ended in. The last one's pairs have no score, so it fails."""
    pairs, vectors, taxonomy = suite_parts(spark, folder)
    path = own_folder(spark, "jobs")
    for name, load in (("hj-rg", lambda: pairs), ("simlex999", lambda: pairs), ("unscored", lambda: loaders.with_human_score(pairs.drop("human_score")))):
        SU.run_job(path, name, load, vectors, task_id=f"job-{name}", taxonomy=taxonomy, seeded=False)
    states = SU.job_states(spark, path).select("task_id", "dataset", "progress", "status")
    return suite_rounded(kept(states.join(SU.stored_runs(spark, path).drop("dataset", "execution_time_sec", "created_at"), "task_id", "left")))


def index_stored(spark, folder):
    """Neighbours from an index that was stored, found by its key and read again."""
    v, path = kept(D.vectors(spark, folder)), own_folder(spark, "indexes")
    first = IX.index_for(v, path, "vectors", "none", K.index, "m1")
    again = IX.index_for(v, path, "vectors", "none", lambda _: first.limit(0), "m1")  # not built again
    return rounded(K.nearest(again, again, 5), "score")


def index_registry(spark, folder):
    """The records of three indexes: two versions under one key, and one of other terms."""
    v, path = kept(D.vectors(spark, folder)), own_folder(spark, "indexes")
    half = v.filter("term % 2 = 0")
    for rows in (v, v, half):
        IX.save_index(K.index(rows), path, IX.index_key("vectors", "none", rows), "vectors", "none", "m1")
    return kept(IX.registry(spark, path).select("dataset", "language", "model", "version", "terms_count", "dimension"))


def letters(texts):
    return [[float(len(t)), float(ord(t[0]))] for t in texts]


def embedded_cached(spark, folder):
    """Names encoded in two runs, the first with those of even length, then by another encoder and by the first again: how
    many each run had to encode."""
    terms, path, encoders = kept(D.terms(spark, folder).select("term").distinct()), own_folder(spark, "embeddings"), EM.Encoders("letters", "letters")
    encoders.register("letters", lambda: letters)
    encoders.register("twice", lambda: lambda texts: [[2 * x for x in v] for v in letters(texts)])
    rows = []
    for step, (model, own) in enumerate((("letters", terms.filter(F.length("term") % 2 == 0)), ("letters", terms), ("twice", terms), ("missing", terms))):
        switched = encoders.switch(model)
        found, n = EM.embedded(own, encoders, path)
        rows.append(found.agg(F.lit(step).alias("step"), F.lit(encoders.current).alias("model"), F.lit(switched).alias("switched"), F.lit(n).alias("encoded"), F.count("embedding").alias("terms"), F.sum(F.col("embedding")[0]).alias("total")))
    return kept(reduce(DataFrame.unionByName, rows))


def topics_clustered(spark, folder):
    return M.evaluated(TP.clustered(D.vector_pairs(spark, folder), D.vectors(spark, folder)))


def topics_documents(spark, folder):
    p = D.vector_pairs(spark, folder).withColumns({w: F.concat(F.lit("t"), F.col(w).cast("string")) for w in ("word1", "word2")})
    return M.evaluated(TP.document_vectors(p))


def topics_mixtures(spark, folder):
    p = D.vector_pairs(spark, folder).withColumns({w: F.concat(F.lit("t"), F.col(w).cast("string")) for w in ("word1", "word2")})
    return M.evaluated(TP.topic_mixtures(p))


GRAMS = "tg AS (SELECT vec_id::VARCHAR AS term, label AS domain FROM embeddings), gp AS (SELECT DISTINCT domain, term, substr(term, i, n) AS gram FROM (SELECT domain, term, n, unnest(generate_series(1, length(term) - n + 1)) AS i FROM tg, (VALUES (2), (3)) AS g(n) WHERE length(term) >= n)), gz AS (SELECT domain, count(*) AS n FROM tg GROUP BY 1), gw AS (SELECT domain, gram, count(*) / any_value(gz.n) AS w FROM gp JOIN gz USING (domain) GROUP BY domain, gram), gn AS (SELECT domain, sqrt(sum(w * w)) AS n FROM gw GROUP BY 1), gd AS (SELECT a.domain AS domain1, b.domain AS domain2, sum(a.w * b.w) AS d FROM gw a JOIN gw b ON a.gram = b.gram AND a.domain < b.domain GROUP BY ALL), gs AS (SELECT x.domain AS domain1, y.domain AS domain2, coalesce(d, 0) / (x.n * y.n) AS score FROM gn x JOIN gn y ON x.domain < y.domain LEFT JOIN gd ON gd.domain1 = x.domain AND gd.domain2 = y.domain)"
EDGE = "domain1::VARCHAR AS source, domain2::VARCHAR AS target"
RU = "('sbert'), ('sbert_tfidf'), ('sbert_zscore'), ('wordnet_lin'), ('wordnet_wup'), ('hybrid')"

SUITE = f"""{TAX}, tp AS (SELECT a.s_name AS word1, b.s_name AS word2, 'S' || a.s_suppkey AS s1, 'S' || b.s_suppkey AS s2, CASE WHEN a.s_nationkey = b.s_nationkey THEN 10.0 WHEN x.n_regionkey = y.n_regionkey THEN 6.0 ELSE a.s_suppkey * 7 % 5 END::DOUBLE AS human_score, e.embedding::DOUBLE[] AS v, f.embedding::DOUBLE[] AS w
  FROM supplier a JOIN supplier b ON b.s_suppkey - a.s_suppkey IN (1, 2, 5) JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey LEFT JOIN embeddings e ON e.vec_id = a.s_suppkey LEFT JOIN embeddings f ON f.vec_id = b.s_suppkey),
sp AS (SELECT DISTINCT s1, s2 FROM tp), {LCS}, {PATH}, {SYN},
cs AS (SELECT word1, word2, human_score, lin, wup, list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)) AS c FROM tp JOIN sc USING (s1, s2)),
al AS (SELECT word1, word2, human_score, unnest([{{'m': 'sbert', 's': (c + 1) / 2}}, {{'m': 'sbert_tfidf', 's': greatest(least(c * 0.5, 1), 0)}}, {{'m': 'sbert_zscore', 's': 1 / (1 + exp(-(c - 0.5) / 0.15))}}, {{'m': 'wordnet_lin', 's': lin}}, {{'m': 'wordnet_wup', 's': wup}}, {{'m': 'hybrid', 's': CASE WHEN lin > 0 THEN ((c + 1) / 2 + lin) / 2 ELSE (c + 1) / 2 END}}]) AS e FROM cs)"""
STATS = "spearman, pearson, mse, predictions_count"
#: A data set's methods by its rows, as `pr`, with what is missing; English names differ.
def suite_sql(dataset: str, methods: str, where: str = "true", name: str = "e.m") -> str:
    own = f"WITH pr AS (SELECT {name} AS method, word1, word2, human_score, e.s AS score FROM al WHERE e.m IN ({methods}) AND {where}), {EVAL}"
    totals = "(SELECT method, count(*) FILTER (score IS NULL) AS missing FROM pr GROUP BY 1)"
    fine = "e.predictions_count >= 2 AND e.spearman IS NOT NULL AND NOT isnan(e.spearman)"
    return f"SELECT * FROM ({own} SELECT '{dataset}' AS dataset, t.method, CASE WHEN {fine} THEN e.spearman ELSE 0 END AS spearman, CASE WHEN {fine} THEN e.pearson ELSE 0 END AS pearson, CASE WHEN {fine} THEN e.mse ELSE 1 END AS mse, t.missing, coalesce(e.predictions_count, 0) AS predictions_count FROM {totals} t LEFT JOIN ev e USING (method))"


SIX, THREE = "'sbert', 'sbert_tfidf', 'sbert_zscore', 'wordnet_lin', 'wordnet_wup', 'hybrid'", "'sbert', 'wordnet_lin', 'wordnet_wup'"
ENGLISH = "CASE WHEN e.m LIKE 'wordnet%' THEN e.m || '_en' ELSE e.m END"

SQL = {
    "suite_russian": f"WITH RECURSIVE {SUITE} {suite_sql('hj-rg', SIX)}",
    "suite_english": f"WITH RECURSIVE {SUITE} {suite_sql('simlex999', THREE, name=ENGLISH)}",
    "suite_all": f"WITH RECURSIVE {SUITE} {suite_sql('hj-rg', SIX)} UNION ALL {suite_sql('simlex999', THREE, 'human_score > 0', ENGLISH)} UNION ALL {suite_sql('other', SIX[:7], 'human_score < 10')}",
    "suite_without_taxonomy": f"WITH RECURSIVE {SUITE} SELECT * FROM ({suite_sql('hj-rg', SIX[:40])}) UNION ALL SELECT dataset, 'hybrid', spearman, pearson, mse, missing, predictions_count FROM ({suite_sql('hj-rg', SIX[:7])}) UNION ALL SELECT 'hj-rg', m, 0, 0, 1, (SELECT count(*) FROM tp), 0 FROM (VALUES ('wordnet_lin'), ('wordnet_wup')) AS v(m)",
    "suite_jobs": f"WITH RECURSIVE {SUITE} SELECT 'job-' || dataset AS task_id, dataset, 100 AS progress, 'Completed' AS status, method, spearman, pearson, mse, missing, predictions_count FROM ({suite_sql('hj-rg', SIX)} UNION ALL {suite_sql('simlex999', THREE, name=ENGLISH)}) UNION ALL SELECT 'job-unscored', 'unscored', 0, 'Failed', NULL, NULL, NULL, NULL, NULL, NULL",
    "index_stored": f"WITH {KNN} SELECT query, neighbour, round(score, 6) AS score, place FROM kn",
    "index_registry": "SELECT 'vectors' AS dataset, 'none' AS language, 'm1' AS model, v AS version, count(*) AS terms_count, any_value(len(embedding)) AS dimension FROM embeddings, (VALUES (1), (2)) AS t(v) GROUP BY v UNION ALL SELECT 'vectors', 'none', 'm1', 1, count(*), any_value(len(embedding)) FROM embeddings WHERE vec_id % 2 = 0",
    "embedded_cached": "WITH t AS (SELECT DISTINCT p_name AS t FROM part), k(step, model, switched) AS (VALUES (0, 'letters', true), (1, 'letters', true), (2, 'twice', true), (3, 'twice', false)) SELECT step, model, switched, CASE step WHEN 0 THEN count(*) FILTER (length(t) % 2 = 0) WHEN 1 THEN count(*) FILTER (length(t) % 2 = 1) WHEN 2 THEN count(*) ELSE 0 END AS encoded, CASE step WHEN 0 THEN count(*) FILTER (length(t) % 2 = 0) ELSE count(*) END AS terms, CASE step WHEN 0 THEN sum(length(t)) FILTER (length(t) % 2 = 0) WHEN 1 THEN sum(length(t)) ELSE 2 * sum(length(t)) END::DOUBLE AS total FROM t, k GROUP BY step, model, switched",
    "graph_by_method": f"WITH {PAIRS}, {GRAMS} SELECT {EDGE}, round({SCORE}, 6) AS weight, 'similarity' AS type, 'sbert' AS method FROM p WHERE {SCORE} >= 0.1 UNION ALL SELECT {EDGE}, round(score, 6), 'similarity', 'tfidf' FROM gs WHERE score >= 0.1 UNION ALL SELECT {EDGE}, round(dot * 0.7 + score * 0.3, 6), 'similarity', 'ensemble' FROM p JOIN gs USING (domain1, domain2) WHERE dot * 0.7 + score * 0.3 >= 0.1",
    "ensemble_units": f"WITH {PAIRS} SELECT domain1, domain2, round(dot / (na * nb), 6) AS score FROM p",
    "ensemble_domains": f"WITH {PAIRS}, {GRAMS} SELECT domain1, domain2, round(dot / (na * nb), 4) AS sbert_score, round(score, 4) AS tfidf_score, round(dot / (na * nb) * 0.8334 + score * 0.1666, 6) AS similarity FROM p JOIN gs USING (domain1, domain2)",
    "embedded_terms": "SELECT DISTINCT p_name AS term, length(p_name) AS size, ascii(p_name) AS first FROM part",
    "pooled_vectors": f"WITH {LONG} SELECT domain, i, round(avg(v), 6) AS value FROM long WHERE term % 2 = 0 GROUP BY ALL",
    "pooled_first": f"WITH {LONG} SELECT domain, i, round(v, 6) AS value FROM long WHERE term IN (SELECT min(vec_id) FROM embeddings GROUP BY label)",
    "benchmark_idf": f"WITH {VP}, c AS (SELECT label, ln((SELECT count(*) FROM embeddings) / count(*)) AS x FROM embeddings GROUP BY 1), i AS (SELECT vec_id, CASE WHEN label <> 3 THEN x END AS x FROM embeddings JOIN c USING (label)), s AS (SELECT vec_id, coalesce((x - (SELECT min(x) FROM i)) / nullif((SELECT max(x) - min(x) FROM i), 0), 0) AS w FROM i) SELECT 'sbert_tfidf' AS method, word1, word2, human_score, round(greatest(least(c * (0.5 + 0.5 * (a.w + b.w) / 2), 1), 0), 6) AS score FROM cs JOIN s a ON a.vec_id = word1 JOIN s b ON b.vec_id = word2",
    "benchmark_matrix": f"WITH k AS (SELECT 'hj-rg' AS dataset, m AS method FROM (VALUES {RU}) AS t(m) UNION ALL SELECT 'simlex999_rus', m FROM (VALUES {RU}) AS t(m) UNION ALL SELECT 'simlex999', m FROM (VALUES ('sbert'), ('wordnet_lin_en'), ('wordnet_wup_en')) AS t(m)), r AS (SELECT ['hj-rg', 'simlex999_rus', 'simlex999'][event_id % 3 + 1] AS dataset, ['sbert', 'wordnet_lin', 'hybrid', 'lda', 'wordnet_lin_en'][event_id % 5 + 1] AS method, avg(value) / 100 AS s FROM events GROUP BY event_id % 3, event_id % 5) SELECT dataset, method, round(s, 6) AS value FROM k LEFT JOIN r USING (dataset, method) WHERE method IN (SELECT method FROM r)",
}
#: Seeded methods of Spark ML have no SQL.
QUERIES = {name: globals()[name] for name in (*SQL, "suite_whole", "topics_clustered", "topics_documents", "topics_mixtures")}
