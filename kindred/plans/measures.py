"""Queries on taxonomies, benchmark methods, stored results and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from kindred.functions import numbers as N
from kindred.functions import text as X
from kindred.operators import lexical as L
from kindred.operators import metrics as M
from kindred.operators import taxonomy as T
from kindred.plans.domains import rounded
from kindred.sources import tables as D
from kindred.stores import tables as ST
from kindred.stores.lineage import kept
from kindred.streaming import progress as P


def chain(spark, folder):
    return T.chains(D.synsets(spark, folder), D.hypernyms(spark, folder))


def members(spark, folder):
    return D.hypernyms(spark, folder).select(F.col("parent").alias("synset_id"))


def taxonomy_chains(spark, folder):
    return chain(spark, folder)


def taxonomy_depths(spark, folder):
    return T.depths(chain(spark, folder))


def taxonomy_contents(spark, folder):
    return rounded(T.contents(D.synsets(spark, folder), members(spark, folder)), "ic")


def synset_pairs(spark, folder):
    return T.sense_pairs(D.sense_pairs(spark, folder), D.senses(spark, folder))


def taxonomy_ancestors(spark, folder):
    return T.common_ancestors(synset_pairs(spark, folder), chain(spark, folder), D.hypernyms(spark, folder))


def taxonomy_paths(spark, folder):
    return T.shortest_paths(synset_pairs(spark, folder), D.hypernyms(spark, folder))


def scores(spark, folder, pairs=None):
    h = D.hypernyms(spark, folder)
    pairs = synset_pairs(spark, folder) if pairs is None else pairs
    ic = T.contents(D.synsets(spark, folder), members(spark, folder))
    return T.synset_similarities(pairs, kept(chain(spark, folder)), h, ic, T.shortest_paths(pairs, h))


def taxonomy_pairs(spark, folder):
    found = kept(scores(spark, folder))
    terms, senses = D.sense_pairs(spark, folder), D.senses(spark, folder)
    wide = T.term_scores(terms, senses, found, *T.ALGORITHMS)
    return rounded(wide.unpivot(["word1", "word2"], list(T.ALGORITHMS), "algorithm", "score"), "score")


def taxonomy_scores(spark, folder, pairs):
    """`word1, word2, lin, wup` of pairs of suppliers."""
    senses = D.senses(spark, folder)
    found = T.synset_similarities(T.sense_pairs(pairs, senses), kept(chain(spark, folder)), D.hypernyms(spark, folder), T.contents(D.synsets(spark, folder), members(spark, folder)))
    return T.term_scores(pairs, senses, found, "lin", "wup")


def supplier_terms(spark, folder):
    """Suppliers as terms; their region's number is their domain."""
    s, n = D.read(spark, folder, "supplier"), D.read(spark, folder, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("domain"), F.col("s_name").alias("term"))


def taxonomy_domains(spark, folder):
    """Regions by the taxonomy similarities of their suppliers, each with each."""
    ic = kept(T.contents(D.synsets(spark, folder), members(spark, folder)))
    up = kept(chain(spark, folder))
    counts = T.interchangeable(T.domain_synsets(supplier_terms(spark, folder), D.senses(spark, folder)), up, ic)
    pairs = kept(T.domain_synset_pairs(counts))
    found = T.synset_similarities(pairs.select("s1", "s2").distinct(), up, D.hypernyms(spark, folder), ic)
    wide = T.domain_similarities(pairs, found, "lin", *T.AGGREGATIONS)
    return rounded(wide.unpivot(["domain1", "domain2"], list(T.AGGREGATIONS), "aggregation", "score"), "score")


def taxonomy_weights(spark, folder):
    return rounded(T.synset_weights(supplier_terms(spark, folder), D.senses(spark, folder), chain(spark, folder)), "weight")


def taxonomy_centroids(spark, folder):
    weights = T.synset_weights(supplier_terms(spark, folder), D.senses(spark, folder), chain(spark, folder))
    return rounded(L.sparse_cosines(weights.withColumnRenamed("synset_id", "gram")), "score")


def predicted(spark, folder):
    return M.vector_methods(D.vector_pairs(spark, folder), D.vectors(spark, folder))


def benchmark_predictions(spark, folder):
    return rounded(predicted(spark, folder), "score")


def benchmark_results(spark, folder):
    return rounded(M.evaluated(predicted(spark, folder)), "spearman", "pearson", "mse")


def benchmark_missing(spark, folder):
    """Half the words have no vector."""
    half = D.vectors(spark, folder).filter("term % 3 < 2")
    return rounded(M.evaluated(M.vector_methods(D.vector_pairs(spark, folder), half).filter("method = 'sbert'")), "spearman", "pearson", "mse")


def benchmark_constant(spark, folder):
    rows = D.vector_pairs(spark, folder).select(F.lit("constant").alias("method"), "human_score", F.lit(0.5).alias("score"))
    return rounded(M.evaluated(rows), "spearman", "pearson", "mse")


def benchmark_hybrid(spark, folder):
    p = D.vector_pairs(spark, folder)
    sbert = M.vector_methods(p, D.vectors(spark, folder)).filter("method = 'sbert'")
    lin = p.select("word1", "word2", F.when(F.col("word1") % 2 == 0, 0.4).otherwise(0.0).alias("score"))
    return rounded(M.hybrid(sbert, lin), "score")


def benchmark_ensemble(spark, folder):
    s = predicted(spark, folder).select("method", F.col("word1").alias("item"), F.round("score", 9).alias("score"))
    return rounded(M.rank_ensemble(s, {"sbert": 0.5, "sbert_tfidf": 0.2, "sbert_zscore": 0.3}), "score")


def results_matrix(spark, folder):
    m = M.row_means(M.method_matrix(D.results(spark, folder), ["F", "O", "P"]), ["F", "O", "P"])
    return rounded(m.select("method", F.col("F").alias("f_score"), F.col("O").alias("o_score"), F.col("P").alias("p_score"), "mean"), "f_score", "o_score", "p_score", "mean")


def results_averages(spark, folder):
    return rounded(M.method_averages(D.results(spark, folder)), "mean")


def results_best(spark, folder):
    return rounded(M.best_methods(D.results(spark, folder)), "value")


def results_top(spark, folder):
    return rounded(M.top_methods(D.results(spark, folder)).select("dataset", "method", "spearman"), "spearman")


def results_maximum(spark, folder):
    return rounded(M.matrix_maximum(D.results(spark, folder), "spearman"), "max_spearman")


def questions_judged(spark, folder):
    r = D.history(spark, folder).groupBy("dataset", (F.col("id") % 4).alias("k")).agg((F.avg("spearman") / 100).alias("spearman"))
    named = r.select("dataset", "spearman", F.element_at(F.array(*(F.lit(m) for m in ("sbert", "doc2vec", "wordnet_lin", "rag_centroid"))), (F.col("k") + 1).cast("int")).alias("method"))
    return rounded(M.judged_questions(named), "spearman")


def named_results(spark, folder):
    """Events as results of four methods."""
    names = F.array(*(F.lit(m) for m in ("sbert", "doc2vec", "wordnet_lin", "rag_centroid")))
    return D.history(spark, folder).select("dataset", "spearman", F.element_at(names, (F.col("id") % 4 + 1).cast("int")).alias("method"))


def questions_methods(spark, folder):
    """The methods of each question, and how many results each has."""
    counts = named_results(spark, folder).groupBy("method").agg(F.count("*").alias("results"))
    return M.question_methods(spark).join(counts, "method", "left").select("rq", "method", F.coalesce("results", F.lit(0)).alias("results")).orderBy("rq", "method")


def questions_contrasts(spark, folder):
    """The contrasts of two methods by data set: the difference of their mean results."""
    means = kept(named_results(spark, folder).groupBy("dataset", "method").agg(F.avg("spearman").alias("mean")))
    both = M.contrasts_with(spark, "sbert").unionByName(M.contrasts_with(spark, "wordnet_lin")).distinct()
    a = means.select("dataset", F.col("method").alias("method_a"), F.col("mean").alias("_a"))
    b = means.select("dataset", F.col("method").alias("method_b"), F.col("mean").alias("_b"))
    found = both.join(a, "method_a").join(b, ["dataset", "method_b"]).select("rq", "dataset", "method_a", "method_b", (F.col("_a") - F.col("_b")).alias("difference"))
    return rounded(found, "difference")


def history_current(spark, folder):
    return ST.current_results(D.history(spark, folder))


def history_newest(spark, folder):
    return ST.history_of(D.history(spark, folder), 10)


def history_datasets(spark, folder):
    return ST.datasets_by_age(D.history(spark, folder))


def history_json(spark, folder):
    r = rounded(D.results(spark, folder), "spearman").select("dataset", "method", "spearman")
    return ST.parsed_results(ST.results_json(r), "method:string,spearman:double")


def stored(spark, folder):
    """Order statuses of customers as scores of pairs."""
    o = D.read(spark, folder, "orders")
    c = lambda k: F.concat(F.when(F.col("o_orderkey") % 3 == k, "D").otherwise("d"), ((F.col("o_custkey") + k) % 23).cast("string"))
    return o.select(c(0).alias("domain1"), c(1).alias("domain2"), F.when(F.col("o_orderstatus") == "F", "sbert").when(F.col("o_orderstatus") == "O", "tfidf").otherwise("rag").alias("method"), F.lit("cosine").alias("metric"), (F.col("o_totalprice") / 1000000).alias("score"), F.col("o_orderdate").alias("ts"))


def store_newest(spark, folder):
    return rounded(ST.newest_pairs(stored(spark, folder)), "score")


def store_counts(spark, folder):
    return ST.method_counts(ST.newest_pairs(stored(spark, folder)))


def store_probe(spark, folder):
    computed = stored(spark, folder).select("domain1", "domain2").distinct().withColumn("score", F.lit(-1.0))
    return rounded(ST.cached_or(computed, ST.newest_pairs(stored(spark, folder)), "rag", "cosine"), "score")


def store_mirrored(spark, folder):
    return rounded(ST.both_directions(stored(spark, folder).select("domain1", "domain2", "score")), "score")


def store_prefixes(spark, folder):
    keys = D.read(spark, folder, "orders").select(F.concat(F.lower(F.substring("o_orderpriority", 3, 3)), F.lit(":"), F.col("o_orderkey").cast("string")).alias("key"))
    return ST.prefix_counts(keys)


def store_fresh(spark, folder):
    e = D.history(spark, folder)
    return ST.fresh(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 86_400 * 3).select("id", "dataset")


def progress_latest(spark, folder):
    return P.latest(D.progress(spark, folder))


def progress_windows(spark, folder):
    return rounded(P.windowed(D.progress(spark, folder), "1 day"), "progress")


def progress_live(spark, folder):
    """Tasks that are listed when the last event comes: purchases and errors end a task, which stays a week more."""
    return rounded(P.live_at(D.progress(spark, folder), finished=("purchase", "error"), seconds=7 * 86_400), "progress")


def numbers_scaled(spark, folder):
    v = F.col("p_size").cast("double")
    p = D.read(spark, folder, "part")
    return rounded(p.select("p_partkey", N.normalize_to_01(v, -10.0, 40.0).alias("scaled"), N.distance_to_similarity(v, 30.0).alias("similar"), N.from_distance(v).alias("inverse"), N.logistic_score(v / 50).alias("logistic"), N.half_shift(v / 50).alias("shifted"), X.display_name(F.col("p_brand")).alias("name")), "scaled", "similar", "inverse", "logistic", "shifted")


TAX = "h AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'WORLD' FROM region), sy AS (SELECT child AS s FROM h UNION SELECT parent FROM h), ch AS (SELECT s AS synset_id, s AS ancestor, 0 AS steps FROM sy UNION ALL SELECT c.synset_id, h.parent, c.steps + 1 FROM ch c JOIN h ON c.ancestor = h.child), dp AS (SELECT synset_id, max(steps) AS depth FROM ch GROUP BY 1), ic AS (SELECT s AS synset_id, count(h.parent) AS senses, CASE WHEN count(h.parent) = 0 THEN 1 ELSE log2(1 + count(h.parent)) / log2(101) END AS ic FROM sy LEFT JOIN h ON h.parent = s GROUP BY 1), inner_ch AS (SELECT * FROM ch WHERE ancestor IN (SELECT child FROM h))"
SPAIRS = "tp AS (SELECT a.s_name AS word1, b.s_name AS word2, 'S' || a.s_suppkey AS s1, 'S' || b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey + 1, a.s_suppkey + 2)), sp AS (SELECT DISTINCT s1, s2 FROM tp)"
RPAIRS = "st AS (SELECT n_regionkey AS domain, 'S' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey), sp AS (SELECT a.s AS s1, b.s AS s2 FROM st a JOIN st b ON a.domain < b.domain)"
LCS = "lc AS (SELECT p.s1, p.s2, arg_min(x.ancestor, y.steps) AS lcs FROM sp p LEFT JOIN (inner_ch x JOIN inner_ch y ON x.ancestor = y.ancestor AND x.steps >= 1) ON x.synset_id = p.s1 AND y.synset_id = p.s2 GROUP BY ALL)"
PATH = "pa AS (SELECT p.s1, p.s2, min(x.steps + y.steps) AS length FROM sp p JOIN ch x ON x.synset_id = p.s1 JOIN ch y ON y.synset_id = p.s2 AND x.ancestor = y.ancestor GROUP BY ALL)"
SYN = "sc AS (SELECT lc.s1, lc.s2, greatest(least(coalesce(2 * il.ic / (i1.ic + i2.ic), 0), 1), 0) AS lin, coalesce(2.0 * dl.depth / (d1.depth + d2.depth), 0) AS wup, 1 / (1 + pa.length) AS path FROM lc JOIN pa USING (s1, s2) JOIN ic i1 ON i1.synset_id = s1 JOIN ic i2 ON i2.synset_id = s2 JOIN dp d1 ON d1.synset_id = s1 JOIN dp d2 ON d2.synset_id = s2 LEFT JOIN ic il ON il.synset_id = lcs LEFT JOIN dp dl ON dl.synset_id = lcs)"
SW = "st AS (SELECT n_regionkey AS domain, 'S' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey), w0 AS (SELECT domain, ancestor AS synset_id, sum(pow(0.7, steps)) AS w FROM st JOIN ch ON ch.synset_id = st.s GROUP BY ALL), sw AS (SELECT domain, synset_id, w / sum(w) OVER (PARTITION BY domain) AS weight FROM w0)"
VP = "vp AS (SELECT a.vec_id AS word1, b.vec_id AS word2, CASE WHEN a.label = b.label THEN 10.0::DOUBLE ELSE (a.vec_id * 7 % 10)::DOUBLE END AS human_score, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id), cs AS (SELECT word1, word2, human_score, list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) AS c FROM vp), pr AS (SELECT 'sbert' AS method, word1, word2, human_score, (c + 1) / 2 AS score FROM cs UNION ALL SELECT 'sbert_tfidf', word1, word2, human_score, greatest(least(c * 0.5, 1), 0) FROM cs UNION ALL SELECT 'sbert_zscore', word1, word2, human_score, 1 / (1 + exp(-(c - 0.5) / 0.15)) FROM cs)"
EVAL = "rk AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY method ORDER BY human_score) + (count(*) OVER (PARTITION BY method, human_score) - 1) / 2 AS rh FROM pr WHERE score IS NOT NULL), ev AS (SELECT method, round(corr(rs, rh), 6) AS spearman, round(corr(score, human_score), 6) AS pearson, round(avg(pow(score - human_score, 2)), 6) AS mse, count(*) AS predictions_count FROM rk GROUP BY method)"
STORED = "so AS (SELECT (CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'd' END) || (o_custkey % 23) AS domain1, (CASE WHEN o_orderkey % 3 = 1 THEN 'D' ELSE 'd' END) || ((o_custkey + 1) % 23) AS domain2, CASE o_orderstatus WHEN 'F' THEN 'sbert' WHEN 'O' THEN 'tfidf' ELSE 'rag' END AS method, 'cosine' AS metric, o_totalprice / 1000000 AS score, o_orderdate AS ts FROM orders), nw AS (SELECT least(lower(domain1), lower(domain2)) AS a, greatest(lower(domain1), lower(domain2)) AS b, method, metric, max(row(ts, score)) AS m FROM so GROUP BY ALL), np AS (SELECT a, b, method, metric, m[2] AS score, m[1] AS ts FROM nw)"
NAMED = "nr AS (SELECT event_type AS dataset, value AS spearman, ['sbert', 'doc2vec', 'wordnet_lin', 'rag_centroid'][event_id % 4 + 1] AS method FROM events)"

SQL = {
    "taxonomy_chains": f"WITH RECURSIVE {TAX} SELECT * FROM ch",
    "taxonomy_depths": f"WITH RECURSIVE {TAX} SELECT * FROM dp",
    "taxonomy_contents": f"WITH RECURSIVE {TAX} SELECT synset_id, senses, round(ic, 6) AS ic FROM ic",
    "taxonomy_ancestors": f"WITH RECURSIVE {TAX}, {SPAIRS}, {LCS} SELECT * FROM lc",
    "taxonomy_paths": f"WITH RECURSIVE {TAX}, {SPAIRS}, {PATH} SELECT * FROM pa",
    "taxonomy_pairs": f"WITH RECURSIVE {TAX}, {SPAIRS}, {LCS}, {PATH}, {SYN} SELECT word1, word2, 'lin' AS algorithm, round(lin, 6) AS score FROM tp JOIN sc USING (s1, s2) UNION ALL SELECT word1, word2, 'wup', round(wup, 6) FROM tp JOIN sc USING (s1, s2) UNION ALL SELECT word1, word2, 'path', round(path, 6) FROM tp JOIN sc USING (s1, s2)",
    "taxonomy_domains": f"WITH RECURSIVE {TAX}, {RPAIRS}, {LCS}, {PATH}, {SYN}, x AS (SELECT a.domain AS domain1, b.domain AS domain2, lin FROM st a JOIN st b ON a.domain < b.domain JOIN sc ON s1 = a.s AND s2 = b.s) SELECT domain1, domain2, 'max' AS aggregation, round(max(lin), 6) AS score FROM x GROUP BY ALL UNION ALL SELECT domain1, domain2, 'mean', round(avg(lin), 6) FROM x GROUP BY ALL UNION ALL SELECT domain1, domain2, 'min', round(min(lin), 6) FROM x GROUP BY ALL",
    "taxonomy_weights": f"WITH RECURSIVE {TAX}, {SW} SELECT domain, synset_id, round(weight, 6) AS weight FROM sw",
    "taxonomy_centroids": f"WITH RECURSIVE {TAX}, {SW}, nr AS (SELECT domain, sqrt(sum(weight * weight)) AS n FROM sw GROUP BY 1) SELECT a.domain AS domain1, b.domain AS domain2, round(sum(a.weight * b.weight) / (any_value(x.n) * any_value(y.n)), 6) AS score FROM sw a JOIN sw b ON a.synset_id = b.synset_id AND a.domain < b.domain JOIN nr x ON x.domain = a.domain JOIN nr y ON y.domain = b.domain GROUP BY ALL",
    "benchmark_predictions": f"WITH {VP} SELECT method, word1, word2, human_score, round(score, 6) AS score FROM pr",
    "benchmark_results": f"WITH {VP}, {EVAL} SELECT method, spearman, pearson, mse, 0 AS missing, predictions_count FROM ev",
    "benchmark_missing": f"WITH {VP.replace('pr AS (SELECT', 'pr AS (SELECT', 1)}, {EVAL.replace('FROM pr WHERE score IS NOT NULL', 'FROM pr WHERE word1 % 3 < 2 AND word2 % 3 < 2')} SELECT method, spearman, pearson, mse, (SELECT count(*) FROM pr WHERE method = 'sbert') - predictions_count AS missing, predictions_count FROM ev WHERE method = 'sbert'",
    "benchmark_constant": f"WITH {VP} SELECT 'constant' AS method, 0.0 AS spearman, 0.0 AS pearson, 1.0 AS mse, 0 AS missing, count(*) AS predictions_count FROM vp",
    "benchmark_hybrid": f"WITH {VP} SELECT 'hybrid' AS method, word1, word2, human_score, round(CASE WHEN word1 % 2 = 0 THEN (score + 0.4) / 2 ELSE score END, 6) AS score FROM pr WHERE method = 'sbert'",
    "benchmark_ensemble": f"WITH {VP}, rr AS (SELECT method, word1 AS item, round(score, 9) AS s FROM pr), rk AS (SELECT method, item, rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1) / 2 AS r FROM rr), mm AS (SELECT method, item, (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) AS x FROM rk WINDOW w AS (PARTITION BY method)) SELECT item, round(sum(x * CASE method WHEN 'sbert' THEN 0.5 WHEN 'sbert_tfidf' THEN 0.2 ELSE 0.3 END), 6) AS score FROM mm GROUP BY item",
    "results_matrix": "WITH r AS (SELECT o_orderpriority AS method, o_orderstatus AS d, avg(o_totalprice) / 500000 AS s FROM orders GROUP BY ALL), m AS (SELECT method, max(s) FILTER (d = 'F') AS f, max(s) FILTER (d = 'O') AS o, max(s) FILTER (d = 'P') AS p FROM r GROUP BY 1) SELECT method, round(f, 6) AS f_score, round(o, 6) AS o_score, round(p, 6) AS p_score, round((coalesce(f, 0) + coalesce(o, 0) + coalesce(p, 0)) / 3, 6) AS mean FROM m",
    "results_averages": "SELECT method, round(avg(s), 6) AS mean FROM (SELECT o_orderpriority AS method, o_orderstatus, avg(o_totalprice) / 500000 AS s FROM orders GROUP BY ALL) GROUP BY method",
    "results_best": "SELECT dataset, arg_max(method, s) AS method, round(max(s), 6) AS value FROM (SELECT o_orderpriority AS method, o_orderstatus AS dataset, avg(o_totalprice) / 500000 AS s FROM orders GROUP BY ALL) GROUP BY dataset",
    "results_top": "SELECT o_orderstatus AS dataset, o_orderpriority AS method, round(avg(o_totalprice) / 500000, 6) AS spearman FROM orders GROUP BY ALL ORDER BY avg(o_totalprice) DESC, method, dataset LIMIT 3",
    "results_maximum": "SELECT round(max(s), 6) AS max_spearman FROM (SELECT avg(o_totalprice) / 500000 AS s FROM orders GROUP BY o_orderstatus, o_orderpriority)",
    "questions_judged": "WITH r AS (SELECT event_type AS dataset, ['sbert', 'doc2vec', 'wordnet_lin', 'rag_centroid'][event_id % 4 + 1] AS method, avg(value) / 100 AS s FROM events GROUP BY event_type, event_id % 4), c(rq, method, min_spearman) AS (VALUES ('RQ1', 'sbert', 0.5), ('RQ1', 'doc2vec', 0.0), ('RQ2', 'sbert', 0.6), ('RQ2', 'wordnet_lin', 0.2), ('RQ3', 'rag_centroid', 0.5), ('RQ3', 'sbert', 0.5)) SELECT rq, dataset, method, round(s, 6) AS spearman, min_spearman::DOUBLE AS min_spearman, s >= min_spearman AS met FROM r JOIN c USING (method)",
    "questions_methods": f"WITH {NAMED} SELECT rq, v.method, count(nr.method) AS results FROM (VALUES ('RQ1', 'sbert'), ('RQ1', 'doc2vec'), ('RQ2', 'wordnet_lin'), ('RQ2', 'sbert'), ('RQ2', 'tfidf'), ('RQ3', 'sbert'), ('RQ3', 'tfidf'), ('RQ3', 'rag_centroid')) AS v(rq, method) LEFT JOIN nr ON nr.method = v.method GROUP BY ALL",
    "questions_contrasts": f"WITH {NAMED}, m AS (SELECT dataset, method, avg(spearman) AS s FROM nr GROUP BY ALL) SELECT rq, a.dataset, method_a, method_b, round(a.s - b.s, 6) AS difference FROM (VALUES ('RQ1', 'sbert', 'doc2vec'), ('RQ2', 'wordnet_lin', 'sbert'), ('RQ2', 'wordnet_lin', 'tfidf'), ('RQ3', 'sbert', 'rag_centroid')) AS c(rq, method_a, method_b) JOIN m a ON a.method = method_a JOIN m b ON b.method = method_b AND a.dataset = b.dataset",
    "history_current": "SELECT event_type AS dataset, arg_max(event_id, row(ts, event_id)) AS id, arg_max(value, row(ts, event_id)) AS spearman, max(ts) AS ts, min(ts) AS created_at FROM events GROUP BY 1",
    "history_newest": "SELECT * FROM (SELECT event_id AS id, event_type AS dataset, value AS spearman, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10",
    "history_datasets": "SELECT event_type AS dataset, max(ts) AS updated_at FROM events GROUP BY 1",
    "history_json": "SELECT o_orderstatus AS dataset, o_orderpriority AS method, round(avg(o_totalprice) / 500000, 6) AS spearman FROM orders GROUP BY ALL",
    "store_newest": f"WITH {STORED} SELECT a, b, method, metric, round(score, 6) AS score, ts FROM np",
    "store_counts": f"WITH {STORED} SELECT m.method, count(np.method) AS n FROM (VALUES ('sbert'), ('rag'), ('wordnet'), ('bert'), ('tfidf'), ('ensemble')) AS m(method) LEFT JOIN np USING (method) GROUP BY 1",
    "store_probe": f"WITH {STORED} SELECT d.domain1, d.domain2, round(coalesce(np.score, -1), 6) AS score, np.score IS NOT NULL AS hit FROM (SELECT DISTINCT domain1, domain2 FROM so) d LEFT JOIN np ON np.method = 'rag' AND a = least(lower(d.domain1), lower(d.domain2)) AND b = greatest(lower(d.domain1), lower(d.domain2))",
    "store_mirrored": f"WITH {STORED} SELECT domain1, domain2, round(score, 6) AS score FROM so UNION ALL SELECT domain2, domain1, round(score, 6) FROM so",
    "store_prefixes": "SELECT lower(substr(o_orderpriority, 3, 3)) AS prefix, count(*) AS n FROM orders GROUP BY 1",
    "store_fresh": "SELECT event_id AS id, event_type AS dataset FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY",
    "progress_latest": "SELECT user_id AS task_id, max(ts) AS ts, arg_max(event_type, row(ts, event_id)) AS status, arg_max(value, row(ts, event_id)) AS progress, count(*) AS events FROM events GROUP BY 1",
    "progress_windows": "SELECT date_trunc('day', ts) AS begin, event_type AS status, count(*) AS events, round(avg(value), 6) AS progress FROM events GROUP BY ALL",
    "progress_live": "WITH l AS (SELECT user_id AS task_id, max(ts) AS ts, arg_max(event_type, row(ts, event_id)) AS status, arg_max(value, row(ts, event_id)) AS progress FROM events GROUP BY 1) SELECT task_id, ts, status, round(progress, 6) AS progress FROM l WHERE NOT (status IN ('purchase', 'error') AND ts + INTERVAL 7 DAY <= (SELECT max(ts) FROM events))",
    "numbers_scaled": "SELECT p_partkey, round(greatest(least((p_size + 10) / 50, 1), 0), 6) AS scaled, round(greatest(least(1 - p_size / 30, 1), 0), 6) AS similar, round(1 / (1 + p_size), 6) AS inverse, round(1 / (1 + exp(-(p_size / 50 - 0.5) / 0.15)), 6) AS logistic, round((p_size / 50 + 1) / 2, 6) AS shifted, p_brand AS name FROM part",
}
QUERIES = {name: globals()[name] for name in SQL}
