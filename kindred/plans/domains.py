"""Queries on domains of vectors: centroids, similarities, graphs, neighbours and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators import centroids as C
from kindred.operators import graph as G
from kindred.operators import knn as K
from kindred.operators import metrics as M
from kindred.operators import similarity as S
from kindred.operators import taxonomy as T
from kindred.sources import tables as D
from kindred.stores.lineage import kept

LONG = "long AS (SELECT vec_id AS term, label AS domain, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
CENT = f"{LONG}, m AS (SELECT domain, i, avg(v) AS c FROM long GROUP BY ALL)"
UNIT = f"{CENT}, u AS (SELECT domain, i, c / sqrt(sum(c * c) OVER (PARTITION BY domain)) AS c FROM m)"
PAIRS = f"{CENT}, p AS (SELECT a.domain AS domain1, b.domain AS domain2, sum(a.c * b.c) AS dot, sqrt(sum(a.c * a.c)) AS na, sqrt(sum(b.c * b.c)) AS nb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dist FROM m a JOIN m b ON a.i = b.i AND a.domain < b.domain GROUP BY ALL)"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def cosine_pairs(spark, folder, metric="cosine"):
    return S.domain_pairs(C.mean_centroids(D.vectors(spark, folder)), metric)


def domain_graph(spark, folder):
    return G.similarity_edges(cosine_pairs(spark, folder), 0.0)


def domain_nodes(spark, folder):
    return G.domain_nodes(D.vectors(spark, folder))


def centroids_mean(spark, folder):
    found = C.described_centroids(D.vectors(spark, folder))
    return rounded(C.as_long(found, "domain", "terms_count", "used_weights"), "value")


def centroids_weighted(spark, folder):
    v = D.vectors(spark, folder).withColumn("w", F.col("term") % 5 + 1)
    return rounded(C.as_long(C.described_centroids(v, weight="w"), "domain", "terms_count", "used_weights"), "value")


def centroids_unit(spark, folder):
    return rounded(C.as_long(C.unit_centroids(D.vectors(spark, folder)), "domain"), "value")


def centroids_batches(spark, folder):
    v = D.vectors(spark, folder).withColumn("batch", F.col("term") % 7)
    return rounded(C.as_long(C.mean_centroids(v, ["batch", "domain"]), "batch", "domain"), "value")


def similarity_cosine(spark, folder):
    return rounded(cosine_pairs(spark, folder), "score")


def similarity_euclidean(spark, folder):
    return rounded(cosine_pairs(spark, folder, "euclidean"), "score")


def similarity_dot(spark, folder):
    return rounded(cosine_pairs(spark, folder, "dot"), "score")


def similarity_matrix(spark, folder):
    v = D.vectors(spark, folder)
    return rounded(S.matrix(cosine_pairs(spark, folder), v.select("domain").distinct()), "score")


def similarity_wide(spark, folder):
    m = similarity_matrix(spark, folder)
    return m.groupBy("d1").pivot("d2", list(range(10))).agg(F.first("score")).select("d1", *(F.col(str(i)).alias(f"d{i}_score") for i in range(10)))


def similarity_top(spark, folder):
    return S.top_pairs(S.above(cosine_pairs(spark, folder), -0.5), 5)


def graph_detailed_nodes(spark, folder):
    return G.detailed(D.vectors(spark, folder), cosine_pairs(spark, folder), 0.0)[0]


def graph_detailed_edges(spark, folder):
    return rounded(G.detailed(D.vectors(spark, folder), cosine_pairs(spark, folder), 0.0)[1], "weight")


def graph_counts(spark, folder):
    return G.counts(*G.detailed(D.vectors(spark, folder), cosine_pairs(spark, folder), 0.0))


def neighbours(vectors, k=5):
    own = K.index(vectors)
    return K.nearest(own, own, k)


def knn(spark, folder):
    return rounded(neighbours(D.vectors(spark, folder)), "score")


def knn_search(spark, folder):
    """Neighbours of the vectors whose id is divisible by 100, among all vectors."""
    own = kept(K.index(D.vectors(spark, folder)))
    return rounded(K.nearest(own, own.filter("term % 100 = 0"), 10), "score")


def rag_domains(spark, folder):
    v = kept(D.vectors(spark, folder))
    return rounded(S.domain_pairs(K.domain_means(v, K.augmented_terms(v, neighbours(v)))), "score")


def graph_rag_domains(spark, folder):
    v = kept(D.vectors(spark, folder))
    return rounded(S.domain_pairs(K.domain_means(v, K.blended_terms(v, neighbours(v), 0.5))), "score")


def rag_pairs(spark, folder):
    v = kept(D.vectors(spark, folder))
    terms = K.blended_terms(v, neighbours(v), 0.5).select("term", F.col("vector").alias("embedding"))
    rows = M.with_vectors(D.vector_pairs(spark, folder), terms).filter("vector1 IS NOT NULL AND vector2 IS NOT NULL")
    return rounded(rows.select("word1", "word2", M.cosine_of(rows).alias("score")), "score")


def rag_status(spark, folder):
    v = D.vectors(spark, folder)
    return K.index_status(K.index(v), v)


def hypernym_terms(spark, folder):
    """Each vector's hypernyms: the ids a tenth and a hundredth of its own."""
    v = D.vectors(spark, folder).select("term")
    up = v.select("term", F.posexplode(F.array(F.floor(F.col("term") / 10), F.floor(F.col("term") / 100))).alias("steps", "hypernym"))
    return up.filter("hypernym > 0").select("term", F.col("hypernym").cast("long").alias("hypernym"), (F.col("steps") + 1).alias("steps"))


def enriched_info(spark, folder):
    found = T.enriched_terms(D.vectors(spark, folder), hypernym_terms(spark, folder))
    return found.select("term", "n_hypernyms", F.round(V.norm(F.col("vector")), 6).alias("length"))


def enriched_domains(spark, folder):
    v = D.vectors(spark, folder)
    terms = T.enriched_terms(v, hypernym_terms(spark, folder))
    return rounded(S.domain_pairs(K.domain_means(v, terms)), "score")


KNN = f"""{LONG}, n AS (SELECT term, domain, i, v / sqrt(sum(v * v) OVER (PARTITION BY term)) AS x FROM long),
l AS (SELECT term, list(x ORDER BY i) AS x FROM n GROUP BY term),
s AS (SELECT a.term AS query, b.term AS neighbour, list_dot_product(a.x, b.x) AS score FROM l a, l b),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, neighbour) AS pos FROM s),
k AS (SELECT query, neighbour, score, row_number() OVER (PARTITION BY query ORDER BY pos) AS place FROM r WHERE pos <= 6 AND neighbour <> query),
kn AS (SELECT * FROM k WHERE place <= 5)"""
DOMAIN_OF_TERMS = """dm AS (SELECT domain, i, avg(v) AS c FROM tv GROUP BY ALL), du AS (SELECT domain, i, c / sqrt(sum(c * c) OVER (PARTITION BY domain)) AS c FROM dm)
SELECT a.domain AS domain1, b.domain AS domain2, round(sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 6) AS score FROM du a JOIN du b ON a.i = b.i AND a.domain < b.domain GROUP BY ALL"""
HYP = "h0 AS (SELECT vec_id AS term, vec_id // 10 AS hypernym, 1 AS steps FROM embeddings UNION ALL SELECT vec_id, vec_id // 100, 2 FROM embeddings), h AS (SELECT h0.* FROM h0 JOIN embeddings e ON h0.hypernym = e.vec_id WHERE hypernym > 0)"
ENRICHED = f"{LONG}, {HYP}, hm AS (SELECT h.term, long.i, avg(long.v) AS v, count(DISTINCT h.steps) AS n FROM h JOIN long ON h.hypernym = long.term GROUP BY ALL), e0 AS (SELECT long.term, long.domain, long.i, hm.n, CASE WHEN hm.v IS NULL THEN long.v ELSE 0.7 * long.v + 0.3 * hm.v END AS v FROM long LEFT JOIN hm USING (term, i)), tv AS (SELECT term, domain, i, n, CASE WHEN n IS NULL THEN v ELSE v / sqrt(sum(v * v) OVER (PARTITION BY term)) END AS v FROM e0)"
SCORE = "CASE WHEN na * nb = 0 THEN 0 ELSE dot / (na * nb) END"

SQL = {
    "domain_graph": f"WITH {PAIRS} SELECT domain1::VARCHAR AS source, domain2::VARCHAR AS target, round({SCORE}, 4) AS weight, 'similarity' AS type FROM p WHERE {SCORE} >= 0",
    "domain_nodes": "SELECT DISTINCT label::VARCHAR AS id, label::VARCHAR AS label, 'domain' AS type, NULL::VARCHAR AS parent FROM embeddings",
    "centroids_mean": f"WITH {CENT}, t AS (SELECT label AS domain, count(*) AS terms_count FROM embeddings GROUP BY 1) SELECT domain, terms_count, false AS used_weights, i, round(c, 6) AS value FROM m JOIN t USING (domain)",
    "centroids_weighted": f"WITH {LONG}, t AS (SELECT label AS domain, count(*) AS terms_count FROM embeddings GROUP BY 1) SELECT domain, terms_count, true AS used_weights, i, round(sum(v * (term % 5 + 1)) / sum(term % 5 + 1), 6) AS value FROM long JOIN t USING (domain) GROUP BY ALL",
    "centroids_unit": f"WITH {UNIT} SELECT domain, i, round(c, 6) AS value FROM u",
    "centroids_batches": f"WITH {LONG} SELECT term % 7 AS batch, domain, i, round(avg(v), 6) AS value FROM long GROUP BY ALL",
    "similarity_cosine": f"WITH {PAIRS} SELECT domain1, domain2, round({SCORE}, 6) AS score FROM p",
    "similarity_euclidean": f"WITH {PAIRS} SELECT domain1, domain2, round(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE 1 / (1 + dist) END, 6) AS score FROM p",
    "similarity_dot": f"WITH {PAIRS} SELECT domain1, domain2, round(dot, 6) AS score FROM p",
    "similarity_matrix": f"WITH {PAIRS}, s AS (SELECT domain1 AS d1, domain2 AS d2, round({SCORE}, 6) AS score FROM p) SELECT * FROM s UNION ALL SELECT d2, d1, score FROM s UNION ALL SELECT DISTINCT label, label, 1.0 FROM embeddings",
    "similarity_wide": f"WITH {PAIRS}, s AS (SELECT domain1 AS d1, domain2 AS d2, round({SCORE}, 6) AS score FROM p), a AS (SELECT * FROM s UNION ALL SELECT d2, d1, score FROM s UNION ALL SELECT DISTINCT label, label, 1.0 FROM embeddings) SELECT d1, " + ", ".join(f"max(score) FILTER (d2 = {i}) AS d{i}_score" for i in range(10)) + " FROM a GROUP BY d1",
    "similarity_top": f"WITH {PAIRS} SELECT domain1, domain2, round({SCORE}, 4) AS score FROM p WHERE {SCORE} >= -0.5 ORDER BY 3 DESC, 1, 2 LIMIT 5",
    "graph_detailed_nodes": "SELECT DISTINCT label::VARCHAR AS id, label::VARCHAR AS label, 'domain' AS type, NULL::VARCHAR AS parent FROM embeddings UNION ALL SELECT label::VARCHAR || '_term_' || (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::VARCHAR, vec_id::VARCHAR, 'term', label::VARCHAR FROM embeddings",
    "graph_detailed_edges": f"WITH {PAIRS} SELECT domain1::VARCHAR AS source, domain2::VARCHAR AS target, round({SCORE}, 6) AS weight, 'similarity' AS type FROM p WHERE {SCORE} >= 0 UNION ALL SELECT label::VARCHAR || '_term_' || (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::VARCHAR, label::VARCHAR, 1.0, 'belongs_to' FROM embeddings",
    "graph_counts": f"WITH {PAIRS} SELECT (SELECT count(DISTINCT label) FROM embeddings) AS domains, (SELECT count(*) FROM embeddings) AS terms, (SELECT count(*) FROM p WHERE {SCORE} >= 0) AS similarity_edges",
    "knn": f"WITH {KNN} SELECT query, neighbour, round(score, 6) AS score, place FROM kn",
    "knn_search": f"WITH {KNN.replace('FROM l a, l b', 'FROM l a, l b WHERE a.term % 100 = 0').replace('pos <= 6', 'pos <= 11').replace('place <= 5', 'place <= 10')} SELECT query, neighbour, round(score, 6) AS score, place FROM kn",
    "rag_domains": f"WITH {KNN}, g AS (SELECT query AS term, neighbour AS other FROM kn UNION ALL SELECT DISTINCT query, query FROM kn), gm AS (SELECT g.term, o.i, avg(o.v) AS v FROM g JOIN long o ON g.other = o.term GROUP BY ALL), tv AS (SELECT gm.term, l.domain, gm.i, gm.v / sqrt(sum(gm.v * gm.v) OVER (PARTITION BY gm.term)) AS v FROM gm JOIN long l ON gm.term = l.term AND gm.i = l.i), {DOMAIN_OF_TERMS}",
    "graph_rag_domains": f"WITH {KNN}, gm AS (SELECT k.query AS term, o.i, avg(o.v) AS v FROM kn k JOIN long o ON k.neighbour = o.term GROUP BY ALL), tv AS (SELECT l.term, l.domain, l.i, 0.5 * l.v + 0.5 * gm.v AS v FROM long l JOIN gm ON l.term = gm.term AND l.i = gm.i), {DOMAIN_OF_TERMS}",
    "rag_pairs": f"WITH {KNN}, gm AS (SELECT k.query AS term, o.i, avg(o.v) AS v FROM kn k JOIN long o ON k.neighbour = o.term GROUP BY ALL), tv AS (SELECT l.term, l.i, 0.5 * l.v + 0.5 * gm.v AS v FROM long l JOIN gm ON l.term = gm.term AND l.i = gm.i) SELECT a.term AS word1, b.term AS word2, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS score FROM tv a JOIN tv b ON a.term + 1 = b.term AND a.i = b.i GROUP BY ALL",
    "rag_status": "SELECT count(DISTINCT vec_id) AS terms_count, count(DISTINCT label) AS domains_count FROM embeddings",
    "enriched_info": f"WITH {ENRICHED} SELECT term, coalesce(max(n), 0) AS n_hypernyms, round(sqrt(sum(v * v)), 6) AS length FROM tv GROUP BY term",
    "enriched_domains": f"WITH {ENRICHED}, {DOMAIN_OF_TERMS}",
}
QUERIES = {name: globals()[name] for name in SQL}
