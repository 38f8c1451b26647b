"""Queries on harvested records, corpora, filters, graphs by all methods, levels of stored values and the whole state."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import centroids as C
from kindred.operators import graph as G
from kindred.operators import harvest as H
from kindred.operators import knn as K
from kindred.operators import lexical as L
from kindred.operators import similarity as S
from kindred.operators import suite as SU
from kindred.operators import taxonomy as T
from kindred.plans.domains import DOMAIN_OF_TERMS, ENRICHED, KNN, LONG, PAIRS, SCORE, hypernym_terms, rounded
from kindred.plans.measures import SW, TAX, chain, stored, supplier_terms
from kindred.plans.suites import GRAMS, own_folder
from kindred.sources import loaders
from kindred.sources import tables as D
from kindred.stores import tables as ST
from kindred.stores.levels import DAY, TwoLevels, pair_name
from kindred.stores.lineage import kept
from kindred.streaming import progress as P


def terms_auxiliary(spark, folder):
    """The corpus for document vectors: names of parts, suppliers (as a first column) and regions."""
    parts = D.read(spark, folder, "part").select("p_size", F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("term"))
    suppliers = D.read(spark, folder, "supplier").select("s_name", "s_suppkey")
    letters = D.read(spark, folder, "orders").select(F.substring("o_orderstatus", 1, 1).alias("term"))
    return loaders.auxiliary_terms(parts, suppliers, D.read(spark, folder, "region").select("r_name"), letters)


def feed(spark, folder):
    """Documents as entries of a feed."""
    d = D.read(spark, folder, "documents")
    return d.select(
        F.concat(F.lit("http://feed/abs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("summary"),
        F.array("lang", "source").alias("tags"), F.array("source").alias("authors"), F.lit("2024-01-01").alias("published"), "lang",
    )


def articles(spark, folder):
    found = loaders.article_records(feed(spark, folder))
    return found.select("id", "title", F.sha2("abstract", 256).alias("abstract_sha256"), F.array_join("categories", ",").alias("categories"), F.array_join("authors", ",").alias("authors"), "published")


def articles_documents(spark, folder):
    records = loaders.article_records(feed(spark, folder))
    docs = loaders.article_documents(records, F.coalesce(F.col("categories")[0], F.lit("none")))
    return docs.select("doc_id", "domain", F.sha2("text", 256).alias("text_sha256"))


def harvest_related(spark, folder):
    """Pages with the first twenty of their links and bare categories: a document's words are its links, each third one
    in a namespace."""
    d = D.read(spark, folder, "documents").filter("text IS NOT NULL")
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    pages = d.select(F.col("doc_id").alias("page"), F.transform(words, lambda w, i: F.when(i % 3 == 2, F.concat(F.lit("Talk:"), w)).otherwise(w)).alias("links"), F.array(F.concat(F.lit("Category:"), F.coalesce("lang", F.lit("none"))), F.col("source")).alias("categories"))
    found = H.related_terms(pages)
    return found.select("page", F.array_join("related_terms", " ").alias("related"), F.array_join("categories", ",").alias("categories"))


def harvest_unvisited(spark, folder):
    """Orders' customers that no earlier harvest has seen: it saw those of urgent orders."""
    o = D.read(spark, folder, "orders").select(F.col("o_custkey").alias("page"), "o_orderpriority")
    found = o.select("page").distinct()
    return H.unvisited(found, o.filter(F.col("o_orderpriority").startswith("1")))


def idf_filtered(spark, folder):
    """Words of part names by their idf among the names; a word that is not known counts as 0."""
    names = D.terms(spark, folder).select(F.col("term").alias("name")).distinct()
    words = names.select("name", F.explode(F.split("name", " ")).alias("term")).distinct()
    size, df = names.agg(F.count("*").alias("_n")), words.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.filter("term < 'r'").join(F.broadcast(size)).select("term", F.ln(F.col("_n") / F.col("df")).alias("idf"))  # of one row
    return L.filtered_by_idf(words.select("term").distinct(), idf, 0.5)


def terms_languages(spark, folder):
    """Whether one of the first five words of a language's documents, by name, is Cyrillic, and how many are of all."""
    tokens = D.documents(spark, folder).select("domain", F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    five = kept(tokens).groupBy("domain").agg(F.slice(F.sort_array(F.collect_set(F.substring("term", 1, 3))), 1, 5).alias("first"), F.count_if(X.has_cyrillic(F.col("term"))).alias("cyrillic"))
    return five.select("domain", X.is_cyrillic(F.col("first")).alias("is_cyrillic"), "cyrillic")


def synset_names(spark, folder):
    """Short names of part names written as synsets."""
    p = D.read(spark, folder, "part")
    return p.select("p_partkey", X.short_name(F.concat(F.translate("p_name", " ", "_"), F.lit(".n."), F.col("p_size").cast("string"))).alias("name"))


def centroids_ensemble(spark, folder):
    """Centroids of even vectors blended with those of odd ones; for some domains these are cut short, so that the first
    stand alone, and for one they are missing."""
    v = kept(D.vectors(spark, folder))
    first, second = C.mean_centroids(v.filter("term % 2 = 0")), C.mean_centroids(v.filter("term % 2 = 1 AND domain <> 3"))
    second = second.withColumn("centroid", F.when(F.col("domain") < 2, F.slice("centroid", 1, 5)).otherwise(F.col("centroid")))
    return rounded(C.as_long(S.ensemble_centroids(first, second, 0.8334, 0.1666), "domain"), "value")


def graph_methods(spark, folder):
    """Edges between regions under each of the six methods, by suppliers, their vectors, names and taxonomy."""
    v = kept(D.supplier_vectors(spark, folder))
    weights = T.synset_weights(supplier_terms(spark, folder), D.senses(spark, folder), chain(spark, folder))
    frames = []
    for method in SU.GRAPH_METHODS:
        edges = SU.graph_by_method(method, v, 0.0, show_terms=False, taxonomy_weights=weights)[1]
        frames.append(edges.withColumn("method", F.lit(method)))
    return rounded(reduce(DataFrame.unionByName, frames), "weight")


def graph_enriched(spark, folder):
    """Edges of domains of vectors that are enriched by their hypernyms; weights are not rounded before the threshold."""
    v = kept(D.vectors(spark, folder))
    pairs = S.domain_pairs(K.domain_means(v, T.enriched_terms(v, hypernym_terms(spark, folder))), "cosine")
    return rounded(G.similarity_edges(pairs, 0.1, rounded=False), "weight")


def store_levels(spark, folder):
    """Scores of pairs asked of two levels at four times: the upper one has urgent ones for a minute, the lower one all
    that are not of method rag."""
    rows = stored(spark, folder).groupBy("domain1", "domain2", "method").agg(F.max("score").alias("score"))
    rows = kept(reduce(DataFrame.unionByName, (rows.filter(F.col("method") == m).select(pair_name(m, "cosine", F.col("domain1"), F.col("domain2")).alias("key"), "method", "score") for m in ("sbert", "tfidf", "rag"))))
    rows = kept(rows.groupBy("key", "method").agg(F.array(F.max("score")).alias("value")))
    both, start = TwoLevels(spark, own_folder(spark, "upper"), own_folder(spark, "lower"), seconds=60), datetime(2024, 1, 1)
    both.upper.put("sim", rows.filter("method = 'sbert'"), start)
    both.lower.put("sim", rows.filter("method <> 'rag'"), start)
    frames = []
    for step, second in enumerate((1, 2, 61, 62)):
        found = kept(both.get("sim", rows.select("key"), datetime(2024, 1, 1, 0, second // 60, second % 60)))
        level = F.coalesce("level", F.lit("none"))
        frames.append(found.groupBy(level.alias("level")).agg(F.count("*").alias("keys"), F.sum(F.col("value")[0]).alias("total")).withColumn("step", F.lit(step)))
    return rounded(kept(reduce(DataFrame.unionByName, frames)), "total")


def state_snapshot(spark, folder):
    """Locks are errors of the last day, data sets those with results, tasks the latest state of each."""
    e = D.progress(spark, folder)
    last = e.agg(F.max("ts").alias("_last"))
    locks = e.filter("status = 'error'").join(F.broadcast(last)).filter(F.col("ts") > F.col("_last") - F.make_dt_interval(secs=F.lit(float(DAY))))  # of one row
    tasks = P.latest(e).withColumn("status", F.when(F.col("status") == "view", "running").otherwise(F.col("status")))
    return P.snapshot(locks, ST.datasets_by_age(D.history(spark, folder)), tasks)


SUPPLIERS = "long AS (SELECT s_name AS term, n_regionkey AS domain, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings JOIN supplier ON vec_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
REGION_PAIRS, REGION_KNN = PAIRS.replace(LONG, SUPPLIERS), KNN.replace(f"{LONG}, ", "")
RAG = DOMAIN_OF_TERMS.replace("round(sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 6) AS score", "sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS score").replace("SELECT a.domain AS domain1", ", rg AS (SELECT a.domain AS domain1") + ")"
TV = "gm AS (SELECT k.query AS term, o.i, avg(o.v) AS v FROM kn k JOIN long o ON k.neighbour = o.term GROUP BY ALL), tv AS (SELECT l.term, l.domain, l.i, 0.5 * l.v + 0.5 * coalesce(gm.v, l.v) AS v FROM long l LEFT JOIN gm ON l.term = gm.term AND l.i = gm.i)"
REGION_GRAMS = GRAMS.replace("tg AS (SELECT vec_id::VARCHAR AS term, label AS domain FROM embeddings)", "tg AS (SELECT s_name AS term, n_regionkey AS domain FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN embeddings ON vec_id = s_suppkey)")
WORDNET = "nr AS (SELECT domain, sqrt(sum(weight * weight)) AS n FROM sw GROUP BY 1), wd AS (SELECT a.domain AS domain1, b.domain AS domain2, sum(a.weight * b.weight) AS d FROM sw a JOIN sw b ON a.synset_id = b.synset_id AND a.domain < b.domain GROUP BY ALL), wn AS (SELECT x.domain AS domain1, y.domain AS domain2, coalesce(d, 0) / (x.n * y.n) AS score FROM nr x JOIN nr y ON x.domain < y.domain LEFT JOIN wd ON wd.domain1 = x.domain AND wd.domain2 = y.domain)"
EDGES = "SELECT domain1::VARCHAR AS source, domain2::VARCHAR AS target, round({0}, 6) AS weight, 'similarity' AS type, '{1}' AS method FROM {2} WHERE {0} >= 0"
LEVELS = "so AS (SELECT (CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'd' END) || (o_custkey % 23) AS d1, (CASE WHEN o_orderkey % 3 = 1 THEN 'D' ELSE 'd' END) || ((o_custkey + 1) % 23) AS d2, CASE o_orderstatus WHEN 'F' THEN 'sbert' WHEN 'O' THEN 'tfidf' ELSE 'rag' END AS method, o_totalprice / 1000000 AS score FROM orders), ks AS (SELECT method, CASE WHEN lower(d1) <= lower(d2) THEN d1 ELSE d2 END AS a, CASE WHEN lower(d1) <= lower(d2) THEN d2 ELSE d1 END AS b, max(score) AS score FROM so GROUP BY ALL), sm AS (SELECT method, count(*) AS keys, sum(score) AS total FROM ks GROUP BY 1)"

SQL = {
    "terms_auxiliary": "SELECT DISTINCT t AS term FROM (SELECT trim(p_name) AS t FROM part UNION SELECT trim(s_name) FROM supplier UNION SELECT trim(r_name) FROM region UNION SELECT substr(o_orderstatus, 1, 1) FROM orders) WHERE length(t) > 1",
    "articles": "SELECT doc_id::VARCHAR AS id, trim(replace(substr(text, 1, 60), chr(10), ' ')) AS title, sha256(trim(replace(text, chr(10), ' '))) AS abstract_sha256, concat_ws(',', lang, source) AS categories, source AS authors, '2024-01-01' AS published FROM documents",
    "articles_documents": "SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, 'none') AS domain, sha256(concat_ws(' ', trim(replace(substr(text, 1, 60), chr(10), ' ')), trim(replace(text, chr(10), ' ')))) AS text_sha256 FROM documents",
    "harvest_related": "WITH w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[a-z]+') AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id AS page, array_to_string(list_filter(ws, lambda x, i: i % 3 <> 0)[:20], ' ') AS related, coalesce(lang, 'none') || ',' || source AS categories FROM w",
    "harvest_unvisited": "SELECT DISTINCT o_custkey AS page FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "idf_filtered": "WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS term FROM n) SELECT term FROM w WHERE term < 'r' GROUP BY term HAVING ln((SELECT count(*) FROM n) / count(*)) >= 0.5",
    "terms_languages": r"WITH t AS (SELECT DISTINCT lang AS domain, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS term FROM documents), f AS (SELECT domain, list_sort(list(DISTINCT substr(term, 1, 3)))[:5] AS first, count(*) FILTER (regexp_matches(term, '[а-яА-Я]')) AS cyrillic FROM t GROUP BY domain) SELECT domain, len(list_filter(first, lambda x: regexp_matches(x, '[а-яА-Я]'))) > 0 AS is_cyrillic, cyrillic FROM f",
    "synset_names": "SELECT p_partkey, split_part(replace(p_name, ' ', '_'), '.', 1) AS name FROM part",
    "centroids_ensemble": f"WITH {LONG}, a AS (SELECT domain, i, avg(v) AS v FROM long WHERE term % 2 = 0 GROUP BY ALL), b AS (SELECT domain, i, avg(v) AS v FROM long WHERE term % 2 = 1 AND domain <> 3 AND domain >= 2 GROUP BY ALL) SELECT a.domain, a.i, round(CASE WHEN b.v IS NULL THEN a.v ELSE 0.8334 * a.v + 0.1666 * b.v END, 6) AS value FROM a LEFT JOIN b ON a.domain = b.domain AND a.i = b.i",
    "graph_methods": f"WITH RECURSIVE {TAX}, {SW}, {REGION_PAIRS}, {REGION_KNN}, {TV}, {RAG}, {REGION_GRAMS}, {WORDNET} {EDGES.format(SCORE, 'sbert', 'p')} UNION ALL {EDGES.format(SCORE, 'bert', 'p')} UNION ALL {EDGES.format('score', 'rag', 'rg')} UNION ALL {EDGES.format('score', 'wordnet', 'wn')} UNION ALL {EDGES.format('score', 'tfidf', 'gs')} UNION ALL {EDGES.format('(dot * 0.7 + score * 0.3)', 'ensemble', 'p JOIN gs USING (domain1, domain2)')}",
    "graph_enriched": f"WITH {ENRICHED}, {RAG} SELECT domain1::VARCHAR AS source, domain2::VARCHAR AS target, round(score, 6) AS weight, 'similarity' AS type FROM rg WHERE score >= 0.1",
    "store_levels": f"WITH {LEVELS}, st(step) AS (VALUES (0), (1), (2), (3)), x AS (SELECT step, keys, total, CASE WHEN method = 'rag' THEN 'none' WHEN step = 0 AND method = 'tfidf' THEN 'lower' WHEN step = 2 THEN 'lower' ELSE 'upper' END AS level FROM sm, st) SELECT step, level, sum(keys)::BIGINT AS keys, CASE WHEN level = 'none' THEN NULL ELSE round(sum(total), 6) END AS total FROM x GROUP BY step, level",
    "state_snapshot": "WITH l AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status FROM events GROUP BY 1), n AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS n_locks, (SELECT count(DISTINCT event_type) FROM events) AS n_datasets, (SELECT count(*) FROM l WHERE status = 'view') AS n_tasks) SELECT *, CASE WHEN n_locks > 0 OR n_tasks > 0 THEN 'busy' ELSE 'ready' END AS status FROM n",
}
QUERIES = {name: globals()[name] for name in SQL}
