"""Queries on texts: n-grams, TF-IDF, tokens, term extraction and harvested trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import harvest as H
from kindred.operators import lexical as L
from kindred.operators import similarity as S
from kindred.plans.domains import rounded
from kindred.sources import loaders
from kindred.sources import tables as D
from kindred.stores import tables as ST


def ngram_similarity(spark, folder):
    return rounded(L.ngram_similarity(D.terms(spark, folder)), "score")


def ngram_term_pairs(spark, folder):
    terms = D.terms(spark, folder)
    return rounded(L.term_pair_similarity(D.term_pairs(spark, folder), L.fitted_vocabulary(terms)), "score")


def term_frequency(spark, folder):
    return rounded(L.term_frequency(D.term_rows(spark, folder)), "tf")


def processed_domains(spark, folder):
    terms = D.terms(spark, folder)
    return rounded(L.processed_domains(terms, L.fitted_vocabulary(terms), -1.0), "z_score")


def model(spark, folder):
    return L.TfIdf(D.terms(spark, folder), 2, 4)


def tfidf_idf(spark, folder):
    return rounded(model(spark, folder).idf, "idf")


def tfidf_info(spark, folder):
    return rounded(model(spark, folder).info(), "min_idf", "max_idf")


def tfidf_pairs(spark, folder):
    return rounded(model(spark, folder).pair_scores(D.term_pairs(spark, folder)), "score")


def tfidf_matrix(spark, folder):
    return rounded(model(spark, folder).matrix(), "score")


def tfidf_square(spark, folder):
    """Both triangles and the diagonal; a text of one letter has no n-gram."""
    terms = D.terms(spark, folder).select("term")
    return rounded(L.TfIdf(terms.unionByName(terms.select(F.substring("term", 1, 1).alias("term"))), 2, 4).square(), "score")


def tfidf_most_similar(spark, folder):
    queries = D.terms(spark, folder).select("term").distinct().filter(F.col("term").startswith("red"))
    return rounded(model(spark, folder).most_similar(queries, 5), "score")


def tfidf_most_similar_whole(spark, folder):
    """For all names; `tfidf_most_similar` asks for those its SQL asks for."""
    return rounded(model(spark, folder).most_similar(D.terms(spark, folder).select("term").distinct(), 5), "score")


def tfidf_term_idf(spark, folder):
    words = D.terms(spark, folder).select(F.explode(F.array(F.col("term"), F.substring("term", 1, 3), F.substring("term", 2, 4))).alias("term"))
    return rounded(model(spark, folder).term_idf(words), "idf")


def tfidf_transfer(spark, folder):
    terms = D.terms(spark, folder)
    other = L.TfIdf(terms.filter("domain < 'P'"), 2, 4)
    own = L.TfIdf(terms, 2, 4).with_idf_of(other)
    return rounded(own.weights().groupBy("term").agg(F.count("*").alias("grams"), F.sum("weight").alias("weight")), "weight")


def ensemble_parts(spark, folder):
    """Domains of part names: the cosine of their share of sizes and their n-grams."""
    p = D.read(spark, folder, "part").groupBy(F.col("p_type").alias("domain"), F.col("p_size").alias("gram")).agg(F.count("*").cast("double").alias("weight"))
    return L.sparse_cosines(p), L.ngram_similarity(D.terms(spark, folder))


def ensemble_similarity(spark, folder):
    return rounded(S.ensemble(*ensemble_parts(spark, folder), 0.8334, 0.1666), "similarity")


def ensemble_graph(spark, folder):
    found = S.ensemble(*ensemble_parts(spark, folder), 0.7, 0.3)
    return rounded(found.filter("similarity >= 0.5").select("domain1", "domain2", "similarity"), "similarity")


def text_tokens(spark, folder):
    return D.documents(spark, folder).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def text_preprocessed(spark, folder):
    b = D.read(spark, folder, "benchmark")
    return b.select("item_id", X.preprocessed(F.col("text"), ["the", "of", "and"]).alias("words"))


def text_cleaned(spark, folder):
    return D.documents(spark, folder).select("doc_id", F.sha2(X.cleaned(F.col("text")), 256).alias("cleaned_sha256"))


def harvest_terms(spark, folder):
    found = H.extracted_terms(D.documents(spark, folder), high=2)
    return rounded(found.select("domain", "term", "frequency", "tfidf_score"), "tfidf_score", places=5)


def harvest_terms_whole(spark, folder):
    """Terms of up to three words; `harvest_terms` stops at two."""
    found = H.extracted_terms(D.documents(spark, folder))
    return rounded(found.select("domain", "term", "frequency", "tfidf_score"), "tfidf_score", places=5)


def tree(spark, folder, number="o_orderkey % 500"):
    """Priorities hold statuses, and both hold orders, as categories hold pages."""
    o = D.read(spark, folder, "orders")
    p, s = F.concat(F.lit("P:"), "o_orderpriority"), F.concat(F.lit("P:"), "o_orderpriority", F.lit("/"), "o_orderstatus")
    page = F.concat(F.lit("order "), F.expr(number).cast("string"))
    return o.select(p.alias("category"), s.alias("member"), F.lit("subcat").alias("kind")).distinct().unionByName(o.select(s.alias("category"), page.alias("member"), F.lit("page").alias("kind")).distinct())


def harvest_tree(spark, folder):
    t = tree(spark, folder)
    start = t.filter("kind = 'subcat'").select(F.col("category").alias("domain"), "category").distinct()
    return H.tree_pages(t, start, 2, 40)


def harvest_tree_whole(spark, folder):
    """With each order as a page of its own; `harvest_tree` folds them into 500."""
    t = tree(spark, folder, "o_orderkey")
    start = t.filter("kind = 'subcat'").select(F.col("category").alias("domain"), "category").distinct()
    return H.tree_pages(t, start, 2, 40)


def harvest_combined(spark, folder):
    terms = D.terms(spark, folder)
    return ST.combined_terms(terms.filter("frequency > 5"), terms)


def pairs_inverted(spark, folder):
    p = D.read(spark, folder, "part").select(F.col("p_name").alias("word1"), F.col("p_brand").alias("word2"), F.col("p_size").alias("distance"))
    return loaders.with_human_score(p)


def domain_names(spark, folder):
    return loaders.domains_of(D.terms(spark, folder))


def matrix_unpivoted(spark, folder):
    o = D.read(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return loaders.unpivoted(o, "o_orderpriority")


TERMS = "terms AS (SELECT p_name AS term, p_type AS domain, count(*) AS frequency FROM part GROUP BY ALL)"
POS = "pos AS (SELECT term, domain, n, unnest(generate_series(1, length(term) - n + 1)) AS i FROM terms, (VALUES (2), (3)) AS g(n) WHERE length(term) >= n)"
GRAMS = f"{TERMS}, {POS}, grams AS (SELECT DISTINCT term, domain, substr(term, i, n) AS gram FROM pos)"
TF = "texts AS (SELECT DISTINCT p_name AS term FROM part), gp AS (SELECT term, n, unnest(generate_series(1, length(term) - n + 1)) AS i FROM texts, (VALUES (2), (3), (4)) AS g(n) WHERE length(term) >= n), gc AS (SELECT term, lower(substr(term, i, n)) AS gram, count(*) AS c FROM gp GROUP BY ALL), idf AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM gc GROUP BY gram), w0 AS (SELECT term, gram, (1 + ln(c)) * idf AS w FROM gc JOIN idf USING (gram)), w AS (SELECT term, gram, w / sqrt(sum(w * w) OVER (PARTITION BY term)) AS w FROM w0)"
NGRAM_PAIRS = f"{GRAMS}, sz AS (SELECT domain, count(*) AS n FROM terms GROUP BY 1), gw AS (SELECT domain, gram, count(*) / any_value(sz.n) AS w FROM grams JOIN sz USING (domain) GROUP BY domain, gram), gn AS (SELECT domain, sqrt(sum(w * w)) AS n FROM gw GROUP BY 1), gd AS (SELECT a.domain AS domain1, b.domain AS domain2, sum(a.w * b.w) AS dot FROM gw a JOIN gw b ON a.gram = b.gram AND a.domain < b.domain GROUP BY ALL), ng AS (SELECT x.domain AS domain1, y.domain AS domain2, coalesce(dot, 0) / (x.n * y.n) AS score FROM gn x JOIN gn y ON x.domain < y.domain LEFT JOIN gd ON gd.domain1 = x.domain AND gd.domain2 = y.domain)"
SIZES = "zw AS (SELECT p_type AS domain, p_size AS gram, count(*)::DOUBLE AS w FROM part GROUP BY ALL), zn AS (SELECT domain, sqrt(sum(w * w)) AS n FROM zw GROUP BY 1), zd AS (SELECT a.domain AS domain1, b.domain AS domain2, sum(a.w * b.w) AS dot FROM zw a JOIN zw b ON a.gram = b.gram AND a.domain < b.domain GROUP BY ALL), zs AS (SELECT x.domain AS domain1, y.domain AS domain2, coalesce(dot, 0) / (x.n * y.n) AS score FROM zn x JOIN zn y ON x.domain < y.domain LEFT JOIN zd ON zd.domain1 = x.domain AND zd.domain2 = y.domain)"
PAIRS = "prs AS (SELECT a.n AS word1, b.n AS word2 FROM (SELECT DISTINCT p_name AS n FROM part) a JOIN (SELECT DISTINCT p_name AS n FROM part) b ON split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) AND a.n < b.n)"
CLEAN = "trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\\S+|www\\.\\S+', '', 'g'), '\\S+@\\S+', '', 'g'), '[^a-zA-Z\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"
TOKEN = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')"


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def harvest_sql(words: int) -> str:
    """Terms of up to two or three words."""
    three = " UNION ALL SELECT domain, doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM c WHERE len(w) >= 3" if words == 3 else ""
    return f"""WITH c AS (SELECT doc_id, lang AS domain, list_filter(regexp_extract_all({CLEAN}, '[a-zA-Z][a-zA-Z]+'), lambda x: x NOT IN ({listed(X.FUNCTION_WORDS)})) AS w FROM documents),
one AS (SELECT domain, doc_id, unnest(w) AS term FROM c UNION ALL SELECT domain, doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM c WHERE len(w) >= 2{three}),
t AS (SELECT domain, doc_id, term, count(*) AS tf FROM one GROUP BY ALL), n AS (SELECT lang AS domain, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1),
f AS (SELECT domain, term, count(*) AS df, sum(tf) AS total, any_value(n) AS n FROM t JOIN n USING (domain) GROUP BY domain, term HAVING count(*) >= 3 AND count(*) <= 0.8 * any_value(n)),
v AS (SELECT domain, term, df, n, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY total DESC, term) AS p FROM f) WHERE p <= 10000),
w AS (SELECT domain, doc_id, term, df, n, tf * idf AS w FROM t JOIN v USING (domain, term)), z AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY domain, doc_id)) AS u FROM w)
SELECT domain, term, max(df) AS frequency, round(sum(u) / max(n), 5) AS tfidf_score FROM z GROUP BY domain, term
HAVING len(list_filter(string_split(term, ' '), lambda x: x NOT IN ({listed([*X.FUNCTION_WORDS, *X.SCIENTIFIC_WORDS])}) AND length(x) > 2)) > 0"""

SQL = {
    "ngram_similarity": f"WITH {NGRAM_PAIRS} SELECT domain1, domain2, round(score, 6) AS score FROM ng",
    "ngram_term_pairs": f"WITH {GRAMS}, tg AS (SELECT DISTINCT term, gram FROM grams), {PAIRS}, na AS (SELECT term, count(*) AS n FROM tg GROUP BY 1), sh AS (SELECT a.term AS word1, b.term AS word2, count(*) AS k FROM tg a JOIN tg b USING (gram) GROUP BY ALL), c AS (SELECT word1, word2, coalesce(k, 0) / sqrt(x.n * y.n) AS c, list_distinct(string_split(lower(word1), '')) AS s1, list_distinct(string_split(lower(word2), '')) AS s2 FROM prs JOIN na x ON word1 = x.term JOIN na y ON word2 = y.term LEFT JOIN sh USING (word1, word2)) SELECT word1, word2, round(CASE WHEN c > 0 THEN c ELSE len(list_intersect(s1, s2)) / len(list_distinct(list_concat(s1, s2))) END, 6) AS score FROM c",
    "term_frequency": "SELECT p_type AS domain, p_name AS term, round(count(*) / any_value(n), 6) AS tf FROM part JOIN (SELECT p_type, count(*) AS n FROM part GROUP BY 1) USING (p_type) GROUP BY ALL",
    "processed_domains": f"WITH {GRAMS}, wt AS (SELECT domain, term, count(*)::DOUBLE AS weight FROM grams GROUP BY ALL), z AS (SELECT domain, term, weight, coalesce((weight - avg(weight) OVER (PARTITION BY domain)) / nullif(stddev_pop(weight) OVER (PARTITION BY domain), 0), 0) AS z FROM wt) SELECT domain, term, weight, round(z, 6) AS z_score, z >= -1.0 AS kept FROM z",
    "tfidf_idf": f"WITH {TF} SELECT gram, df, round(idf, 6) AS idf FROM idf",
    "tfidf_info": f"WITH {TF} SELECT (SELECT count(*) FROM texts) AS corpus_size, count(*) AS vocabulary_size, round(min(idf), 6) AS min_idf, round(max(idf), 6) AS max_idf FROM idf",
    "tfidf_pairs": f"WITH {TF}, {PAIRS}, d AS (SELECT a.term AS word1, b.term AS word2, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (gram) GROUP BY ALL) SELECT word1, word2, round((coalesce(dot, 0) + 1) / 2, 6) AS score FROM prs LEFT JOIN d USING (word1, word2)",
    "tfidf_matrix": f"WITH {TF}, d AS (SELECT a.term AS term1, b.term AS term2, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.gram = b.gram AND a.term < b.term GROUP BY ALL) SELECT x.term AS term1, y.term AS term2, round((coalesce(dot, 0) + 1) / 2, 6) AS score FROM texts x JOIN texts y ON x.term < y.term LEFT JOIN d ON d.term1 = x.term AND d.term2 = y.term",
    "tfidf_square": f"WITH {TF.replace('SELECT DISTINCT p_name AS term FROM part', 'SELECT p_name AS term FROM part UNION SELECT substr(p_name, 1, 1) FROM part')}, d AS (SELECT a.term AS term1, b.term AS term2, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.gram = b.gram GROUP BY ALL) SELECT x.term AS term1, y.term AS term2, round((coalesce(dot, 0) + 1) / 2, 6) AS score FROM texts x, texts y LEFT JOIN d ON d.term1 = x.term AND d.term2 = y.term",
    "tfidf_most_similar_whole": f"WITH {TF}, d AS (SELECT a.term AS query, b.term AS term, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (gram) GROUP BY ALL), s AS (SELECT q.term AS query, t.term, (coalesce(dot, 0) + 1) / 2 AS score FROM texts q JOIN texts t ON q.term <> t.term LEFT JOIN d ON d.query = q.term AND d.term = t.term), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, term) AS place FROM s) SELECT query, term, round(score, 6) AS score, place FROM r WHERE place <= 5",
    "tfidf_most_similar": f"WITH {TF}, d AS (SELECT a.term AS query, b.term AS term, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (gram) GROUP BY ALL), s AS (SELECT q.term AS query, t.term, (coalesce(dot, 0) + 1) / 2 AS score FROM texts q JOIN texts t ON q.term <> t.term LEFT JOIN d ON d.query = q.term AND d.term = t.term WHERE q.term LIKE 'red%'), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, term) AS place FROM s) SELECT query, term, round(score, 6) AS score, place FROM r WHERE place <= 5",
    "tfidf_term_idf": f"WITH {TF}, q AS (SELECT term FROM texts UNION SELECT substr(term, 1, 3) FROM texts UNION SELECT substr(term, 2, 4) FROM texts) SELECT q.term, round(coalesce(idf, 0), 6) AS idf FROM q LEFT JOIN idf ON lower(q.term) = idf.gram",
    "tfidf_transfer": f"WITH {TF.replace('FROM part)', 'FROM part)', 1)}, t2 AS (SELECT DISTINCT p_name AS term FROM part WHERE p_type < 'P'), i2 AS (SELECT gram, ln((1 + (SELECT count(*) FROM t2)) / (1 + count(*))) + 1 AS idf FROM gc JOIN t2 USING (term) GROUP BY gram), v0 AS (SELECT term, gram, (1 + ln(c)) * i2.idf AS w FROM gc JOIN i2 USING (gram)), v AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY term)) AS w FROM v0) SELECT term, count(*) AS grams, round(sum(w), 6) AS weight FROM v GROUP BY term",
    "ensemble_similarity": f"WITH {NGRAM_PAIRS}, {SIZES} SELECT domain1, domain2, round(zs.score, 4) AS sbert_score, round(ng.score, 4) AS tfidf_score, round(zs.score * 0.8334 + ng.score * 0.1666, 6) AS similarity FROM zs JOIN ng USING (domain1, domain2)",
    "ensemble_graph": f"WITH {NGRAM_PAIRS}, {SIZES} SELECT domain1, domain2, round(zs.score * 0.7 + ng.score * 0.3, 6) AS similarity FROM zs JOIN ng USING (domain1, domain2) WHERE zs.score * 0.7 + ng.score * 0.3 >= 0.5",
    "text_tokens": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKEN}) AS token FROM documents) GROUP BY token",
    "text_preprocessed": f"SELECT item_id, array_to_string(list_filter({TOKEN}, lambda x: x NOT IN ('the', 'of', 'and')), ' ') AS words FROM benchmark",
    "text_cleaned": f"SELECT doc_id, sha256({CLEAN}) AS cleaned_sha256 FROM documents",
    "harvest_terms": harvest_sql(2),
    "harvest_terms_whole": harvest_sql(3),
    "harvest_tree": "WITH e AS (SELECT DISTINCT 'P:' || o_orderpriority AS p, 'P:' || o_orderpriority || '/' || o_orderstatus AS s, 'order ' || (o_orderkey % 500)::VARCHAR AS page FROM orders), m AS (SELECT p, s, page, row_number() OVER (PARTITION BY s ORDER BY page) AS r FROM e) SELECT p AS domain, page, 1 AS depth, count(*) AS sightings FROM m WHERE r <= 40 GROUP BY ALL",
    "harvest_tree_whole": "WITH e AS (SELECT DISTINCT 'P:' || o_orderpriority AS p, 'P:' || o_orderpriority || '/' || o_orderstatus AS s, 'order ' || o_orderkey::VARCHAR AS page FROM orders), m AS (SELECT p, s, page, row_number() OVER (PARTITION BY s ORDER BY page) AS r FROM e) SELECT p AS domain, page, 1 AS depth, count(*) AS sightings FROM m WHERE r <= 40 GROUP BY ALL",
    "harvest_combined": "SELECT p_name AS term, p_type AS domain, count(*) AS frequency FROM part GROUP BY ALL",
    "pairs_inverted": "SELECT p_name AS word1, p_brand AS word2, (SELECT max(p_size) FROM part)::DOUBLE - p_size AS human_score FROM part",
    "domain_names": "SELECT p_type AS domain, count(DISTINCT p_name) AS n_terms FROM part GROUP BY 1",
    "matrix_unpivoted": "SELECT o_orderpriority AS d1, s AS d2, nullif(count(*) FILTER (o_orderstatus = s), 0)::DOUBLE AS score FROM orders, (VALUES ('F'), ('O'), ('P')) AS v(s) GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
