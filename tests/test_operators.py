"""Operators on small literals: zero vectors, ties, empty frames, unknown names."""

import math

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from kindred.config import weights_for
from kindred.functions import numbers as N
from kindred.functions import text as X
from kindred.functions import vectors as V
from kindred.operators import centroids as C
from kindred.operators import graph as G
from kindred.operators import knn as K
from kindred.operators import lexical as L
from kindred.operators import metrics as M
from kindred.operators import similarity as S
from kindred.operators import taxonomy as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(xs):
    return F.array(*(F.lit(float(x)) for x in xs))


A, B, Z, D = (1, 0, 0), (0, 1, 0), (0, 0, 0), (-1, 0, 0)


@pytest.mark.parametrize(("a", "b", "cos", "euclid"), [(A, A, 1, 1), (A, B, 0, 1 / (1 + math.sqrt(2))), (A, D, -1, 1 / 3), (A, Z, 0, 0), (Z, Z, 0, 1)])
def test_vector_similarities(spark, a, b, cos, euclid):
    assert value(spark, V.cosine(vec(a), vec(b))) == pytest.approx(cos)
    assert value(spark, V.euclidean_similarity(vec(a), vec(b))) == pytest.approx(euclid)


def test_unknown_metric():
    with pytest.raises(ValueError, match="unknown metric"):
        V.metric("manhattan")


def test_blend_ends(spark):
    assert value(spark, V.blend(vec(A), vec(B), 1.0)) == [1, 0, 0]
    assert value(spark, V.blend(vec(A), vec(B), 0.0)) == [0, 1, 0]
    assert value(spark, V.mean_of(F.array(vec(A), vec(B)))) == [0.5, 0.5, 0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "term string, domain string, embedding array<float>")


def test_centroids_keep_repeats_and_skip_the_empty(spark):
    v = vectors(spark, [("a", "x", [1.0, 0.0]), ("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 3.0]), ("c", "y", [0.0, 0.0])])
    found = {r["domain"]: r["centroid"] for r in C.mean_centroids(v).collect()}
    assert found["x"] == pytest.approx([2 / 3, 1.0])
    assert {r["domain"]: r["centroid"] for r in C.unit_centroids(v).collect()}["y"] == [0, 0]
    assert C.mean_centroids(v.limit(0)).count() == 0


def test_zero_weights_fail(spark):
    v = vectors(spark, [("a", "x", [1.0])]).withColumn("w", F.lit(0.0))
    with pytest.raises(ArithmeticException):
        C.weighted_centroids(v, "w").collect()


def test_graph_thresholds_unrounded_scores(spark):
    pairs = spark.createDataFrame([("a", "b", 0.49999), ("a", "c", 0.5)], "domain1 string, domain2 string, score double")
    assert [r["target"] for r in G.similarity_edges(pairs, 0.5).collect()] == ["c"]
    assert S.top_pairs(pairs, 1).first()["domain2"] == "c"


def test_tokens_of_any_script(spark):
    assert value(spark, X.tokens(F.lit("МАШИННОЕ ОБУЧЕНИЕ, it's"))) == ["машинное", "обучение", "it", "s"]
    assert value(spark, X.tokens(F.lit(""))) == []
    assert value(spark, X.preprocessed(F.lit("Он и Она идут"))) == "идут"


@pytest.mark.parametrize(("text", "grams"), [("", []), ("a", []), ("ab", ["ab"]), ("abc", ["ab", "bc", "abc"])])
def test_char_ngrams(spark, text, grams):
    assert value(spark, X.char_ngram_set(F.lit(text))) == grams


def test_word_ngrams_and_cleaning(spark):
    assert value(spark, X.cleaned(F.lit("See http://x.y a@b.c  Now 42!"))) == "see now"
    assert value(spark, X.word_ngrams(F.array(F.lit("a"), F.lit("b")), 1, 3)) == ["a", "b", "a b"]
    assert value(spark, X.topic_tokens(F.lit("ab"))) == ["a", "b"]
    assert value(spark, X.document_tokens(F.lit("Deep-learning v2.0"))) == ["deep", "learning", "v2", "0"]
    assert value(spark, X.display_name(F.lit("lda"))) == "LDA"
    assert value(spark, X.display_name(F.lit("other"))) == "other"


@pytest.mark.parametrize(("x", "y"), [(0.5, 0.75), (5.0, 1.0), (-5.0, 0.0)])
def test_normalize(spark, x, y):
    assert value(spark, N.normalize_to_01(F.lit(x))) == y


def test_information_content(spark):
    assert value(spark, N.information_content(F.lit(0))) == 1.0
    assert value(spark, N.information_content(F.lit(100))) == pytest.approx(1.0)


def test_weights():
    assert N.normalized_weights(0, 0) == (0.5, 0.5)
    assert weights_for("en", None) == pytest.approx((0.8334, 0.1666))
    assert weights_for("en", '{"languages": {"ru": {"sbert_weight": 1, "tfidf_weight": 3}}}') == (0.25, 0.75)


def test_term_frequency_and_z_scores(spark):
    terms = spark.createDataFrame([("машинное", "d"), ("обучение", "d"), ("машинное", "d")], "term string, domain string")
    assert {r["term"]: r["tf"] for r in L.term_frequency(terms).collect()}["машинное"] == pytest.approx(2 / 3)
    same = spark.createDataFrame([("abc", "d"), ("xyz", "d")], "term string, domain string")
    assert {r["z_score"] for r in L.processed_domains(same, L.fitted_vocabulary(same)).collect()} == {0.0}


def test_term_pairs_fall_back_to_characters(spark):
    terms = spark.createDataFrame([("abc", "d")], "term string, domain string")
    pairs = spark.createDataFrame([("abc", "abd"), ("ab", "ba"), ("x", "y")], "word1 string, word2 string")
    found = {(r["word1"], r["word2"]): r["score"] for r in L.term_pair_similarity(pairs, L.fitted_vocabulary(terms)).collect()}
    assert found["abc", "abd"] == pytest.approx(1 / math.sqrt(3))
    assert found["ab", "ba"] == 1.0
    assert found["x", "y"] == 0.0


def test_tfidf_floor_and_unknown(spark):
    model = L.TfIdf(spark.createDataFrame([("abc",), ("xyz",)], "term string"), 2, 3)
    pairs = spark.createDataFrame([("abc", "abc"), ("abc", "xyz"), ("abc", "qqq")], "word1 string, word2 string")
    found = {r["word2"]: r["score"] for r in model.pair_scores(pairs).collect()}
    assert found == pytest.approx({"abc": 1.0, "xyz": 0.5, "qqq": 0.0})


def test_nearest_returns_fewer_rows_from_a_small_corpus(spark):
    v = vectors(spark, [("a", "x", [1.0, 0.0]), ("b", "x", [0.9, 0.1]), ("c", "y", [0.0, 1.0])])
    own = K.index(v)
    rows = K.nearest(own, own, 5, block=2).collect()
    assert {(r["query"], r["neighbour"]) for r in rows} == {(p, q) for p in "abc" for q in "abc" if p != q}
    assert {r["query"]: r["neighbour"] for r in rows if r["place"] == 1} == {"a": "b", "b": "a", "c": "b"}


def scores(spark, rows):
    return spark.createDataFrame([("m", float(h), s) for h, s in rows], "method string, human_score double, score double")


def test_metrics_of_degenerate_input(spark):
    row = M.evaluated(scores(spark, [(1, None), (2, 0.5)])).first()
    assert (row["spearman"], row["pearson"], row["mse"], row["missing"], row["predictions_count"]) == (0, 0, 1, 1, 1)
    row = M.evaluated(scores(spark, [(1, 0.5), (2, 0.5), (3, float("nan"))])).first()
    assert (row["spearman"], row["mse"], row["missing"], row["predictions_count"]) == (0, 1, 1, 2)
    row = M.evaluated(scores(spark, [(1, 0.1), (2, 0.2), (3, 0.3)])).first()
    assert row["spearman"] == pytest.approx(1.0)


def test_rank_ensemble(spark):
    rows = [(m, i, x) for m in ("a", "b") for i, x in enumerate([0.9, 0.7, 0.5, 0.3, 0.1])]
    found = {r["item"]: r["score"] for r in M.rank_ensemble(spark.createDataFrame(rows, "method string, item int, score double")).collect()}
    assert [found[i] for i in range(5)] == pytest.approx([1, 0.75, 0.5, 0.25, 0])
    with pytest.raises(ValueError, match="weights"):
        M.rank_ensemble(spark.createDataFrame(rows, "method string, item int, score double"), {"a": 1.0})
    flat = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5)], "method string, item int, score double")
    assert {r["score"] for r in M.rank_ensemble(flat).collect()} == {0.5}


def tree(spark):
    h = spark.createDataFrame([("leaf", "middle", 0), ("leaf2", "middle", 0), ("middle", "root", 0), ("x", "y", 0), ("y", "x", 0)], "child string, parent string, ord int")
    s = spark.createDataFrame([(n,) for n in ("leaf", "leaf2", "middle", "root", "x", "y", "alone")], "synset_id string")
    return s, h


def test_chains_depths_and_cycles(spark):
    s, h = tree(spark)
    depth = {r["synset_id"]: r["depth"] for r in T.depths(T.chains(s, h)).collect()}
    assert depth == {"leaf": 2, "leaf2": 2, "middle": 1, "root": 0, "x": 1, "y": 1, "alone": 0}


def test_common_ancestors_and_paths(spark):
    s, h = tree(spark)
    pairs = spark.createDataFrame([("leaf", "leaf2"), ("leaf", "root"), ("alone", "alone"), ("leaf", "alone"), ("leaf", "leaf")], "s1 string, s2 string")
    chain = T.chains(s, h)
    lcs = {(r["s1"], r["s2"]): r["lcs"] for r in T.common_ancestors(pairs, chain, h).collect()}
    assert lcs["leaf", "leaf2"] == "middle"
    assert lcs["leaf", "root"] is None
    assert lcs["alone", "alone"] is None
    paths = {(r["s1"], r["s2"]): r["length"] for r in T.shortest_paths(pairs, h).collect()}
    assert paths == {("leaf", "leaf2"): 2, ("leaf", "root"): 2, ("alone", "alone"): 0, ("leaf", "alone"): -1, ("leaf", "leaf"): 0}
    ic = T.contents(s, h.select(F.col("parent").alias("synset_id")))
    lin = {(r["s1"], r["s2"]): r["lin"] for r in T.synset_similarities(pairs, chain, h, ic).collect()}
    assert lin["alone", "alone"] == 0.0


def test_unknown_terms_score_nothing(spark):
    s, h = tree(spark)
    senses = spark.createDataFrame([("Leaf", "leaf", 0)], "term string, synset_id string, ord int")
    pairs = spark.createDataFrame([("leaf", "nothing")], "word1 string, word2 string")
    found = spark.createDataFrame([], "s1 string, s2 string, lin double")
    assert T.term_similarities(pairs, senses, found, "lin").first()["score"] == 0.0
    with pytest.raises(ValueError, match="unknown algorithm"):
        T.term_similarities(pairs, senses, found, "resnik")
