"""Character n-gram and TF-IDF similarity, in sparse long form: one row for each term and n-gram.

A dot product is an equi-join on n-grams, with the terms or domains aggregated before. Dense vocabulary vectors are
never built.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import numbers as N
from kindred.functions import text as X
from kindred.operators import grid
from kindred.stores.lineage import kept


def domain_ngrams(terms: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """`domain, gram, weight`: the share of the domain's terms that have the n-gram."""
    sizes = terms.groupBy("domain").agg(F.count("*").alias("_n"))
    grams = terms.select("domain", F.explode(X.char_ngram_set(F.col("term"), low, high)).alias("gram")).groupBy("domain", "gram").agg(F.count("*").alias("_c"))
    return grams.join(sizes, "domain").select("domain", "gram", (F.col("_c") / F.col("_n")).alias("weight"))


def sparse_cosines(weights: DataFrame, by: str = "domain", feature: str = "gram", left: str = "domain1", right: str = "domain2") -> DataFrame:
    """`left, right, score` for left < right of all owners; owners that share nothing, or weigh nothing, score 0."""
    weights = kept(weights.select(by, feature, "weight"))
    norms = weights.groupBy(by).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    a = weights.select(F.col(by).alias(left), F.col(feature).alias("_f"), F.col("weight").alias("_a"))
    b = weights.select(F.col(by).alias(right), F.col(feature).alias("_f"), F.col("weight").alias("_b"))
    dots = a.join(b, "_f").filter(F.col(left) < F.col(right)).groupBy(left, right).agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    na, nb = norms.select(F.col(by).alias(left), F.col("_norm").alias("_na")), norms.select(F.col(by).alias(right), F.col("_norm").alias("_nb"))
    pairs = na.join(nb, F.col(left) < F.col(right))  # aggregates only
    return pairs.join(dots, [left, right], "left").select(left, right, F.coalesce(F.try_divide("_dot", F.col("_na") * F.col("_nb")), F.lit(0.0)).alias("score"))


def ngram_similarity(terms: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """`domain1, domain2, score`: cosines of the domains' n-gram shares. A shared vocabulary does not change them."""
    return sparse_cosines(domain_ngrams(terms, low, high))


def fitted_vocabulary(terms: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    return terms.select(F.explode(X.char_ngram_set(F.col("term"), low, high)).alias("gram")).distinct()


def ngrams_in_vocabulary(terms: DataFrame, vocabulary: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """`term, gram` for the distinct terms' n-grams that the fitted vocabulary has."""
    grams = terms.select("term").distinct().select("term", F.explode(X.char_ngram_set(F.col("term"), low, high)).alias("gram"))
    return grams.join(vocabulary, "gram", "left_semi")


def term_pair_similarity(pairs: DataFrame, vocabulary: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """`word1, word2, score`: cosine of the terms' n-gram sets within the vocabulary; where it is 0, the overlap of
    their characters."""
    words = pairs.select(F.col("word1").alias("term")).union(pairs.select(F.col("word2").alias("term")))
    sets = ngrams_in_vocabulary(words, vocabulary, low, high).groupBy("term").agg(F.collect_set("gram").alias("grams"))  # of one term
    a, b = (sets.select(F.col("term").alias(w), F.col("grams").alias(g)) for w, g in (("word1", "_a"), ("word2", "_b")))
    joined = pairs.select("word1", "word2").join(a, "word1", "left").join(b, "word2", "left")
    shared = F.size(F.array_intersect("_a", "_b"))
    cosine = F.coalesce(F.try_divide(shared, F.sqrt(F.size("_a").cast("double") * F.size("_b"))), F.lit(0.0))
    return joined.select("word1", "word2", F.when(cosine > 0, cosine).otherwise(X.character_jaccard(F.col("word1"), F.col("word2"))).alias("score"))


def term_frequency(terms: DataFrame, normalize: bool = True, by: str = "domain") -> DataFrame:
    """`by, term, tf`: how often each term comes, as a share of its group's rows if `normalize`. Case matters."""
    counts = terms.groupBy(by, "term").agg(F.count("*").alias("_c"))
    if not normalize:
        return counts.select(by, "term", F.col("_c").cast("double").alias("tf"))
    sizes = terms.groupBy(by).agg(F.count("*").alias("_n"))
    return counts.join(sizes, by).select(by, "term", (F.col("_c") / F.col("_n")).alias("tf"))


def ngram_weights(terms: DataFrame, vocabulary: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """`domain, term, weight`: the number of the term's distinct n-grams in the vocabulary; repeated terms once."""
    counts = ngrams_in_vocabulary(terms, vocabulary, low, high).groupBy("term").agg(F.count("*").alias("_c"))
    own = terms.select("domain", "term").distinct()
    return own.join(counts, "term", "left").select("domain", "term", F.coalesce("_c", F.lit(0)).cast("double").alias("weight"))


def processed_domains(terms: DataFrame, vocabulary: DataFrame, threshold: float = -2.0, low: int = 2, high: int = 3) -> DataFrame:
    """`domain, term, weight, z_score, kept`: weights, their z-scores in the domain (0 where constant), and whether the
    z-score reaches the threshold."""
    weights = ngram_weights(terms, vocabulary, low, high)
    stats = weights.groupBy("domain").agg(F.avg("weight").alias("_m"), F.stddev_pop("weight").alias("_s"))
    z = F.coalesce(F.try_divide(F.col("weight") - F.col("_m"), F.col("_s")), F.lit(0.0))
    return weights.join(stats, "domain").select("domain", "term", "weight", z.alias("z_score"), (z >= threshold).alias("kept"))


def filtered_by_idf(terms: DataFrame, idf: DataFrame, threshold: float) -> DataFrame:
    """Terms whose idf reaches the threshold; a term without one has 0."""
    return terms.join(idf.select("term", F.col("idf").alias("_idf")), "term", "left").filter(F.coalesce("_idf", F.lit(0.0)) >= threshold).drop("_idf")


#: Texts of a grid row, of a column, and of a batch that meets them; texts of a block of the matrix.
ROW, COLUMN, BATCH, BLOCK = 512, 20_000, 512, 512


def sparse_prepare(rows):
    """The features that a cell's first side has, in order, and its rows over them."""
    features, weights = (grid.one_array(rows.column(c)) for c in ("features", "weights"))
    known = np.unique(features.flatten().to_numpy(zero_copy_only=False))
    return known, grid.spread(features, weights, known)


def sparse_score(own, rows) -> np.ndarray:
    """(dot product + 1) / 2 of every row with every one of the batch."""
    known, left = own
    return (left @ grid.spread(grid.one_array(rows.column("features")), grid.one_array(rows.column("weights")), known).T + 1) / 2


class TfIdf:
    """A TF-IDF model over character n-grams: 1 + ln(count), smooth idf, rows of length 1.

    `documents` (a column `term`, distinct texts) is what it was fitted on; `idf` is `gram, df, idf`. The texts are read
    and cut into n-grams once; their counts, idf and weights are kept when they are first asked for."""

    def __init__(self, documents: DataFrame, low: int = 1, high: int = 2, idf: DataFrame | None = None):
        self.documents, self.low, self.high = documents.select("term").distinct(), low, high
        self.given = idf

    def counts(self, texts: DataFrame) -> DataFrame:
        grams = texts.select("term", F.explode(X.char_ngrams(F.lower("term"), self.low, self.high)).alias("gram"))
        return grams.groupBy("term", "gram").agg(F.count("*").alias("_c"))

    @cached_property
    def texts(self) -> DataFrame:
        return kept(self.documents)

    @cached_property
    def own_counts(self) -> DataFrame:
        return kept(self.counts(self.texts))

    @cached_property
    def idf(self) -> DataFrame:
        return kept(self.given if self.given is not None else self.fitted())

    @cached_property
    def own_weights(self) -> DataFrame:
        return kept(self.weighed(self.own_counts))

    def fitted(self) -> DataFrame:
        frequency = self.own_counts.groupBy("gram").agg(F.count("*").alias("df"))
        size = self.texts.agg(F.count("*").alias("_n"))
        return frequency.join(F.broadcast(size)).select("gram", "df", N.smooth_idf(F.col("_n").cast("double"), F.col("df")).alias("idf"))  # of one row

    def with_idf_of(self, other: TfIdf) -> TfIdf:
        """This model's texts under another one's vocabulary and idf."""
        return TfIdf(self.documents, other.low, other.high, other.idf)

    def weighed(self, counts: DataFrame) -> DataFrame:
        raw = counts.join(self.idf, "gram").select("term", "gram", ((1 + F.ln("_c")) * F.col("idf")).alias("_w"))
        norms = raw.groupBy("term").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
        return raw.join(norms, "term").select("term", "gram", (F.col("_w") / F.col("_norm")).alias("weight"))

    def weights(self, texts: DataFrame | None = None) -> DataFrame:
        """`term, gram, weight` of the texts (the fitted ones if none are given), rows of length 1."""
        return self.own_weights if texts is None else self.weighed(self.counts(texts.select("term").distinct()))

    @cached_property
    def numbers(self) -> DataFrame:
        """`gram, number`: the vocabulary, numbered."""
        return kept(self.idf.select("gram", F.monotonically_increasing_id().alias("number")))

    def rows(self, weights: DataFrame) -> DataFrame:
        """`term, features, weights`: a row for each text, its n-grams by number."""
        each = weights.join(self.numbers, "gram").groupBy("term").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("_r"))  # of one text
        return each.select("term", F.col("_r.number").alias("features"), F.col("_r.weight").alias("weights"))

    def pair_scores(self, pairs: DataFrame) -> DataFrame:
        """`word1, word2, score`: (cosine + 1) / 2; 0 where a text has no n-gram in the vocabulary."""
        own = kept(pairs.select("word1", "word2").distinct())
        words = own.select(F.explode(F.array("word1", "word2")).alias("term"))
        weights = kept(self.weights(words))
        a = own.join(weights.select(F.col("term").alias("word1"), "gram", F.col("weight").alias("_a")), "word1")
        dots = a.join(weights.select(F.col("term").alias("word2"), "gram", F.col("weight").alias("_b")), ["word2", "gram"]).groupBy("word1", "word2").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
        known = weights.select("term").distinct()
        both = own.join(known.withColumnRenamed("term", "word1"), "word1", "left_semi").join(known.withColumnRenamed("term", "word2"), "word2", "left_semi").withColumn("_known", F.lit(True))
        found = own.join(both, ["word1", "word2"], "left").join(dots, ["word1", "word2"], "left")
        return found.select("word1", "word2", F.when(F.col("_known"), N.half_shift(F.coalesce("_dot", F.lit(0.0)))).otherwise(0.0).alias("score"))

    def matrix(self) -> DataFrame:
        """`term1, term2, score` for term1 < term2 of the texts that have n-grams: (cosine + 1) / 2, so 0.5 where they share
        nothing. By blocks of texts, each pair of blocks one product."""
        return grid.products(self.rows(self.own_weights), sparse_prepare, sparse_score, BLOCK)

    def square(self) -> DataFrame:
        """`term1, term2, score` of every fitted text with every one: both triangles and the diagonal, which is 1. A text
        without n-grams scores 0.5 with all, itself included."""
        rows = self.rows(self.own_weights)
        rows = self.texts.join(rows, "term", "left").select("term", F.coalesce("features", F.array().cast("array<long>")).alias("features"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))
        upper = grid.products(rows, sparse_prepare, sparse_score, BLOCK)
        both = upper.select(F.explode(F.array(F.struct("term1", "term2"), F.struct(F.col("term2").alias("term1"), F.col("term1").alias("term2")))).alias("_p"), "score").select("_p.*", "score")
        return both.unionByName(rows.select(F.col("term").alias("term1"), F.col("term").alias("term2"), F.when(F.size("features") > 0, 1.0).otherwise(0.5).alias("score")))

    def term_idf(self, terms: DataFrame) -> DataFrame:
        """`term, idf`: of terms that are n-grams of the vocabulary themselves; 0 for others."""
        return terms.select("term").distinct().join(self.idf.select(F.col("gram").alias("_g"), "idf"), F.lower("term") == F.col("_g"), "left").select("term", F.coalesce("idf", F.lit(0.0)).alias("idf"))

    def info(self) -> DataFrame:
        """`corpus_size, vocabulary_size, min_idf, max_idf`."""
        size = self.texts.agg(F.count("*").alias("corpus_size"))
        vocabulary = self.idf.agg(F.count("*").alias("vocabulary_size"), F.min("idf").alias("min_idf"), F.max("idf").alias("max_idf"))
        return size.join(vocabulary)  # of one row each

    def most_similar(self, queries: DataFrame, k: int = 5, exclude_self: bool = True) -> DataFrame:
        """`query, term, score, place`: the k fitted texts nearest to each query that has n-grams of the vocabulary; ties in
        order of text. Every fitted text is an answer, at 0.5 at least. By a grid that keeps the running best."""
        corpus, asked = kept(self.rows(self.own_weights)), kept(self.rows(self.weights(queries)))
        found = grid.best(asked, corpus, k, sparse_prepare, sparse_score, ROW, COLUMN, BATCH, exclude_self)
        return found.withColumnRenamed("neighbour", "term")


def tfidf_for(language: str, documents: DataFrame, low: int | None = None, high: int | None = None) -> TfIdf:
    """The model with a language's usual n-grams: 2 to 4 characters."""
    return TfIdf(documents, low or 2, high or 4)
