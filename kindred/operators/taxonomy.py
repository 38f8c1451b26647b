"""Taxonomies: hypernym chains, depths, information content, common ancestors and the similarities made of them.

Tables: `senses` (term, synset_id, ord), `hypernyms` (child, parent, ord). Chains follow the first parent of each
synset; they are found once for all synsets by doubling-free level joins and reused by every measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import numbers as N
from kindred.functions import vectors as V
from kindred.operators import grid
from kindred.operators.centroids import mean_centroids
from kindred.stores.lineage import kept

#: Steps of a chain at most.
MOST_STEPS = 100


def first_senses(senses: DataFrame) -> DataFrame:
    """`term, synset_id`: the first sense of each term, in lower case and trimmed."""
    own = senses.select(F.lower(F.trim("term")).alias("term"), "synset_id", "ord")
    return own.groupBy("term").agg(F.min_by("synset_id", F.struct("ord", "synset_id")).alias("synset_id"))


def first_parents(hypernyms: DataFrame) -> DataFrame:
    return hypernyms.groupBy("child").agg(F.min_by("parent", F.struct("ord", "parent")).alias("parent"))


def chains(synsets: DataFrame, hypernyms: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """`synset_id, ancestor, steps`: each synset (0 steps) and those up its first-parent chain. A chain ends where it
    would meet itself again, or after `most` steps. `synsets` has a column `synset_id`."""
    own = F.array("synset_id")
    parents = kept(first_parents(hypernyms))
    front = kept(synsets.select("synset_id").distinct().select("synset_id", F.col("synset_id").alias("ancestor"), F.lit(0).alias("steps"), own.alias("path")))
    found = [front.drop("path")]
    for step in range(1, most + 1):
        up = front.join(parents, F.col("ancestor") == F.col("child")).filter(~F.array_contains("path", F.col("parent")))
        front = kept(up.select("synset_id", F.col("parent").alias("ancestor"), F.lit(step).alias("steps"), F.concat("path", F.array("parent")).alias("path")))
        if front.isEmpty():
            break
        found.append(front.drop("path"))
    return reduce(DataFrame.unionByName, found)


def depths(chain: DataFrame) -> DataFrame:
    """`synset_id, depth`: edges to the root."""
    return chain.groupBy("synset_id").agg(F.max("steps").alias("depth"))


def contents(synsets: DataFrame, members: DataFrame) -> DataFrame:
    """`synset_id, senses, ic`: information content from the number of senses (rows of `members`)."""
    counts = members.groupBy("synset_id").agg(F.count("*").alias("senses"))
    out = synsets.select("synset_id").distinct().join(counts, "synset_id", "left").withColumn("senses", F.coalesce("senses", F.lit(0)))
    return out.withColumn("ic", N.information_content(F.col("senses")))


def common_ancestors(pairs: DataFrame, chain: DataFrame, hypernyms: DataFrame, roots_count: bool = False) -> DataFrame:
    """`s1, s2, lcs` for pairs of synsets: walking up from s2, itself included, the first strict ancestor of s1 that
    has a parent (any, if `roots_count`); null if there is none."""
    inner = chain if roots_count else chain.join(hypernyms.select(F.col("child").alias("ancestor")).distinct(), "ancestor", "left_semi")
    own = pairs.select("s1", "s2").distinct()
    above = own.join(inner.filter("steps >= 1").select(F.col("synset_id").alias("s1"), "ancestor"), "s1")
    met = above.join(inner.select(F.col("synset_id").alias("s2"), "ancestor", "steps"), ["s2", "ancestor"])
    found = met.groupBy("s1", "s2").agg(F.min_by("ancestor", F.struct("steps", "ancestor")).alias("lcs"))
    return own.join(found, ["s1", "s2"], "left")


def inner_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges `a, b` both ways: those without leaves, and `leaf, inner` of the leaves. A leaf is a node with one edge only,
    to a node that has others: no path runs through it, so all paths to it are those to its neighbour and one step more."""
    ends = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    alone = kept(ends.filter("n = 1").select(F.col("a").alias("leaf"), F.col("b").alias("inner")))
    leaves = kept(alone.join(alone.select(F.col("leaf").alias("inner")), "inner", "left_anti").select("leaf", "inner"))
    inner = edges.join(leaves.select(F.col("leaf").alias("a")), "a", "left_anti").join(leaves.select(F.col("leaf").alias("b")), "b", "left_anti")
    return kept(inner.select("a", "b")), leaves


def shortest_paths(pairs: DataFrame, hypernyms: DataFrame, most: int = 20) -> DataFrame:
    """`s1, s2, length` over all hypernym edges, both ways: 0 for a synset with itself, -1 where `most` steps find none.

    A leaf of the graph is looked for at its only neighbour, a step nearer, so the search is over the inner nodes, and pairs
    of leaves with the same neighbours share one."""
    edges = kept(hypernyms.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(hypernyms.select("parent", "child")).filter("a <> b").distinct())
    inner, leaves = inner_edges(edges)
    wanted = pairs.select("s1", "s2").filter("s1 IS NOT NULL AND s2 IS NOT NULL").distinct()
    for k in ("1", "2"):
        wanted = wanted.join(leaves.select(F.col("leaf").alias(f"s{k}"), F.col("inner").alias(f"_i{k}")), f"s{k}", "left")
    outer = F.col("_i1").isNotNull().cast("int") + F.col("_i2").isNotNull().cast("int")
    wanted = kept(wanted.select("s1", "s2", F.coalesce("_i1", "s1").alias("e1"), F.coalesce("_i2", "s2").alias("e2"), outer.alias("outer")))
    found = inner_paths(wanted.filter("s1 <> s2").select(F.col("e1").alias("s1"), F.col("e2").alias("s2")), inner, most)
    met = wanted.join(found.select(F.col("s1").alias("e1"), F.col("s2").alias("e2"), F.col("length").alias("_l")), ["e1", "e2"], "left")
    length = F.col("_l") + F.col("outer")
    return met.select("s1", "s2", F.when(F.col("s1") == F.col("s2"), 0).when((F.col("_l") >= 0) & (length <= most), length).otherwise(-1).alias("length"))


def inner_paths(pairs: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """`s1, s2, length` over edges `a, b` that are there both ways.

    The search goes from both ends of each pair at once. Frontiers belong to synsets, not to pairs, so pairs that share an
    end share its frontier, and each level is one join with the edges. The level of both ends rises in turn: after i levels
    of the first and j of the second all pairs up to i + j apart have met. A pair that has met leaves, and with it the
    frontiers that only it needed. So a search reaches half as deep as a path is long, and stops with the last open pair."""
    wanted = kept(pairs.select("s1", "s2").distinct())
    done = [kept(wanted.filter(F.col("s1") == F.col("s2")).withColumn("length", F.lit(0)))]
    open_ = kept(wanted.filter(F.col("s1") != F.col("s2")))
    sides, fronts = {}, {}
    for k in ("s1", "s2"):
        fronts[k] = sides[k] = kept(open_.select(F.col(k).alias("end"), F.col(k).alias("at")).distinct())
    for length in range(1, most + 1):
        k, other = ("s1", "s2") if length % 2 else ("s2", "s1")
        if open_.isEmpty():
            break
        needed = open_.select(F.col(k).alias("end")).distinct()
        steps = fronts[k].join(needed, "end", "left_semi").join(edges, F.col("at") == F.col("a")).select("end", F.col("b").alias("at")).distinct()
        fronts[k] = kept(steps.join(sides[k], ["end", "at"], "left_anti"))
        sides[k] = kept(sides[k].join(needed, "end", "left_semi").unionByName(fronts[k]))
        # what is met for the first time now lies on both outermost levels
        met = open_.join(fronts[k].select(F.col("end").alias(k), "at"), k).join(fronts[other].select(F.col("end").alias(other), "at"), [other, "at"], "left_semi").select("s1", "s2").distinct()
        met = kept(met.withColumn("length", F.lit(length)))
        done.append(met)
        open_ = kept(open_.join(met, ["s1", "s2"], "left_anti"))
    return reduce(DataFrame.unionByName, done).unionByName(open_.withColumn("length", F.lit(-1)))


def synset_similarities(pairs: DataFrame, chain: DataFrame, hypernyms: DataFrame, ic: DataFrame, paths: DataFrame | None = None, roots_count: bool = False) -> DataFrame:
    """`s1, s2, lin, wup` (and `path`, where lengths are given). Without a common ancestor lin and wup are 0."""
    depth = depths(chain)
    out = common_ancestors(pairs, chain, hypernyms, roots_count)
    for of in ("s1", "s2", "lcs"):
        out = out.join(ic.select(F.col("synset_id").alias(of), F.col("ic").alias(f"ic_{of}")), of, "left").join(depth.select(F.col("synset_id").alias(of), F.col("depth").alias(f"depth_{of}")), of, "left")
    lin = F.coalesce(F.try_divide(2 * F.col("ic_lcs"), F.col("ic_s1") + F.col("ic_s2")), F.lit(0.0))
    wup = F.coalesce(F.try_divide(2.0 * F.col("depth_lcs"), F.col("depth_s1") + F.col("depth_s2")), F.lit(0.0))
    out = out.select("s1", "s2", N.clip01(lin).alias("lin"), wup.alias("wup"))
    if paths is not None:
        out = out.join(paths, ["s1", "s2"], "left").withColumn("path", F.when(F.coalesce("length", F.lit(-1)) >= 0, 1 / (1 + F.col("length"))).otherwise(0.0)).drop("length")
    return out


ALGORITHMS = ("lin", "wup", "path")


def term_similarities(pairs: DataFrame, senses: DataFrame, scores: DataFrame, algorithm: str) -> DataFrame:
    """`word1, word2, score` from scores of synset pairs; 0 where a word has no synset."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; use one of {ALGORITHMS}")
    first = first_senses(senses)
    out = pairs.select("word1", "word2", F.lower(F.trim("word1")).alias("_1"), F.lower(F.trim("word2")).alias("_2"))
    out = out.join(first.select(F.col("term").alias("_1"), F.col("synset_id").alias("s1")), "_1", "left").join(first.select(F.col("term").alias("_2"), F.col("synset_id").alias("s2")), "_2", "left")
    return out.join(scores.select("s1", "s2", F.col(algorithm).alias("_s")), ["s1", "s2"], "left").select("word1", "word2", F.coalesce("_s", F.lit(0.0)).alias("score"))


def term_scores(pairs: DataFrame, senses: DataFrame, scores: DataFrame, *algorithms: str) -> DataFrame:
    """`word1, word2` and a column for each algorithm, from scores of synset pairs in one join; 0 where a word has no
    synset."""
    first = kept(first_senses(senses))
    out = pairs.select("word1", "word2", F.lower(F.trim("word1")).alias("_1"), F.lower(F.trim("word2")).alias("_2")).distinct()
    for k in (1, 2):
        out = out.join(first.select(F.col("term").alias(f"_{k}"), F.col("synset_id").alias(f"s{k}")), f"_{k}", "left")
    found = scores.select("s1", "s2", *(F.col(a).alias(f"_s_{a}") for a in algorithms))
    return out.join(found, ["s1", "s2"], "left").select("word1", "word2", *(F.coalesce(f"_s_{a}", F.lit(0.0)).alias(a) for a in algorithms))


def sense_pairs(pairs: DataFrame, senses: DataFrame) -> DataFrame:
    """`s1, s2`: the distinct synset pairs of the words' first senses."""
    first = first_senses(senses)
    out = pairs.select(F.lower(F.trim("word1")).alias("_1"), F.lower(F.trim("word2")).alias("_2"))
    out = out.join(first.select(F.col("term").alias("_1"), F.col("synset_id").alias("s1")), "_1").join(first.select(F.col("term").alias("_2"), F.col("synset_id").alias("s2")), "_2")
    return out.select("s1", "s2").distinct()


AGGREGATIONS = {"max": F.max, "mean": F.avg, "min": F.min}


def domain_synsets(terms: DataFrame, senses: DataFrame) -> DataFrame:
    """`domain, synset_id, n`: how many of a domain's terms have the synset as first sense; a null one for those without."""
    own = terms.select("domain", F.lower(F.trim("term")).alias("term")).join(first_senses(senses), "term", "left")
    return own.groupBy("domain", "synset_id").agg(F.count("*").alias("n"))


def interchangeable(counts: DataFrame, chain: DataFrame, ic: DataFrame) -> DataFrame:
    """`domain, synset_id, n` of `domain_synsets`, a row for synsets of a domain that lin and wup cannot tell apart: those of
    one information content below one first parent that are no synset's ancestors. The smallest stands for all."""
    above = chain.filter("steps = 1").select("synset_id", F.col("ancestor").alias("_parent"))
    inner = chain.filter("steps >= 1").select(F.col("ancestor").alias("synset_id"), F.col("ancestor").alias("_own")).distinct()
    told = counts.join(above, "synset_id", "left").join(inner, "synset_id", "left").join(ic.select("synset_id", F.col("ic").alias("_ic")), "synset_id", "left")
    own = F.when(F.col("_parent").isNull(), F.col("synset_id")).otherwise(F.col("_own"))  # without a parent none is like it
    return told.groupBy("domain", "_parent", "_ic", own.alias("_own")).agg(F.min("synset_id").alias("synset_id"), F.sum("n").alias("n")).select("domain", "synset_id", "n")


def domain_synset_pairs(counts: DataFrame) -> DataFrame:
    """`domain1, s1, n1, domain2, s2, n2` for domain1 < domain2: synsets that the similarity of two domains compares, a
    product of both by its definition. By a grid of cells."""
    counts = kept(counts)
    a, b = (counts.select(F.col("domain").alias(f"domain{k}"), F.col("synset_id").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    return grid.pairs(a, b).filter(F.col("domain1") < F.col("domain2"))


def domain_similarities(pairs: DataFrame, scores: DataFrame, algorithm: str, *aggregations: str) -> DataFrame:
    """`domain1, domain2` and a column for each aggregation of the similarities of the domains' term pairs, from
    `domain_synset_pairs`. A synset pair without a score counts 0."""
    if unknown := sorted(set(aggregations) - set(AGGREGATIONS)):
        raise ValueError(f"unknown aggregation {unknown[0]!r}; use one of {sorted(AGGREGATIONS)}")
    met = pairs.join(scores.select("s1", "s2", F.col(algorithm).alias("_s")), ["s1", "s2"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    weight = F.col("n1") * F.col("n2")
    found = {"max": F.max("_s"), "min": F.min("_s"), "mean": F.sum(F.col("_s") * weight) / F.sum(weight)}
    return met.groupBy("domain1", "domain2").agg(*(found[a].alias(a) for a in aggregations))


def domain_similarity(terms: DataFrame, senses: DataFrame, scores: DataFrame, algorithm: str = "lin", aggregation: str = "max") -> DataFrame:
    """`domain1, domain2, score`: the best, mean or least similarity of the domains' term pairs.

    Terms are first counted by domain and synset (none: 0 with everything), so the pairs formed are of synsets; for lin and
    wup, `interchangeable` ones can be counted as one before."""
    return domain_similarities(domain_synset_pairs(domain_synsets(terms, senses)), scores, algorithm, aggregation).withColumnRenamed(aggregation, "score")


def synset_weights(terms: DataFrame, senses: DataFrame, chain: DataFrame, decay: float = 0.7, most: int = 10) -> DataFrame:
    """`domain, synset_id, weight`: decay ** steps summed over the first `most` ancestors of the terms' synsets, as
    shares of the domain. Their sparse cosine compares domains."""
    own = terms.select("domain", F.lower(F.trim("term")).alias("term")).join(first_senses(senses), "term")
    up = own.join(chain.filter(F.col("steps") <= most), "synset_id").groupBy("domain", F.col("ancestor").alias("synset_id")).agg(F.sum(F.pow(F.lit(decay), F.col("steps"))).alias("_w"))
    return up.select("domain", "synset_id", (F.col("_w") / F.sum("_w").over(W.partitionBy("domain"))).alias("weight"))


def enriched_terms(vectors: DataFrame, hypernym_terms: DataFrame, alpha: float = 0.7, most: int = 3) -> DataFrame:
    """`term, vector, n_hypernyms`: alpha times the term's vector plus 1 - alpha times the mean of its first `most`
    hypernyms' vectors, of length 1; the plain vector for a term without any.

    `vectors` is `term, embedding`; `hypernym_terms` is `term, hypernym, steps`. Hypernyms without a vector are passed
    over."""
    at = F.row_number().over(W.partitionBy("term").orderBy("steps", "hypernym"))
    first = hypernym_terms.withColumn("_at", at).filter(F.col("_at") <= most)
    one = vectors.groupBy("term").agg(F.min(V.as_doubles(F.col("embedding"))).alias("embedding"))
    linked = first.select(F.col("term").alias("owner"), F.col("hypernym").alias("term")).join(one, "term")
    means = mean_centroids(linked, "owner").select(F.col("owner").alias("term"), F.col("centroid").alias("_mean"))
    counts = linked.groupBy("owner").agg(F.count("*").alias("n_hypernyms")).withColumnRenamed("owner", "term")
    out = one.join(means, "term", "left").join(counts, "term", "left")
    vector = F.when(F.col("_mean").isNull(), F.col("embedding")).otherwise(V.unit(V.blend(F.col("embedding"), F.col("_mean"), alpha)))
    return out.select("term", vector.alias("vector"), F.coalesce("n_hypernyms", F.lit(0)).cast("long").alias("n_hypernyms"))
