"""Graphs: nodes of domains and terms, edges of similarity and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators.similarity import above


def domain_nodes(terms: DataFrame) -> DataFrame:
    """`id, label, type, parent` of the domains."""
    d = F.col("domain").cast("string")
    return terms.select(d.alias("id"), d.alias("label"), F.lit("domain").alias("type"), F.lit(None).cast("string").alias("parent")).distinct()


def term_nodes(terms: DataFrame, order: str = "term") -> DataFrame:
    """Nodes of terms, numbered from 0 in their domain: `{domain}_term_{i}`. A domain's terms are in its picture, so
    numbering them in one place is bounded by what is drawn."""
    i = F.row_number().over(W.partitionBy("domain").orderBy(order)) - 1
    d = F.col("domain").cast("string")
    return terms.select(F.concat(d, F.lit("_term_"), i.cast("string")).alias("id"), F.col("term").cast("string").alias("label"), F.lit("term").alias("type"), d.alias("parent"))


def similarity_edges(pairs: DataFrame, threshold: float, rounded: bool = True) -> DataFrame:
    """`source, target, weight, type` of the pairs whose unrounded score reaches the threshold."""
    kept = above(pairs, threshold) if rounded else pairs.filter(F.col("score") >= threshold)
    return kept.select(F.col("domain1").cast("string").alias("source"), F.col("domain2").cast("string").alias("target"), F.col("score").alias("weight"), F.lit("similarity").alias("type"))


def membership_edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'term'").select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit(1.0).alias("weight"), F.lit("belongs_to").alias("type"))


def detailed(terms: DataFrame, pairs: DataFrame, threshold: float, show_terms: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; with terms, each belongs to its domain. Similarity edges are not rounded. Leaving terms out
    changes the picture only, never the scores."""
    nodes, edges = domain_nodes(terms), similarity_edges(pairs, threshold, rounded=False)
    if show_terms:
        own = term_nodes(terms)
        nodes, edges = nodes.unionByName(own), edges.unionByName(membership_edges(own))
    return nodes, edges


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`domains, terms, similarity_edges`."""
    n = nodes.agg(F.count_if(F.col("type") == "domain").alias("domains"), F.count_if(F.col("type") == "term").alias("terms"))
    return n.join(edges.agg(F.count_if(F.col("type") == "similarity").alias("similarity_edges")))  # of one row each
