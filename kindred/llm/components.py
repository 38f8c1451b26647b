"""Connected components of an edge table, by label propagation with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import attached, checkpointed, forget, gathered


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """`node, label` for each node of the undirected edges `a, b`; label: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, lowers the label of the label it had (hooking)
    and follows labels once more (jumping), so rounds grow with the logarithm of a component's width. Minima are
    aggregated in the map tasks first, and labels get back to their rows by `attached`, so neither a node with many
    edges nor a label that most nodes bear gathers its rows in one task. Each round is checkpointed, in as many parts as
    the edges are worth, and Spark drops what the rounds before it wrote.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    n = both.count()  # no fewer than there are nodes, labels or hooks
    both = gathered(both, n)
    labels = checkpointed(gathered(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), n))
    while True:
        seen = gathered(attached(both, labels.withColumnRenamed("node", "b"), "b"), n).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "seen").alias("seen"))
        lower = checkpointed(gathered(lower, n))
        hooks = checkpointed(gathered(lower.groupBy("label").agg(F.min("seen").alias("hook")), n))
        hooked = checkpointed(gathered(attached(lower, hooks, "label").select("node", "label", F.least("seen", "hook").alias("next")), n))
        ends = hooked.select(F.col("node").alias("next"), F.col("next").alias("end"))
        moved = checkpointed(gathered(attached(hooked, ends, "next").select("node", "label", F.least("next", "end").alias("next")), n))
        forget(edges.sparkSession)
        changed = moved.filter("next < label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
