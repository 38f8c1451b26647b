"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Entry (p, b) of the matrix says how many rows partition p sends to bucket b. For a uniform random permutation of all
rows, with the buckets' sizes fixed, the matrix is multivariate hypergeometric. It is drawn down a binary tree over the
partitions: a node holds the bucket sizes its partitions fill together and draws which of them its left half fills.
Each draw has its own seed, so a task draws its row alone, on one path, and draws it again alike; no matrix is gathered.
Partitions deal out their rows by a random permutation; the rows are exchanged by bucket, and each bucket permutes what
it receives, by sorting hashes of a seed and the places the rows came from. A shard is a run of buckets, so its slots
are known without one task holding the shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.common import checkpointed, parts_for, read_table

#: Shards of the query, rows of a bucket, and the seed.
SHARDS, BUCKET_ROWS, SEED = 40, 50_000, 2026


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` of `good + bad`. Beyond NumPy's limit of 10**9 the distribution is inverted around its
    mode, within 15 standard deviations."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    mode = (drawn + 1) * (good + 1) // (total + 2)
    reach = 15 * int(math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / total)) + 2)
    low, high = max(0, drawn - bad, mode - reach), min(good, drawn, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((drawn - k) / (bad - drawn + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    total_weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(total_weight, rng.random() * total_weight[-1], side="right"))


def split(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of each bucket's places `drawn` rows fill."""
    out, left = np.zeros_like(sizes), int(sizes.sum())
    for b, size in enumerate(sizes.tolist()):
        if drawn == 0:
            break
        out[b] = hypergeometric(rng, size, left - size, drawn)
        left -= size
        drawn -= int(out[b])
    return out


def matrix_row(counts: list[int], sizes: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the matrix for partitions of `counts` rows and buckets of `sizes`, which have equal sums."""
    low, high, here = 0, len(counts), sizes
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), here, sum(counts[low:middle]))
        low, high, here = (low, middle, left) if p < middle else (middle, high, here - left)
    return here


def runs(rows: int, shards: int, bucket_rows: int) -> list[tuple[int, int, int, int]]:
    """First shard, shards, rows of each and buckets of each, for the shards of one size: those with a row more first."""
    larger = rows % shards
    return [(first, n, own, parts_for(own, bucket_rows)) for first, n, own in ((0, larger, rows // shards + 1), (larger, shards - larger, rows // shards))]


def bucket_sizes(rows: int, shards: int, bucket_rows: int) -> np.ndarray:
    """Rows of each bucket, shard by shard; shards differ by one row at most, and so do a shard's buckets."""
    return np.concatenate([np.tile(own // per + (np.arange(per) < own % per), n) for _, n, own, per in runs(rows, shards, bucket_rows)]).astype(np.int64)


def place_of(bucket: Column, rows: int, shards: int, bucket_rows: int) -> tuple[Column, Column]:
    """A bucket's shard and the slot that it begins with."""
    (_, n, own, per), (first, _, own2, per2) = runs(rows, shards, bucket_rows)
    after = bucket - n * per
    slot = lambda at, own, per: at * (own // per) + F.least(at, F.lit(own % per))
    shard = F.when(after < 0, F.floor(bucket / per)).otherwise(F.floor(after / per2) + first)
    return shard.cast("int"), F.when(after < 0, slot(bucket % per, own, per)).otherwise(slot(F.pmod(after, F.lit(per2)), own2, per2)).cast("long")


def shuffled_shards(rows: DataFrame, shards: int, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), a uniform random permutation
    for each seed. Sizes of shards differ by one at most.

    Rows are dealt whatever they hold: nulls, repeated rows and equal texts count as rows. Fewer rows than shards
    leave the last shards empty; an empty table gives an empty result. Columns named `shard` or `slot` are replaced.
    The input is checkpointed, so that a task that runs again finds the same rows in the same order.
    """
    plain = rows.drop("shard", "slot")
    spark, names = plain.sparkSession, plain.columns
    kept = checkpointed(plain.select(F.spark_partition_id().alias("_part"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")))
    counts = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one for each partition
    place = {p: i for i, p in enumerate(sorted(counts))}
    ordered = [counts[p] for p in sorted(counts)]
    sizes = bucket_sizes(sum(ordered), shards, bucket_rows)
    shared = spark.sparkContext.broadcast((place, ordered, sizes))

    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to, at, own = None, 0, None
        for part in batches:
            if own is None and len(part):
                places, totals, wanted = shared.value
                own = int(part.iloc[0])
                row = matrix_row(totals, wanted, places[own], seed)
                to = np.random.default_rng([seed, 1, own]).permutation(np.repeat(np.arange(len(row)), row))
            yield pd.Series(to[at : at + len(part)] if own is not None else [], dtype="int64")
            at += len(part)

    @F.pandas_udf("long")
    def bucket(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from deal(batches)

    dealt = checkpointed(kept.select("_row", bucket("_part").alias("_bucket"), F.monotonically_increasing_id().alias("_at")))
    received = W.partitionBy("_bucket").orderBy(F.xxhash64("_at", F.lit(seed)), "_at")
    shard, slot = place_of(F.col("_bucket"), sum(ordered), shards, bucket_rows)
    return dealt.select("_row.*", shard.alias("shard"), (slot + F.row_number().over(received) - 1).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled_shards(rows, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
