"""Best-fit packing by hierarchical residual packing.

Pieces of documents are items. Each partition packs its own by best fit, largest first, and emits the bins that are
nearly full or that no other needs: of two open bins over half full no two fit together, so no more of them can be
of use than there are bins up to half full. The rest become items themselves, with what they hold as their size; these
are merged a few partitions at a time, up a tree, and packed by best fit again, until one partition holds the last
underfull bins. A piece's place is the sum of the offsets on its way up. Partitions are dealt by a hash and sorted before packing, so a task that runs
again packs alike, and each round is checkpointed.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, checkpointed, crc32, parts_for, read_table, release
from kindred.llm.words import MEMORY, word_tokenizer

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 4096, 1
#: Items of a partition, partitions merged at a time, and the free tokens up to which a bin is emitted.
ITEMS, FAN, NEARLY = 50_000, 8, 8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, share: bool = True) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, ids`: documents as token ids with `end` appended; those longer than
    `capacity` are cut. `ids` are little-endian unsigned 32-bit numbers. A null text counts as empty.
    memory: distinct words that a worker remembers, and share: whether for its next tasks too; neither changes a
    result."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_tokenizer(tokenizer, memory)
        for batch in batches:
            keys, found = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, words.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity].tobytes()
                    found.append((key, at // capacity, at, len(part) // 4, crc32(part), part))
            if found:
                columns = list(zip(*found, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        if not share:
            words.clear()
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken as they come: each goes to the fullest bin that has room for it."""
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what is free
    levels: list[int] = []  # the sizes of free space that some bin has
    opened = 0
    for i, size in enumerate(sizes.tolist()):
        at = bisect_left(levels, size)
        if at < len(levels):
            room = levels[at]
            where = free[room].pop()
            if not free[room]:
                levels.pop(at)
        else:
            room, where = capacity, opened
            opened += 1
        bins[i], offsets[i] = where, capacity - room
        left = room - size
        if left:
            if not free[left]:
                insort(levels, left)
            free[left].append(where)
    return bins, offsets


def most_held(counts: dict[int, int], capacity: int) -> int:
    """What an open bin may hold so as to be merged further; `counts` says how many bins hold how much.

    A bin that has no room for the least full one is done. Each merge takes a bin of at most half the capacity, so of
    those that hold more only as many can be filled up as there are such small ones: the ones with most room."""
    room = capacity - min(counts, default=capacity)
    small, large = sum(n for held, n in counts.items() if 2 * held <= capacity), 0
    for held in sorted(h for h in counts if 2 * h > capacity):
        if large >= small:
            return min(room, held - 1)
        large += counts[held]
    return room


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = ITEMS) -> DataFrame:
    """`item, sequence_id, offset` for `items` (`item` long, unique; `length` long, 1 to `capacity`)."""
    spark = items.sparkSession
    n = items.count()
    parts = parts_for(n, per_partition)
    level = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"))
    step, moves = 0, []

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins, offsets = best_fit(group["length"].to_numpy(), capacity)
        held = np.bincount(bins, weights=group["length"]).astype(np.int64)
        return pd.DataFrame({"item": group["item"], "bin": group["part"].to_numpy().astype(np.int64) << 32 | bins, "offset": offsets, "held": held[bins], "part": group["part"]})

    while True:
        found = checkpointed(level.groupBy("part").applyInPandas(packed, "item long, bin long, offset long, held long, part int"))
        moves.append(found)
        if parts == 1:
            break
        step, parts = step + 1, parts_for(parts, FAN)
        open_bins = found.filter(F.col("held") < capacity - NEARLY).filter("offset = 0")  # a bin's first item stands for it
        counts = {r["held"]: r["n"] for r in open_bins.groupBy("held").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
        open_bins = open_bins.filter(F.col("held") <= most_held(counts, capacity))
        level = open_bins.select(F.col("bin").alias("item"), F.col("held").alias("length"), F.floor(F.col("part") / FAN).cast("int").alias("part"))
    placed = moves[0].select("item", "bin", "offset", F.lit(0).alias("level"))
    for k, upper in enumerate(moves[1:], 1):
        up = checkpointed(upper.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("offset").alias("shift")))
        below = placed.filter(F.col("level") == k - 1).join(up, "bin", "left")
        moved = below.select("item", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), F.when(F.col("up").isNotNull(), k).otherwise(k - 1).alias("level"))
        placed = checkpointed(moved.unionByName(placed.filter(F.col("level") < k - 1)))
    return placed.select("item", (F.col("bin") * 64 + F.col("level")).alias("sequence_id"), "offset")


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", per_partition: int = ITEMS, memory: int = MEMORY, share: bool = True) -> DataFrame:
    """The rows of `pieces` with `sequence_id` and `offset`: sequences of at most `capacity` tokens without gaps.

    Repeated rows are packed as often as they come; null ids are packed too; pieces of one length are packed in order
    of where they lie; an empty table gives an empty result; columns other than the id and the text are ignored,
    whatever their names.
    keep_ids=False leaves the ids out, so that texts do not travel.
    """
    cut = pieces(docs, tokenizer, capacity, end, id_col, text_col, memory, share)
    cut = checkpointed((cut if keep_ids else cut.drop("ids")).withColumn("item", F.monotonically_increasing_id()))
    places = checkpointed(pack(cut.select("item", "length"), capacity, per_partition))
    return cut.join(places, "item").drop("item")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
