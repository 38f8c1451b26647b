"""SimHash near-duplicates, linked by a grid range join over segment popcounts.

A fingerprint is cut into segments and mapped to the vector of its segments' bit counts. Flipping one bit moves
that vector by one step, so the Manhattan distance of two vectors never exceeds the Hamming distance of their
fingerprints. Vectors at distance two or less have a common point at distance one or less of both; the range join
therefore lists each distinct fingerprint in the cells within one step of its own and joins on cells. Candidates are
verified on all 64 bits.

A cell with more than `HOT_CELL` fingerprints is refined: its fingerprints are cut into other segments, and list the
cells of that grid too, within the first. Any two bits share a segment in one of the three grids at most, so what is
still together in the last has few pairs that are no links. A fingerprint has 2,080 links at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import attached, bounded_batches, checkpointed, read_table, release
from kindred.llm.components import smallest_reachable

#: Bits of a segment; a segment's count is 0 to this.
SEGMENT_BITS = 4
#: The segment of each bit in each grid: neighbouring bits, bits 16 apart, and diagonals of the two.
GRIDS = [[bit // 4 for bit in range(64)], [bit % 16 for bit in range(64)], [(bit // 4 + 4 * (bit % 4)) % 16 for bit in range(64)]]
#: Fingerprints of a cell up to which the cell's pairs are verified one by one; beyond, the next grid refines it.
HOT_CELL = 24
#: Differing bits of a link. The grids' steps rest on two.
MAX_BITS = 2


def simhash(text: bytes, words: int) -> int:
    """The unsigned 64-bit fingerprint: each bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    found = text.lower().split()  # of bytes: A-Z only, and at ASCII white space only
    if not found:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    hashes = np.fromiter((digest(join(s), 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fp` (the fingerprint's 64 bits as a signed long), a row for each row of `docs`.

    A null text counts as empty; a text without words has fingerprint 0. Other columns of `docs` are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash((t or "").encode(), words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def grid_cells(fps: DataFrame, grid: int = 0) -> DataFrame:
    """`fps` with `cell{grid}`: a row for the cell of each fingerprint's popcount vector and for those one step away."""
    base, steps, own = SEGMENT_BITS + 1, [], F.lit(0).cast("long")
    for i in range(64 // SEGMENT_BITS):
        mask = sum(1 << bit for bit in range(64) if GRIDS[grid][bit] == i)
        count = F.bit_count(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        own = own + count.cast("long") * F.lit(base**i)
        steps += [F.when(count < SEGMENT_BITS, F.lit(base**i)), F.when(count > 0, F.lit(-(base**i)))]
    cells = fps.select("*", own.alias("_own"), F.array_compact(F.array(F.lit(0).cast("long"), *steps)).alias("_steps"))
    return cells.select(*fps.columns, "_own", F.explode("_steps").alias("_step")).select(*fps.columns, (F.col("_own") + F.col("_step")).alias(f"cell{grid}"))


def links(fps: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """`a, b`: the pairs of distinct fingerprints in `fps` that differ by at most `MAX_BITS` bits, a < b."""
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    live, keys, found = fps.select("fp"), [], None
    for grid in range(len(GRIDS)):
        cells, keys = grid_cells(live, grid), [*keys, f"cell{grid}"]
        filled = checkpointed(cells.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"))
        met = checkpointed(attached(cells, filled, *keys, count="n"))
        cold = met if grid == len(GRIDS) - 1 else met.filter(F.col("n") <= hot_cell)
        sides = (cold.select(*keys, F.col("fp").alias(side)) for side in "ab")
        pairs = next(sides).join(next(sides), keys).filter((F.col("a") < F.col("b")) & (differ <= MAX_BITS)).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        live = met.filter(F.col("n") > hot_cell).select("fp", *keys)
        if live.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fp, component_id`: a row for each row of `docs`; component_id is the smallest doc_id reachable over
    links of at most two differing bits, itself included.

    Null ids never become a component_id unless a component has no other id; repeated rows share a component; an
    empty table gives an empty result; columns other than the id and the text are ignored, whatever their names.
    """
    fps = checkpointed(fingerprints(docs, words, id_col, text_col))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = smallest_reachable(links(nodes.select("fp")))
    grouped = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    grouped = checkpointed(grouped)
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    known = checkpointed(attached(grouped, checkpointed(least), "label").select("fp", "component_id"))
    return attached(fps, known, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
