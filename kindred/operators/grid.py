"""All pairs of two frames without a product join: a grid of cells.

Rows of one side are dealt to the grid's rows, those of the other to its columns. Each goes once to each cell of its row or
column, by the cell's key, in one shuffle, and a cell is worked off in Arrow batches. `best` keeps the running best of
each row of the first side; `products` gives every pair of a frame with itself, each pair of blocks once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators.ranks import placed
from kindred.stores.lineage import kept

#: Scores this near may tie when they are rounded to nine places.
NEAR = 1e-8

#: What a cell makes of its first side, and the scores (rows by columns) that this and a batch of the other side give.
Prepare = Callable[[pa.Table], object]
Score = Callable[[object, pa.RecordBatch], np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spread(features: pa.Array, weights: pa.Array, known: np.ndarray) -> np.ndarray:
    """Sparse rows (lists of feature numbers and weights) as a matrix over the sorted features `known`; others are left
    out."""
    flat, values = features.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(features)), np.diff(features.offsets.to_numpy()))
    out = np.zeros((len(features), len(known)))
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        met = known[at] == flat
        out[rows[met], at[met]] = values[met]
    return out


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column as one array that begins at its buffers' begin, so that offsets count from 0."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return pa.concat_arrays([*chunks, pa.array([], column.type)])


def cells_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Rows in order of `row, column, side`, cut where one of these changes: the cell, the side, and `size` rows at most."""
    for whole in batches:
        for batch in (whole.slice(i, size) for i in range(0, whole.num_rows, size)):
            keys = np.stack([batch.column(c).to_numpy() for c in ("row", "column", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield (int(keys[a, 0]), int(keys[a, 1])), int(keys[a, 2]), batch.slice(a, b - a)


class Running:
    """The best `most` of each row so far, in order of score, then of arrival. Scores that agree in nine places tie."""

    def __init__(self, most: int):
        self.most, self.ids, self.scores = most, None, None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Once `most` are known, only what reaches the worst of them is looked at."""
        if self.scores is not None and self.scores.shape[1] == self.most:
            rows, columns = np.nonzero(scores >= self.scores[:, -1:] - NEAR)
            if not len(rows):
                return
            n = len(scores)
            rows, arrival = np.concatenate([np.repeat(np.arange(n), self.most), rows]), np.concatenate([np.tile(np.arange(self.most), n), self.most + columns])
            values, known = np.concatenate([self.scores.ravel(), scores[rows[n * self.most :], columns]]), np.concatenate([self.ids.ravel(), ids[columns]])
        else:
            known = np.broadcast_to(ids, scores.shape)
            if self.scores is not None:
                scores, known = np.hstack([self.scores, scores]), np.hstack([self.ids, known])
            least = np.partition(scores, -self.most, axis=1)[:, -self.most, None] if scores.shape[1] > self.most else -np.inf
            rows, arrival = np.nonzero(scores >= least - NEAR)
            values, known = scores[rows, arrival], known[rows, arrival]
        order = np.lexsort((arrival, -np.round(values, 9), rows))
        first = order[np.arange(len(rows)) - np.searchsorted(rows[order], rows[order]) < self.most]
        width = len(first) // (int(rows[first[-1]]) + 1) if len(first) else 0
        self.scores, self.ids = values[first].reshape(-1, width), known[first].reshape(-1, width)


def shape(n_rows: int, n_columns: int, parallelism: int, row: int, column: int) -> tuple[int, int]:
    """Rows and columns of a grid: rows so that a row's own fit a task, columns so that all cores work and a cell takes a
    bounded time. More columns make more answers to merge, more rows more copies of the other side."""
    rows = max(1, -(-n_rows // row))
    return rows, max(1, min(-(-n_columns // 1_000), max(-(-n_columns // column), -(-parallelism // rows))))


def pairs(left: DataFrame, right: DataFrame, block: int = 2_000) -> DataFrame:
    """Every row of `left` with every one of `right`, whose columns differ: rows and columns of blocks, joined by the key of
    their cell. Both are read twice, so they should be checkpoints or tables."""
    n, m = (max(1, -(-frame.count() // block)) for frame in (left, right))
    dealt = lambda frame, count: F.pmod(F.xxhash64(*frame.columns), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = left.withColumn("_row", dealt(left, n)).withColumn("_column", all_of(m))
    b = right.withColumn("_column", dealt(right, m)).withColumn("_row", all_of(n))
    return a.join(b.hint("shuffle_hash"), ["_row", "_column"]).drop("_row", "_column")


def best(asked: DataFrame, given: DataFrame, k: int, prepare: Prepare, score: Score, row: int, column: int, batch: int, others: bool = True) -> DataFrame:
    """`query, neighbour, score, place`: for each row of `asked` the k rows of `given` that score highest; with `others`
    those of another `term` only. Both are checkpoints or tables with `term`, once each, and the columns that `prepare`
    and `score` use. Ties go in order of term."""
    payload = [c for c in asked.columns if c != "term"]
    kind = dict(given.dtypes)["term"]
    n_rows, n_columns = shape(asked.count(), given.count(), asked.sparkSession.sparkContext.defaultParallelism, row, column)
    dealt = lambda count: F.pmod(F.xxhash64("term"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select(dealt(n_rows).alias("row"), all_of(n_columns).alias("column"), F.lit(0).alias("side"), "term", *payload)
    right = given.select(all_of(n_rows).alias("row"), dealt(n_columns).alias("column"), F.lit(1).alias("side"), "term", *payload)
    cells = left.unionByName(right).repartition(n_rows * n_columns, "row", "column").sortWithinPartitions("row", "column", "side", "term")
    most = k + 1 if others else k

    def run(batches):
        cell = names = None

        def answers():
            if names is not None and running.scores is not None:
                each = running.scores.shape[1]
                yield pa.record_batch([pa.array(np.repeat(np.array(names, dtype=object), each).tolist(), terms), pa.array(running.ids.ravel().tolist(), terms), pa.array(running.scores.ravel())], names=["query", "neighbour", "score"])

        for at, side, rows in cells_of(batches, batch):
            if at != cell:
                yield from answers()
                cell, names, waiting, running, terms = at, None, [], Running(most), rows.column("term").type
            if side == 0:
                waiting.append(rows)
                continue
            if names is None:
                if not waiting:
                    continue  # nothing is asked in this cell
                first = pa.Table.from_batches(waiting)
                names, own, waiting = first.column("term").to_pylist(), prepare(first), []
            ids = np.empty(rows.num_rows, dtype=object)
            ids[:] = rows.column("term").to_pylist()
            running.add(ids, score(own, rows))
        yield from answers()

    found = cells.mapInArrow(run, f"query {kind}, neighbour {kind}, score double")
    at = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "neighbour"))  # a few rows a column
    if not others:
        return found.withColumn("place", at).filter(F.col("place") <= k)
    first = found.withColumn("_at", at).filter(F.col("_at") <= k + 1).filter(F.col("neighbour") != F.col("query"))
    place = F.row_number().over(W.partitionBy("query").orderBy("_at"))
    return first.withColumn("place", place).filter(F.col("place") <= k).select("query", "neighbour", "score", "place")


def products(rows: DataFrame, prepare: Prepare, score: Score, block: int) -> DataFrame:
    """`term1, term2, score` for term1 < term2 of all rows, which have `term`, once each, and the columns that `prepare`
    and `score` use. Blocks follow the order of terms, so each pair of blocks is one cell. As many rows as there are pairs."""
    payload = [c for c in rows.columns if c != "term"]
    kind = dict(rows.dtypes)["term"]
    own = kept(placed(rows, "term").withColumn("_b", F.floor((F.col("place") - 1) / block).cast("int")).drop("place"))
    last = -(-own.count() // block) - 1
    left = own.select(F.col("_b").alias("row"), F.explode(F.sequence("_b", F.lit(max(last, 0)))).alias("column"), F.lit(0).alias("side"), "term", *payload)
    right = own.select(F.explode(F.sequence(F.lit(0), "_b")).alias("row"), F.col("_b").alias("column"), F.lit(1).alias("side"), "term", *payload)
    count = max(1, (last + 1) * (last + 2) // 2)
    cells = left.unionByName(right).repartition(count, "row", "column").sortWithinPartitions("row", "column", "side", "term")

    def run(batches):
        cell = None
        for at, side, found in cells_of(batches, block):
            if at != cell:
                cell, waiting, names = at, [], None
            if side == 0:
                waiting.append(found)
                continue
            if names is None:
                first = pa.Table.from_batches(waiting)
                names, own = first.column("term"), prepare(first)
            others, scores = found.column("term"), score(own, found)
            if at[0] == at[1]:
                a = pa.array(names.to_pylist(), others.type)
                order = {t: i for i, t in enumerate(a.to_pylist())}
                begin = order[others[0].as_py()]
                i, j = np.nonzero(np.arange(len(a))[:, None] < np.arange(begin, begin + len(others)))
            else:
                i, j = (x.ravel() for x in np.indices(scores.shape))
            yield pa.record_batch([one_array(names.take(pa.array(i))), others.take(pa.array(j)), pa.array(scores[i, j])], names=["term1", "term2", "score"])

    return cells.mapInArrow(run, f"term1 {kind}, term2 {kind}, score double")
