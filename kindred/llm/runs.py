r"""Periodic runs of words: stretches that repeat one phrase over and over.

The words of a batch of texts get integer names, each text's own and an end mark for each, and their suffixes are sorted by
prefix doubling, only those that still tie. Longest common prefixes of neighbours are found for the suffixes whose left
words differ and follow for the others. A bottom-up pass over the LCP-interval tree keeps, for each interval, its places in
order and in lists by left word. Two places of different children whose left words differ are a maximal pair: equal for
as many words as the interval is deep, and no further on either side. A maximal pair at a distance p that its depth
holds `exponent` - 1 times is a run of period p; nothing needs to be extended. The same run shows at multiples of its
period, and the smallest counts.

Places within half an interval's depth of each other lie in an arithmetic progression, and all but its first have the same
left word. So a place asks for its next neighbour, whose list it walks if the left word differs, and for its farthest one
before it; pairs of the same list are never looked at, and their number does not grow with the square of a group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, read_table, release
from kindred.llm.slices import blank_words

#: Rows of neighbouring suffixes compared at once, and words of kept text joined at once.
COMPARED, JOINED = 1 << 20, 1 << 16

#: Given an id and the number of its text's words, the numbers of the words it is read as; None: as it is.
Places = Callable[[int | None, int], "np.ndarray | None"]


def suffix_order(key: np.ndarray) -> np.ndarray:
    """The suffixes in an order that keeps equal beginnings together. Each text of `key` ends with a mark of its own."""
    n = len(key)
    order = np.argsort(key, kind="stable").astype(np.int32)
    head = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    active, depth = np.flatnonzero(~(head & np.append(head[1:], True))), 1
    while len(active):
        at = order[active]
        pair = rank[at].astype(np.int64) * n + rank[at + depth]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[active] = at
        head = np.append(True, pair[1:] != pair[:-1])
        rank[at] = active[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        active, depth = active[~(head & np.append(head[1:], True))], 2 * depth
    return order


def equal_words(key: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many words two suffixes have in common, `depth` at least."""
    out = np.full(len(a), depth, dtype=np.int64)
    for begin in range(0, len(a), COMPARED):
        rows, width, off = np.arange(begin, min(begin + COMPARED, len(a))), 8, depth
        while len(rows):
            ahead = off + np.arange(width)
            same = key[np.minimum(a[rows, None] + ahead, len(key) - 1)] == key[np.minimum(b[rows, None] + ahead, len(key) - 1)]
            whole = same.all(axis=1)
            out[rows] += np.where(whole, width, same.argmin(axis=1))
            rows, off = rows[whole], off + width
            width = max(8, min(2 * width, COMPARED // max(1, len(rows))))
    return out


def common_prefixes(key: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes, by their place in `order`, that share `depth` words or more with the one before, and how many."""
    a, b = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    deep = np.flatnonzero(key[a] == key[b])
    for d in range(1, depth):
        deep = deep[key[a[deep] + d] == key[b[deep] + d]]
    by = deep[np.argsort(a[deep])]  # in order of the text
    i, j = a[by], b[by]
    own = left[i] != left[j]
    found = np.zeros(len(by), dtype=np.int64)
    found[own] = equal_words(key, i[own], j[own], depth)
    last = np.maximum.accumulate(np.where(own, np.arange(len(by)), 0)) if len(by) else np.zeros(0, dtype=np.int64)
    found = found[last] - (i - i[last])  # the same left word: one less than the suffix before
    back = np.argsort(by)
    return by[back] + 1, found[back]


class Interval:
    """The places of an LCP interval, in order and by left word."""

    __slots__ = ("order", "lists")

    def __init__(self, place: int, left: list[int]):
        self.order, self.lists = [place], {left[place]: [place]}

    def add(self, other: Interval) -> None:
        for place in other.order:
            insort(self.order, place)
        for word, places in other.lists.items():
            if word in self.lists:
                for place in places:
                    insort(self.lists[word], place)
            else:
                self.lists[word] = places


def maximal_pairs(a: Interval, b: Interval, reach: int, left: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs of a place in `a` and one in `b`, at most `reach` apart, whose left words differ. `reach` is at most half
    the depth of the interval that joins the two."""
    order = a.order
    for place in b.order:
        k = bisect_right(order, place)
        if k < len(order) and order[k] - place <= reach and left[order[k]] != left[place]:
            places = a.lists[left[order[k]]]
            for i in range(bisect_right(places, place), len(places)):
                if places[i] - place > reach:
                    break
                yield place, places[i]
        far = bisect_left(order, place - reach)
        if far < k and left[order[far]] != left[place]:
            yield order[far], place


def runs_of(key: np.ndarray, shortest: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """`start, length, period` of all runs of `shortest` words or more that hold their period `exponent` times or more, by
    start and period. `key`: the words of texts, each text's own integers, and after each text a mark of its own."""
    depth = min(max(shortest - p, (exponent - 1) * p) for p in range(1, shortest + 1))
    left = np.append(-1, key[:-1])  # a text's first word has the mark before it
    order = suffix_order(key)
    rows, common = common_prefixes(key, left, order, depth)
    found: dict[tuple[int, int], int] = {}
    if not len(rows):
        return []
    places, before, depths, at = order[rows].tolist(), order[rows - 1].tolist(), common.tolist(), rows.tolist()
    lefts = left.tolist()

    def joined(a: Interval, b: Interval, lcp: int) -> Interval:
        if len(a.order) < len(b.order):
            a, b = b, a
        for i, j in maximal_pairs(a, b, lcp // (exponent - 1), lefts):
            if lcp + j - i >= shortest:
                run = (i, lcp + j - i)
                found[run] = min(found.get(run, j - i), j - i)
        a.add(b)
        return a

    stack: list[tuple[int, Interval]] = []  # what is to be joined with what follows, and at which depth
    current = Interval(before[0], lefts)
    for k, lcp in enumerate(depths):
        if k and at[k] != at[k - 1] + 1:  # another subtree of the root
            while stack:
                d, top = stack.pop()
                current = joined(top, current, d)
            current = Interval(before[k], lefts)
        while stack and stack[-1][0] > lcp:
            d, top = stack.pop()
            current = joined(top, current, d)
        if stack and stack[-1][0] == lcp:
            current = joined(stack.pop()[1], current, lcp)
        stack.append((lcp, current))
        current = Interval(places[k], lefts)
    while stack:
        d, top = stack.pop()
        current = joined(top, current, d)
    return sorted((start, length, period) for (start, length), period in found.items())


class Batch:
    """Texts by their words' numbers: `words` by number, the key of `runs_of`, and where each text begins in it."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], places: Places | None):
        number: dict[bytes, int] = {}
        parts = []
        for id_, text in zip(ids, texts, strict=True):
            own = [np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)) for words in blank_words(text or b"")]
            found = np.concatenate(own) if own else np.zeros(0, dtype=np.int32)
            wanted = places(id_, len(found)) if places else None
            parts.append(found if wanted is None else found[wanted])
        self.words, self.parts = list(number), parts
        self.begin = np.cumsum([0, *(len(p) + 1 for p in parts)])

    def key(self) -> np.ndarray:
        """Numbers that differ between texts, each text followed by its mark."""
        kinds = len(self.words) + 1
        out = np.empty(int(self.begin[-1]), dtype=np.int64)
        for k, part in enumerate(self.parts):
            out[self.begin[k] : self.begin[k + 1] - 1] = part
            out[self.begin[k + 1] - 1] = kinds - 1
            out[self.begin[k] : self.begin[k + 1]] += k * kinds
        return out

    def collapsed(self, k: int, runs: list[tuple[int, int, int]]) -> bytes:
        """The words of a text, those of each run after its first period left out, joined by spaces."""
        part = self.parts[k]
        if runs:
            edges = np.zeros(len(part) + 1, dtype=np.int32)
            for start, length, period in runs:
                edges[start + period] += 1
                edges[start + length] -= 1
            part = part[np.cumsum(edges[:-1]) == 0]
        return b" ".join(b" ".join([self.words[w] for w in part[i : i + JOINED].tolist()]) for i in range(0, len(part), JOINED))


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, exponent: int = 4, places: Places | None = None) -> DataFrame:
    """`doc_id, n_words, runs, collapsed`: a row for each row of `docs`. `runs`: `start, length, period` of each run in
    words, by start, then period; `collapsed`: the words joined by one space, without those that a run repeats.

    Words stand between white space of ASCII. A run is a stretch of at least `shortest` words that holds its smallest
    period at least `exponent` times (3 or more) and that no neighbouring word extends; runs may overlap. A null or empty
    text has no words, no runs and an empty `collapsed`. Rows are judged each by itself, so repeated rows and null ids
    are like any other, and an empty table gives an empty result; other columns are ignored. A long text takes memory for
    its distinct words and some numbers for each of its words.
    """
    if exponent < 3:
        raise ValueError("exponent is 3 or more")
    bounded_batches(docs.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            own = Batch(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), places)
            by_text: list[list[tuple[int, int, int]]] = [[] for _ in own.parts]
            if own.parts:
                found = runs_of(own.key(), shortest, exponent)
                for (start, length, period), k in zip(found, (np.searchsorted(own.begin, [s for s, _, _ in found], side="right") - 1).tolist(), strict=True):
                    by_text[k].append((start - int(own.begin[k]), length, period))
            flat = [r for runs in by_text for r in runs]
            fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            offsets = np.cumsum([0, *map(len, by_text)])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))
            texts = pa.array([own.collapsed(k, runs_) for k, runs_ in enumerate(by_text)], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(p) for p in own.parts], pa.int64()), runs, texts], names=["doc_id", "n_words", "runs", "collapsed"])
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = own.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where the query plants a repetition: in one text of ten, by the CRC of its id; a null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    words = np.arange(n)
    words[a:] = a + (words[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return words


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(read_table(spark, sf_dir, "documents"), places=planted)
    # of two runs the one with more periods goes first, then by start and period, as they come
    more = F.array_sort("runs", lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).otherwise(1))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", F.try_element_at(more, F.lit(1))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
