r"""Resampling of documents by how likely their words are in a target set of texts.

Features are runs of one or two words, hashed into buckets by CRC-32. Words are counted over all documents, and the most
frequent ones, the head, are broadcast with their CRC states: after the word, and after the word and a space. The most
frequent pairs of them are broadcast with their buckets. A feature of the head is looked up; any other takes the CRC of
its bytes, a pair going on from its first word's state where the head has it. The head only saves work: the totals of the
buckets are exact whatever it holds.

The totals of documents and target give each bucket a gain, a document weighs the floored mean of its features' gains,
and a Gumbel number drawn from its id is added. Of the documents that are long enough, those with the highest scores are
drawn: sampling without replacement in proportion to the exponentials of the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, checkpointed, forget, read_table, release
from kindred.llm.slices import letter_words
from kindred.operators.ranks import placed

#: Words and pairs of the head, and bytes of the longest word in it: what is broadcast is bounded by them.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 32_768, 65_536, 64
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000


@dataclass
class Head:
    """Frequent words by number, their CRC states after the word (`full`) and after a space as well (`spaced`), and
    frequent pairs of their numbers (first * number of words + second, sorted) with their buckets."""

    words: dict[bytes, int]
    full: np.ndarray
    spaced: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for those of the tail."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def head_of(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> Head:
    number = {w: i for i, w in enumerate(words)}
    full = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    spaced = np.array([zlib.crc32(b" ", int(s)) for s in full], dtype=np.int64)
    keys = np.array([number[a] * len(words) + number[b] for a, b in pairs], dtype=np.int64)
    found = np.array([zlib.crc32(b, int(spaced[number[a]])) % buckets for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys)
    return Head(number, full, spaced, keys[order], found[order])


def features(lists: Iterator[list[bytes]], head: Head, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each list of a text's words, how many they are and the buckets of the features that end in it."""
    last: list[bytes] = []
    for words in lists:
        fresh = len(words)
        if not fresh:
            continue
        words = last + words
        numbers = head.numbers(words)
        known = numbers >= 0
        states = np.zeros(len(words), dtype=np.int64)
        states[known] = head.full[numbers[known]]
        for i in np.flatnonzero(~known).tolist():
            states[i] = zlib.crc32(words[i])
        found = [states[len(last) :] % buckets]
        if most == 2 and len(words) > 1:
            a, b = numbers[:-1], numbers[1:]
            out = np.full(len(a), -1, dtype=np.int64)
            both = np.flatnonzero((a >= 0) & (b >= 0))
            if len(both) and len(head.pairs):
                keys = a[both] * len(head.words) + b[both]
                at = np.minimum(np.searchsorted(head.pairs, keys), len(head.pairs) - 1)
                hit = head.pairs[at] == keys
                out[both[hit]] = head.pair_buckets[at[hit]]
            for i in np.flatnonzero(out < 0).tolist():
                state = int(head.spaced[a[i]]) if a[i] >= 0 else zlib.crc32(b" ", int(states[i]))
                out[i] = zlib.crc32(words[i + 1], state) % buckets
            found.append(out)
        last = words[-1:] if most == 2 else []
        yield fresh, np.concatenate(found)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for text in batch.column("text"):
            yield text.as_py() or b""


def counted(texts: DataFrame, kind: str, keys_of, fields: str) -> DataFrame:
    """The sums of what `keys_of` counts in texts, handed on by a task at its end and whenever there is much."""
    schema = pa.schema([(name, {"binary": pa.binary(), "long": pa.int64()}[kind]) for name in fields.split()] + [("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()

        def rows():
            columns = zip(*counts) if len(schema) > 2 else [counts]
            out = pa.record_batch([*(pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=False)), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for text in texts_of(batches):
            for words in letter_words(text):
                counts.update(keys_of(words))
                if len(counts) > COUNTED:
                    yield rows()
        if counts:
            yield rows()
        release()

    names = fields.split()
    return texts.mapInArrow(run, ", ".join(f"{n} {kind}" for n in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int, *keys: str) -> list:
    """The `most` rows with the largest `n`, of equal ones the first by key. How many rows there are by the power of two
    that `n` reaches comes first, so that only rows of the powers that are needed are sent and sorted."""
    counts = checkpointed(counts.filter("n > 1"))
    powers = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("power")).agg(F.count("*").alias("rows")).orderBy(F.desc("power")).collect()  # 64 at most
    known, least = 0, 0
    for r in powers:
        known, least = known + r["rows"], r["power"]
        if known >= most:
            break
    return counts.filter(F.col("n") >= F.lit(2**least)).orderBy(F.desc("n"), *keys).limit(most).collect()


def fit_head(texts: DataFrame, most: int, buckets: int, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The head of the texts, by counts over all of them: its words, and pairs of those words."""
    often = counted(texts, "binary", lambda words: [w for w in words if len(w) <= HEAD_BYTES], "word")
    words = [bytes(r["word"]) for r in most_frequent(often, n_words, "word")]
    pairs: list[tuple[bytes, bytes]] = []
    if most == 2 and words:
        known = texts.sparkSession.sparkContext.broadcast(frozenset(words))
        of_two = counted(texts, "binary", lambda words: [(a, b) for a, b in zip(words, words[1:], strict=False) if a in known.value and b in known.value], "a b")
        pairs = [(bytes(r["a"]), bytes(r["b"])) for r in most_frequent(of_two, n_pairs, "a", "b")]
    return head_of(words, pairs, buckets)


def bucket_totals(texts: DataFrame, head, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket. `head`: a broadcast `Head`."""

    def run(batches):
        totals = np.zeros(buckets, dtype=np.int64)
        for text in texts_of(batches):
            for _, found in features(letter_words(text), head.value, most, buckets):
                totals += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(used), pa.array(totals[used])], names=["bucket", "n"])
        release()

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the source, each count raised by one,
    floored."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, head, gain: np.ndarray, most: int) -> DataFrame:
    """`doc_id, n_words, n_features, weight` of `doc_id, text` rows."""
    buckets = len(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n = features_ = total = 0
                for fresh, found in features(letter_words(text.as_py() or b""), head.value, most, buckets):
                    n, features_, total = n + fresh, features_ + len(found), total + int(gain[found].sum())
                rows.append((n, features_, total // features_ if features_ else 0))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=names)
        release()

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str):
    """A Gumbel number times 1000, floored, from the id as text; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> DataFrame:
    """`doc_id, n_features, weight, score, rank`: a row for each row of `docs`. Features are all runs of 1 to `most` words
    (1 or 2); of the documents with `least` words or more, `percent` of a hundred are drawn, floored, by highest score,
    and have a rank from 1; ties go to the smaller id, null ids last. `n_words` and `n_pairs` bound the head.

    A null or empty text has no features and weighs 0. Rows that share an id share its noise; rows equal in score and id
    rank in any order. Texts are read in slices. An empty target or table of documents is fine; other columns are ignored.
    """
    if most not in (1, 2):
        raise ValueError("most is 1 or 2")
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    texts, wanted = own.select("text"), target.select(F.col(target_col).cast("string").cast("binary").alias("text"))
    head = spark.sparkContext.broadcast(fit_head(texts, most, buckets, n_words, n_pairs))
    forget(spark)
    gain = gains(bucket_totals(texts, head, most, buckets), bucket_totals(wanted, head, most, buckets))
    scored = checkpointed(weighed(own, head, gain, most).withColumn("score", F.col("weight") + noise(seed)))
    forget(spark)
    enough = F.col("n_words") >= least
    drawn = percent * scored.filter(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "_row"]
    ranked = placed(scored.filter(enough).withColumn("_row", F.monotonically_increasing_id()), *order, name="rank").drop("_row")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest.select("doc_id", "n_features", "weight", "score", "rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The CRC of each distinct word comes from a table of 256 entries, which is built from the polynomial.
OP11_SQL = r"""
WITH tab AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)
), dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), bw AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), dc AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM dw GROUP BY ALL), bc AS MATERIALIZED (SELECT w, count(*) AS n FROM bw GROUP BY ALL
), words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dc UNION SELECT w FROM bc)
), crcs AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM words, tab
), s AS (SELECT bucket, sum(n) AS n FROM dc JOIN crcs USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM bc JOIN crcs USING (w) GROUP BY 1
), g AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS gain
  FROM (SELECT bucket FROM s UNION SELECT bucket FROM t) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), f AS (
  SELECT d.doc_id, coalesce(x.n, 0)::BIGINT AS n_features, coalesce(floor(x.total / x.n), 0)::BIGINT AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, sum(n) AS n, sum(n * gain) AS total FROM dc JOIN crcs USING (w) JOIN g USING (bucket) GROUP BY 1) x USING (doc_id)
), sc AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM f
), rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)
"""
