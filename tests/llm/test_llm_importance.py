"""Importance resampling against a plain version, and its odd rows."""

import math
import random
import re
import zlib
from hashlib import sha256

from oracle import compare

from kindred.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, most, buckets, percent, least, seed="2024"):
    def features(text):
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for totals, texts in ((s, [d for _, d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                totals[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for id_, text in docs:
        n, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(sha256(f"{seed}:{id_}".encode()).hexdigest()[:8], 16)
        rows.append([id_, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(order[: percent * len(order) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Ünder", "x1", "7", "naïve", "日本", "And", *(f"w{i}" for i in range(60))]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_words_and_pairs_equal_the_plain_version(spark):
    docs, target = made(1, 300), [t for _, t in made(2, 40)]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    for most in (1, 2):
        assert found(I.resampled(frame, wanted, most, 500, 30, 10)) == plain(docs, target, most, 500, 30, 10)


def test_the_head_only_saves_work(spark):
    docs, target = made(5, 120), [t for _, t in made(6, 20)]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for n_words, n_pairs in ((1, 1), (5, 3), (1000, 0)):
        assert found(I.resampled(frame, wanted, 2, 200, 50, 5, n_words=n_words, n_pairs=n_pairs)) == plain(docs, target, 2, 200, 50, 5)


def test_slices_cut_no_word():
    text = b"Alpha beta,gamma " * 50 + "naïve".encode() * 40
    head = I.head_of([b"alpha"], [], 97)
    whole = [b for _, f in I.features(iter([[w for ws in I.letter_words(text) for w in ws]]), head, 2, 97) for b in f.tolist()]
    cut = [b for _, f in I.features(I.letter_words(text, 13), head, 2, 97) for b in f.tolist()]
    assert sorted(whole) == sorted(cut) and len(whole) == 2 * 151 - 1


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "one " * 30, 5), (3, "one " * 30, 5), (None, "two " * 25, 1), (None, "two " * 25, 2), (4, "b" * 2_000_000 + " c" * 40, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score long")
    out = I.resampled(frame, spark.createDataFrame([("one",)], "text string"), percent=100).collect()
    assert len(out) == 7 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5]
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["rank"]) for r in out if r["doc_id"] in (1, 2)} == {1: (0, 0, None), 2: (0, 0, None)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.resampled(none, frame.select("text")).collect() == []
    assert len(I.resampled(frame, none.select("text")).collect()) == 7


def test_query_equals_sql(spark, folder):
    compare(spark, folder, I.op11_importance_resampling, I.OP11_SQL)
