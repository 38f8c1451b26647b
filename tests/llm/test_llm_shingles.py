"""Near copies found by their shingles, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import shingles


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(words) for _ in range(40))
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(120, 400))]
        out.append(" ".join(base) + " " + common)
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(max(1, len(near) // 90)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near) + " " + common)
    return [*out, "", "one", "one", "two words", "three short words"]


def cosine(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0


def test_similar_pairs(spark):
    texts = made(1)
    sets = [set(shingles.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    wanted = {(a, b) for b in range(len(texts)) for a in range(b) if cosine(sets[a], sets[b]) >= 0.8}
    found = shingles.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {(r["a"], r["b"]) for r in found.collect()}
    assert len(wanted) > 20 and rows <= wanted and parts(rows, len(texts)) == parts(wanted, len(texts))


def test_shingles_of_few_words():
    assert len(shingles.shingle_hashes(b"a b", 5)) == 1 and np.array_equal(shingles.shingle_hashes(b"", 5), [])


def test_maps_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (0, 5, 300, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 4 :], rng.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)])
        differ = sum(int(x).bit_count() for x in (shingles.parity_map(a) ^ shingles.parity_map(b)).view("<u8"))
        assert differ <= n // 4 + n // 3 + 1 and (n != 300 or differ > 100)


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_maps_of_long_texts_rule_out_those_not_alike(spark, similarity):
    """Maps grow with the texts, so texts of thousands of shingles that share a third are told apart; the wider is folded."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 12_000).astype(np.uint64)
    sides = [(pool[:n], pool[n - shared : n - shared + m]) for n, m, shared in ((6000, 6000, 2000), (4000, 4200, 1400), (4200, 4000, 3900), (400, 600, 300), (5, 6, 5), (1200, 300, 300))]
    sides = sides[: 6 if similarity == 0.5 else 5]  # sizes of the last one are too far apart for 0.8
    maps = [[shingles.parity_map(x, shingles.map_words(len(x))).tolist() for x in side] for side in sides]
    frame = spark.createDataFrame([(i, *m) for i, m in enumerate(maps)], "i int, a array<long>, b array<long>")
    found = [r["n"] for r in frame.select("i", shingles.differing(F.col("a"), F.col("b"), similarity).alias("n")).orderBy("i").collect()]
    for (a, b), n in zip(sides, found, strict=True):
        assert n <= len(np.setxor1d(a, b))
    ruled_out = [n > len(a) + len(b) - 1.6 * (len(a) * len(b)) ** 0.5 for (a, b), n in zip(sides, found, strict=True)]
    assert ruled_out[:3] == [True, True, False]


def test_the_sample_grows_with_the_texts():
    assert shingles.sampled(0) == shingles.sampled(8192) == 1 and shingles.sampled(50_000) == 6
    assert shingles.sampled(10**6) == shingles.sampled(10**8) == shingles.ONE_IN


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95, 1.0])
def test_prefixes_of_sets_alike_meet(similarity):
    rng = random.Random(2)
    for _ in range(3000):
        n, m = rng.randrange(1, 40), rng.randrange(1, 40)
        both = rng.randrange(0, min(n, m) + 1)
        if both < similarity * (n * m) ** 0.5 - 1e-9:
            continue
        order = list(range(n + m - both))
        rng.shuffle(order)
        a, b = order[:n], order[n - both :]
        assert set(sorted(a)[: shingles.prefix_length(n, similarity)]) & set(sorted(b)[: shingles.prefix_length(m, similarity)])


def test_nothing_to_compare(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert shingles.similar_pairs(rows).count() == 0
    assert shingles.similar_pairs(rows.limit(0)).count() == 0


def parts(pairs, n):
    """The smallest member of each one's component."""
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def components_match(spark, texts):
    """The number of pairs alike, and of components with two members or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    wanted = [(a, b) for b in range(len(texts)) for a in range(b) if cosine(sets[a], sets[b]) >= 0.8]
    found = shingles.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = [(r["a"], r["b"]) for r in found.collect()]
    assert set(rows) <= set(wanted)
    assert parts(rows, len(texts)) == parts(wanted, len(texts))
    return len(wanted)


def edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(base)), edits):
        out[at] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_copies_of_one_text_near_the_limit(spark):
    rng = random.Random(5)
    for size, edits in ((300, 7), (600, 13)):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        assert components_match(spark, [edited(rng, base, edits) for _ in range(80)]) > 50


def test_short_copies(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 61))]
        texts += [" ".join(base), " ".join(base[:-1] + ["end"]) if rng.random() < 0.5 else edited(rng, base, 1)]
    assert components_match(spark, texts) > 100


def test_repeated_passages_are_no_length(spark):
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(20)]
    assert components_match(spark, [t for b in bases for t in (" ".join(b), " ".join(b + b[-100:] * 4))]) == 20


def test_a_key_of_very_many_texts_is_split(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PART_ROWS", 10)
    rng = random.Random(8)
    line = [f"c{i}" for i in range(30)]
    texts = [" ".join(line + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 12))]) for _ in range(60)]
    assert components_match(spark, texts) > 100


def test_five_hundred_planted_copies(spark):
    """Copies with one word in sixty changed, from a hundred texts: all are found."""
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 260))] for _ in range(100)]
    texts = [" ".join(b) for b in bases] + [edited(rng, b, len(b) // 60) for b in bases for _ in range(5)]
    assert components_match(spark, texts) > 500


def test_a_star_of_copies_amid_texts_with_its_passage(spark):
    """Copies alike to their original only, which has no small id, and texts that share most words but are not alike."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(120):
        near = list(base)
        for at in rng.sample(range(60), 2):
            near[at] = f"x{k}-{at}"
        texts.append(" ".join(near))
        texts.append(" ".join(base[:44] + [f"y{k}-{i}" for i in range(rng.randrange(8, 24))]))
    texts.insert(150, " ".join(base))
    sets = [set(shingles.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    wanted = {(a, b) for b in range(len(texts)) for a in range(b) if cosine(sets[a], sets[b]) >= 0.8}
    found = shingles.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {(r["a"], r["b"]) for r in found.collect()}
    assert rows <= wanted and parts(rows, len(texts)) == parts(wanted, len(texts))


def keyed_rows(spark, sizes, at):
    rows = [(i, size, at, 7, i) for i, size in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, size int, at int, key long, label long")


def joined_rows(frame):
    """Rows that the join itself makes, before the filters after it."""
    found = []
    original = shingles.needed
    try:
        shingles.needed = lambda a, b, similarity: F.lit(-1.0)
        found = frame()
    finally:
        shingles.needed = original
    return found.count()


def test_a_shared_passage_that_is_too_short_joins_nothing(spark):
    """5,000 texts share 70 of 100 shingles: the passage's keys come after 30 others, so none can reach 0.8."""
    rows = keyed_rows(spark, [100 + i % 7 for i in range(5_000)], 30)
    assert joined_rows(lambda: shingles.met(rows, rows, 0.8, False)) <= 20 * 5_000
    hubs = rows.filter("doc_id < 8")
    assert joined_rows(lambda: shingles.met(hubs, rows, 0.8, True)) <= 20 * 5_000
    assert shingles.met(rows, rows, 0.8, False).count() == 0


def test_bands_lose_no_pair_that_the_bounds_allow(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(1, 90)) for i in range(160)]
    rows = [(i, size, rng.randrange(0, size), rng.randrange(3), i) for i, size in rows]
    frame = spark.createDataFrame(rows, "doc_id long, size int, at int, key long, label long")
    wanted = set()
    for a, n, p, k, _ in rows:
        for b, m, q, j, _ in rows:
            need = 0.8 * (n * m) ** 0.5 - 1e-6
            if a < b and k == j and min(n - p, m - q) >= need and min(n, m) >= need:
                wanted.add((a, b))
    assert wanted and {tuple(r) for r in shingles.met(frame, frame, 0.8, False).collect()} == wanted
    hubs = frame.filter("doc_id % 5 = 0")
    assert {tuple(r) for r in shingles.met(hubs, frame, 0.8, True).collect()} == {(a, b) for a, b in wanted if a % 5 == 0 or b % 5 == 0}
