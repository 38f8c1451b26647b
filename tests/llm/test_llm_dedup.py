"""Exact, near and passage dedup against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from oracle import compare
from pyspark.sql import functions as F

from kindred.llm import components, exact_dedup, simhash, suffix_dedup
from kindred.llm.suffix_array import Strings

DOCS = "doc_id long, text string, lang string, name string, cell string, fp string, row string, _chunk int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "n", "c", "f", "r", 7) for i, t in rows], DOCS)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta\t", "eta\n", "théta", "漢字", ","]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        if rng.random() < 0.4:
            t = t[: rng.randrange(len(t) + 1)] + passage[rng.randrange(40) :] + t
        out.append(t)
    for _ in range(n // 3):
        out.append(rng.choice(out))
    return out


# exact


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = {}
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0]))
        for i, _ in own:
            out[i] = (keep[0], len(own), i == keep[0], norm)
    return out


@pytest.mark.parametrize("block", [3, 64, 256])
def test_exact(spark, block, monkeypatch):
    monkeypatch.setattr(exact_dedup.identities, "__defaults__", ("doc_id", "text", None, block))
    rows = list(enumerate([*texts(1, 40), "", None, "a b", "ab ", "ab", "x" * 5000, "x" * 5000 + " "]))
    found = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    wanted = brute_exact(rows)
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found} == {
        k: (a, b, c, hashlib.sha256(n.encode()).hexdigest()) for k, (a, b, c, n) in wanted.items()
    }


def test_exact_with_equal_digests(spark, tmp_path):
    texts = spark.createDataFrame([(1, 0, "abcabc"), (2, 0, "abcabc"), (3, 0, "xyzxyz"), (4, 0, "abcxyz"), (5, 0, "own")], "row long, at int, block string")
    texts = texts.withColumn("digest", F.when(F.col("row") < 5, 5).otherwise(6).cast("long"))
    occurrences = texts.select("row", "at", F.lit(1).alias("left"), "digest")
    names = {r["row"]: r["name"] for r in exact_dedup.block_names(texts.select("digest", "block"), occurrences, texts, str(tmp_path)).collect()}
    assert len(names) == 5 and names[1] == names[2] and len(set(names.values())) == 4


def test_exact_finds_texts_again(spark):
    docs = frame(spark, [(1, "ab cdefg"), (2, None), (3, "abcd efg")])
    rows = spark.createDataFrame([(7, "abcdefg"), (8, "")], "row long, norm string").select("row", F.sha2("norm", 256).alias("text_sha256"))
    found = exact_dedup.texts_of(rows, docs, F.coalesce("text", F.lit("")), 3).collect()
    assert sorted((r["row"], r["at"], r["block"]) for r in found) == [(7, 0, "abc"), (7, 1, "def"), (7, 2, "g"), (8, 0, "")]


def test_exact_key(spark):
    rows = frame(spark, [(5, "dup A"), (5, "another"), (7, "dup A  "), (None, "x y"), (None, "xy")]).withColumn("_k", F.monotonically_increasing_id() * 3)
    keys = {r["text"]: r["_k"] for r in rows.collect()}
    kept = {r["key"] for r in exact_dedup.exact_duplicates(rows, key_col="_k").filter("kept").collect()}
    assert kept == {keys["another"], keys["dup A  "], keys["x y"]}


def test_exact_repeated_and_null_ids(spark):
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, "b" * 9000), (2, "b" * 9000)]
    found = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in found) == [(-1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 2, False), (2, 2, 2, True)]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_sql(spark, folder):
    compare(spark, folder, exact_dedup.op10_exact_dedup, exact_dedup.OP10_SQL)


# near


def brute_simhash(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints():
    for t in [*texts(2, 30), "", " \t", "one", "one TWO", "É É É É"]:
        assert simhash.simhash(t.encode(), 3) == brute_simhash(t, 3)


@pytest.mark.parametrize("hot", [2, 24])
def test_links_and_components(spark, hot):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(40)}
    signed = {f - (1 << 64) if f >= 1 << 63 else f: f for f in fps}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot)
    for r in edges.collect():
        assert (signed[r["a"]] ^ signed[r["b"]]).bit_count() <= 2
    found = {r["node"]: r["label"] for r in components.smallest_reachable(edges).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for s in signed:
        groups[found.get(s, s)].add(signed[s])
    for f, l in brute_components(sorted(fps)).items():
        wanted[l].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_hot_group_makes_few_rows(spark):
    """300 fingerprints within two bits of one make far fewer links than pairs, and one component."""
    near = [sum(1 << b for b in bits) for i in range(26) for bits in ([i, j] for j in range(i))][:300]
    edges = simhash.links(spark.createDataFrame([(f,) for f in near], "fp long"))
    assert edges.count() < 300 * 65
    assert {r["label"] for r in components.smallest_reachable(edges).collect()} == {min(near)}


def test_near_duplicates(spark, folder):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, None), (8, ""), (7, "quite another text altogether here"), (None, "a b c d e f"), (3, "a b c d e f")]
    found = simhash.near_duplicates(frame(spark, rows), words=3)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in found.collect()) == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    docs = {r["doc_id"]: brute_simhash(r["text"] or "", 3) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    label, least = brute_components(sorted(set(docs.values()))), {}
    for i, f in docs.items():
        least[label[f]] = min(least.get(label[f], i), i)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op2_simhash_near_dedup(spark, folder).collect()}
    assert got == {i: (f, least[label[f]]) for i, f in docs.items()}


# passages


def brute_force(texts: dict[int, bytes], length: int = suffix_dedup.LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The query's result for a few texts, straight from its definition."""
    smallest: dict[bytes, int] = {}
    for doc in sorted(texts):
        for i in range(len(texts[doc]) - length + 1):
            smallest.setdefault(texts[doc][i : i + length], doc)
    out = {}
    for doc, text in texts.items():
        goes = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if smallest[text[i : i + length]] < doc:
                goes[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(text)) if goes[i] and (i == 0 or not goes[i - 1]))
        out[doc] = (len(text), sum(goes), runs, hashlib.sha256(bytes(c for c, g in zip(text, goes, strict=True) if not g)).hexdigest())
    return out


def test_two_stage_sorting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, w = int(rng.integers(1, 30)), int(rng.integers(5, 40))
        m = rng.integers(0, int(rng.integers(1, 5)), (n, w)).astype(np.uint8)
        begin, end = rng.integers(0, 3, n), rng.integers(3, w + 1, n)
        wanted = int(rng.integers(1, w))
        rows, columns = Strings(m, begin, end).sort(wanted)
        got = [(bytes(m[i, j : end[i]])) for i, j in zip(rows, columns, strict=True)]
        assert got == sorted(bytes(m[i, j : end[i]]) for i in range(n) for j in range(begin[i], min(wanted, end[i] + 1)))


def test_adjacent_common_prefixes():
    rng = np.random.default_rng(7)
    for _ in range(20):
        n, w = int(rng.integers(2, 20)), int(rng.integers(20, 60))
        m, end = rng.integers(0, 2, (n, w)).astype(np.uint8), rng.integers(10, w + 1, n)
        m[1::2] = m[::2][: len(m[1::2])]
        strings = Strings(m, np.zeros(n, dtype=np.int64), end)
        rows, at = strings.sort(9)
        suffixes = [bytes(m[i, j : end[i]]) for i, j in zip(rows, at, strict=True)]
        wanted = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert strings.common_prefixes(rows, at, 60).tolist() == wanted
        assert strings.common_prefixes(rows, at, 9).tolist() == [min(9, x) for x in wanted]


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 101, 50).astype(np.uint8)
    places = []
    for before in (0, 3, 17, 70_000):
        text = np.concatenate([rng.integers(97, 101, before).astype(np.uint8), shared, rng.integers(97, 101, 90).astype(np.uint8)])
        place, _ = suffix_dedup.anchors(text, np.full(len(text), len(text), dtype=np.int32))
        inside = [p - before for p in place.tolist() if before <= p <= before + 30]
        places.append(inside)
    assert all(set(places[0]) & set(p) for p in places)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 900)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 900)
    rows = list(enumerate([*texts(seed, 30), "", None, "z" * 49, "z" * 50, "z" * 51, "z" * 120, "ab" * 60, "b" + "ab" * 40, "\x00" * 70, "\x00" * 60 + "a"]))
    found = suffix_dedup.without_repeats(frame(spark, rows))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()}
    assert got == brute_force({i: (t or "").encode() for i, t in rows})
    assert {r["row"]["_chunk"] for r in found.collect()} == {7}
    suffix_dedup.drop_tables()


def test_passages_of_repeated_and_missing_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    found = suffix_dedup.without_repeats(frame(spark, [(1, long), (1, long), (None, long), (2, "x")])).collect()
    assert sorted((r["row"]["doc_id"] or -1, r["n_removed"]) for r in found) == [(-1, len(long)), (1, 0), (1, 0), (2, 0)]
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0
    suffix_dedup.drop_tables()


def test_passages_of_one_id_stay(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 100)
    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    found = suffix_dedup.without_repeats(frame(spark, [(4, long), (4, "b " + long), (4, "c " + long), (5, long + " d"), (None, long + "x"), (None, "y" + long)])).collect()
    assert sorted((r["row"]["doc_id"] or 9, r["n_removed"]) for r in found) == [(4, 0)] * 3 + [(5, len(long)), (9, len(long)), (9, len(long))]
    suffix_dedup.drop_tables()


def test_passages_sql(spark, folder):
    compare(spark, folder, suffix_dedup.op9_suffix_array_dedup, suffix_dedup.OP9_SQL)
    suffix_dedup.drop_tables()


def test_passages_of_the_table(spark, folder):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = suffix_dedup.op9_suffix_array_dedup(spark, folder).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_force(docs)
    suffix_dedup.drop_tables()
