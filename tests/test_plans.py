"""Plans that must hold at scale: what joins, what scans, and results against plain versions."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import grid
from kindred.operators import knn as K
from kindred.operators import lexical as L
from kindred.operators import metrics as M
from kindred.operators import taxonomy as T
from kindred.plans.registry import QUERIES
from kindred.sources import tables as D


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().sparkPlan().toString()


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame_of(spark, ids, vectors):
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], f"term {kind}, vector array<double>")


def plain_nearest(corpus_ids, corpus, ids, queries, k):
    out, scores = {}, np.round(queries @ corpus.T, 9)
    for q, row in zip(ids, scores, strict=True):
        best = sorted(zip(-row, corpus_ids, strict=True))[: k + 1]
        out[q] = [i for _, i in best if i != q][:k]
    return out


@pytest.mark.parametrize(("row", "column"), [(4096, 100_000), (37, 41), (500, 7)])
def test_neighbours_are_exact_on_any_grid(spark, row, column):
    rng = np.random.default_rng(2)
    corpus, queries = unit(rng, 230, 6), unit(rng, 90, 6)
    corpus[100:140] = corpus[0]  # ties, in order of id
    ids, asked = [f"c{i:03d}" for i in range(230)], [f"c{i:03d}" for i in range(50)] + [f"q{i}" for i in range(40)]
    found = defaultdict(list)
    for r in K.nearest(frame_of(spark, ids, corpus), frame_of(spark, asked, queries), 5, row, column).orderBy("query", "place").collect():
        found[r["query"]].append(r["neighbour"])
    assert dict(found) == plain_nearest(ids, corpus, asked, queries, 5)


def test_a_small_corpus_gives_fewer_neighbours(spark):
    own = frame_of(spark, [1, 2, 3], np.eye(3))
    assert sorted((r["query"], r["neighbour"]) for r in K.nearest(own, own, 5).collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert K.nearest(own.limit(0), own, 5).collect() == [] and K.nearest(own, own.limit(0), 5).collect() == []


def test_the_grid_grows_with_both_sides():
    assert grid.shape(100, 100, 8, K.ROW, K.COLUMN) == (1, 1)
    rows, columns = grid.shape(10_000_000, 50_000_000, 1000, K.ROW, K.COLUMN)
    assert rows * K.ROW >= 10_000_000 and columns * K.COLUMN >= 50_000_000


def test_neighbours_need_no_product(spark, folder):
    text = plan(QUERIES["knn"](spark, folder))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Join" not in text


def test_rag_reads_what_is_kept(spark, folder):
    """Vectors are read once and kept; what follows reads neither the table nor an index anew."""
    for name in ("rag_domains", "graph_rag_domains"):
        assert "Relation [vec_id" not in plan(QUERIES[name](spark, folder))


def test_methods_come_from_one_join(spark, folder):
    text = M.vector_methods(D.vector_pairs(spark, folder), D.vectors(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2 and text.count("Join ") == 1 and "Union" not in text
    final = M.evaluated(M.vector_methods(D.vector_pairs(spark, folder), D.vectors(spark, folder)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" not in final  # the predictions are kept


def test_pairs_that_come_twice_count_twice(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 1.0), ("a", "x", 2.0), ("a", "a", 3.0)], "word1 string, word2 string, human_score double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "term string, embedding array<float>")
    found = sorted((r["word1"], r["word2"], r["score"]) for r in M.vector_methods(pairs, vectors).filter("method = 'sbert' AND score IS NOT NULL").collect())
    assert found == [("a", "a", 1.0), ("a", "b", 0.5), ("a", "b", 0.5)]
    assert M.evaluated(M.vector_methods(pairs, vectors).filter("method = 'sbert'")).first()["missing"] == 1


def breadth_first(edges, a, b, most):
    near = defaultdict(set)
    for x, y in edges:
        near[x].add(y)
        near[y].add(x)
    seen, queue = {a: 0}, deque([a])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen[b] if b in seen and seen[b] <= most else -1


@pytest.mark.parametrize("most", [20, 4])
def test_shortest_paths_from_both_ends(spark, most):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(45)}", f"n{rng.randrange(45)}") for _ in range(38)] + [(f"c{i}", f"c{i + 1}") for i in range(9)]
    pairs = [(f"n{rng.randrange(45)}", f"n{rng.randrange(45)}") for _ in range(60)] + [("c0", "c9"), ("c9", "c2"), ("c4", "c4"), ("none", "n1"), ("none", "none")]
    found = T.shortest_paths(spark.createDataFrame(pairs, "s1 string, s2 string"), spark.createDataFrame(edges, "child string, parent string"), most)
    assert {(r["s1"], r["s2"]): r["length"] for r in found.collect()} == {(a, b): breadth_first(edges, a, b, most) for a, b in pairs}


def test_shortest_paths_below_wide_parents(spark, monkeypatch):
    """Two parents of 150 leaves each: what a search keeps does not grow with leaves times leaves."""
    sizes, keep = [], T.kept
    monkeypatch.setattr(T, "kept", lambda frame: sizes.append((found := keep(frame)).count()) or found)
    edges = [(f"{p}{i}", p) for p in "ab" for i in range(150)] + [("a", "top"), ("b", "top"), ("u", "v"), ("w", "w")]
    pairs = [(f"a{i}", f"b{(i * 7) % 150}") for i in range(150)] + [("a0", "a1"), ("a0", "a"), ("a0", "top"), ("a0", "a0"), ("u", "v"), ("v", "u"), ("u", "a0"), ("w", "w"), ("w", "a0")]
    for most in (20, 3):
        found = T.shortest_paths(spark.createDataFrame(pairs, "s1 string, s2 string"), spark.createDataFrame(edges, "child string, parent string"), most)
        assert {(r["s1"], r["s2"]): r["length"] for r in found.collect()} == {(a, b): breadth_first(edges, a, b, most) for a, b in pairs}
    assert max(sizes) <= 2 * len(edges)


def test_domains_compare_a_row_for_interchangeable_synsets(spark):
    """The similarities are those of all pairs; the rows do not grow with the synsets below a parent."""
    rng = random.Random(11)
    edges = [(f"s{i}", f"n{rng.randrange(4)}", 0) for i in range(120)] + [(f"n{i}", f"r{i % 2}", 0) for i in range(4)] + [(f"r{i}", "top", 0) for i in range(2)] + [("x", "y", 0), ("y", "x", 0), ("z", "x", 0)]
    h = spark.createDataFrame(edges, "child string, parent string, ord int")
    s = spark.createDataFrame([(n,) for n in sorted({e[0] for e in edges} | {e[1] for e in edges} | {"alone"})], "synset_id string")
    members = spark.createDataFrame([(f"s{i}",) for i in range(0, 120, 3)] + [("n0",), ("r0",), ("r0",), ("r1",)], "synset_id string")
    terms = [(i % 3, f"s{i}") for i in range(120)] + [(0, "n1"), (1, "n1"), (1, "x"), (2, "y"), (2, "z"), (0, "alone"), (1, "alone"), (0, "s1"), (2, "none")]
    counts = T.domain_synsets(spark.createDataFrame(terms, "domain int, term string"), s.select(F.col("synset_id").alias("term"), "synset_id", F.lit(0).alias("ord")))
    chain, ic = T.kept(T.chains(s, h)), T.kept(T.contents(s, members))
    few = T.kept(T.interchangeable(counts, chain, ic))
    found = []
    for own in (counts, few):
        pairs = T.kept(T.domain_synset_pairs(own))
        scores = T.kept(T.synset_similarities(pairs.select("s1", "s2").distinct(), chain, h, ic))
        found.append([{(r["domain1"], r["domain2"]): (r["max"], r["min"], round(r["mean"], 9)) for r in T.domain_similarities(pairs, scores, a, "max", "min", "mean").collect()} for a in ("lin", "wup")])
    assert found[0] == found[1] and len(found[0][0]) == 3
    assert few.agg(F.sum("n")).first()[0] == len(terms) and few.count() <= 3 * 8 + 10


def test_taxonomy_domains_forms_few_pairs(spark, monkeypatch):
    from kindred.plans import measures

    sizes, keep = [], measures.kept
    monkeypatch.setattr(measures, "kept", lambda frame: sizes.append((found := keep(frame)).count()) or found)
    QUERIES["taxonomy_domains"](spark, "/root/testdata/sf0.01").collect()
    assert max(sizes) <= 4 * D.synsets(spark, "/root/testdata/sf0.01").count()


def test_memory_of_a_cell_does_not_grow_with_the_corpus():
    """A row of queries and its scores with a batch take at most 100 MB, however many vectors come."""
    import tracemalloc

    own, peaks = np.random.default_rng(1).normal(size=(K.ROW, 8)), []
    for batches in (4, 16):
        rng, running = np.random.default_rng(2), grid.Running(6)
        tracemalloc.start()
        for i in range(batches):
            running.add(np.arange(i * K.BATCH, (i + 1) * K.BATCH).astype(object), own @ rng.normal(size=(K.BATCH, 8)).T)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 100 << 20 and peaks[1] < 1.2 * peaks[0]


def test_two_chains_at_once(spark):
    """Plans built side by side do not share names."""
    one = T.chains(spark.createDataFrame([("a",)], "synset_id string"), spark.createDataFrame([("a", "b", 0)], "child string, parent string, ord int"))
    two = T.chains(spark.createDataFrame([("x",)], "synset_id string"), spark.createDataFrame([("x", "y", 0), ("y", "x", 0)], "child string, parent string, ord int"))
    assert sorted(map(tuple, one.collect())) == [("a", "a", 0), ("a", "b", 1)]
    assert sorted(map(tuple, two.collect())) == [("x", "x", 0), ("x", "y", 1)]


def test_term_scores_are_one_row_a_pair(spark):
    pairs = spark.createDataFrame([("Cat ", "dog"), ("cat", "none")], "word1 string, word2 string")
    senses = spark.createDataFrame([("cat", "c1", 1), ("cat", "c0", 2), ("dog", "d", 0)], "term string, synset_id string, ord int")
    scores = spark.createDataFrame([("c1", "d", 0.4, 0.6)], "s1 string, s2 string, lin double, wup double")
    assert sorted(map(tuple, T.term_scores(pairs, senses, scores, "lin", "wup").collect())) == [("Cat ", "dog", 0.4, 0.6), ("cat", "none", 0.0, 0.0)]


def test_ensemble_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(len(r))
            yield r

    rows = spark.createDataFrame([(m, i, float((i * k) % 7)) for k, m in ((2, "a"), (3, "b")) for i in range(20)], "method string, item long, score double")
    counted = rows.mapInPandas(count, rows.schema)
    assert len(M.rank_ensemble(counted).collect()) == 20 and seen.value == 40


def plain_tfidf(texts, low, high):
    grams = {t: [t.lower()[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1)] for t in texts}
    df = defaultdict(int)
    for g in grams.values():
        for x in set(g):
            df[x] += 1
    out = {}
    for t, g in grams.items():
        own = {x: (1 + np.log(g.count(x))) * (np.log((1 + len(texts)) / (1 + df[x])) + 1) for x in set(g)}
        norm = np.sqrt(sum(v * v for v in own.values()))
        out[t] = {x: v / norm for x, v in own.items()}
    return out


def test_the_square_and_the_nearest_texts_are_exact_in_any_blocks(spark, monkeypatch):
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(60)} | {"x", "zzzz"})
    weights = plain_tfidf(texts, 2, 3)
    score = lambda a, b: (sum(w * weights[b].get(g, 0) for g, w in weights[a].items()) + 1) / 2
    frame = spark.createDataFrame([(t,) for t in texts], "term string")
    for block in (7, 512):
        monkeypatch.setattr(L, "BLOCK", block)
        monkeypatch.setattr(L, "ROW", block)
        monkeypatch.setattr(L, "BATCH", block)
        found = {(r["term1"], r["term2"]): r["score"] for r in L.TfIdf(frame, 2, 3).square().collect()}
        assert len(found) == len(texts) ** 2 and all(abs(found[a, b] - score(a, b)) < 1e-9 for a in texts for b in texts)
        near = defaultdict(list)
        for r in L.TfIdf(frame, 2, 3).most_similar(frame, 4).orderBy("query", "place").collect():
            near[r["query"]].append(r["term"])
        known = [t for t in texts if weights[t]]
        assert dict(near) == {q: [t for _, t in sorted((-round(score(q, t), 9), t) for t in known if t != q)][:4] for q in known}


def test_tfidf_reads_its_texts_once(spark, folder):
    for name in ("tfidf_matrix", "tfidf_most_similar_whole", "tfidf_square"):
        text = plan(QUERIES[name](spark, folder))
        assert "Relation [" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
