"""Loaders, stores and streams."""

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import suite as SU
from kindred.operators import topics as TP
from kindred.sources import loaders as LD
from kindred.sources import tables as D
from kindred.stores import tables as ST
from kindred.streaming import progress as P


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_terms_csv(spark, tmp_path):
    rows = LD.read_terms_csv(spark, write(tmp_path / "t.csv", "term,domain,frequency\n машинное обучение ,ML,15\nрегрессия,ML,x\nSQL,DB,\n"))
    assert {(r["term"], r["domain"], r["frequency"]) for r in rows.collect()} == {("машинное обучение", "ML", 15), ("регрессия", "ML", 1), ("SQL", "DB", 1)}
    assert [(r["domain"], r["n_terms"]) for r in LD.domains_of(rows).collect()] == [("DB", 1), ("ML", 2)]


def test_bad_terms(spark, tmp_path):
    with pytest.raises(LD.LoadError, match="missing columns"):
        LD.read_terms_csv(spark, write(tmp_path / "a.csv", "word,category\na,b\n"))
    with pytest.raises(LD.LoadError, match="1 rows without a term"):
        LD.read_terms_csv(spark, write(tmp_path / "b.csv", "term,domain\n ,x\n"))
    with pytest.raises(LD.LoadError, match="unknown format"):
        LD.reader("xml")
    assert LD.reader("CSV") is LD.read_terms_csv


def test_terms_json(spark, tmp_path):
    path = write(tmp_path / "d.json", '{"domains": [{"name": "ML", "terms": [{"name": "a", "frequency": 3}, {"name": "b"}]}]}')
    assert {(r["term"], r["frequency"]) for r in LD.read_terms_json(spark, path).collect()} == {("a", 3), ("b", 1)}
    with pytest.raises(LD.LoadError):
        LD.read_terms_json(spark, write(tmp_path / "e.json", '{"domains": []}'))


def test_guards(spark):
    terms = LD.terms_of(spark, [("a", "x", 1), ("b", "y", None)])
    LD.require_domains(terms, "x", "y")
    with pytest.raises(LD.LoadError, match="unknown"):
        LD.require_domains(terms, "x", "z")
    with pytest.raises(LD.LoadError, match="differ"):
        LD.require_domains(terms, "x", "x")


def test_distances_are_inverted_and_others_not(spark, tmp_path):
    path = write(tmp_path / "p.csv", "word1,word2,distance\na,b,2\nc,d,10\n")
    assert sorted(r["human_score"] for r in LD.read_pairs_csv(spark, path).collect()) == [0, 8]
    assert sorted(r["human_score"] for r in LD.read_pairs_csv(spark, path, max_distance=12).collect()) == [2, 10]
    path = write(tmp_path / "q.csv", "word1,word2,distanceij\na,b,2\n")
    assert LD.read_pairs_csv(spark, path).first()["human_score"] == 2


def test_pair_store(spark, tmp_path):
    path = str(tmp_path / "pairs")
    rows = [("B", "a", "sbert", "cosine", 0.1, 1), ("A", "b", "sbert", "cosine", 0.2, 2), ("a", "c", "rag", "cosine", 0.3, 1)]
    frame = spark.createDataFrame(rows, "domain1 string, domain2 string, method string, metric string, score double, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    ST.write_pairs(frame, path)
    assert [(r["a"], r["b"], r["score"]) for r in ST.read_pairs(spark, path, "sbert").collect()] == [("a", "b", 0.2)]
    assert {r["method"]: r["n"] for r in ST.method_counts(ST.read_pairs(spark, path)).collect()} == {"sbert": 1, "rag": 1, "wordnet": 0, "bert": 0, "tfidf": 0, "ensemble": 0}
    assert ST.clear_pairs(spark, path, "sbert") == 2
    assert ST.read_pairs(spark, path).count() == 1


def test_term_exports(spark, tmp_path):
    terms = LD.terms_of(spark, [("a", "x", 1)]).withColumn("tfidf_score", F.lit(None).cast("double"))
    ST.write_terms(terms, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["term", "domain", "frequency"]


def test_stream_equals_batch(spark, folder, tmp_path):
    path = str(tmp_path / "events")
    events = D.progress(spark, folder)
    events.repartition(3).write.parquet(path)
    stream = P.latest(P.read_events(spark, path, events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, P.latest(events).collect()))


def test_upserts(spark, tmp_path):
    write = P.upsert_into(str(tmp_path / "state"), order="status")
    first = spark.createDataFrame([(1, "running"), (2, "running")], "task_id int, status string")
    write(first, 0)
    write(spark.createDataFrame([(2, "done")], "task_id int, status string"), 1)
    assert {(r["task_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "state/v1")).collect()} == {(1, "running"), (2, "done")}


def test_upserts_take_the_newest_row(spark, tmp_path):
    write = P.upsert_into(str(tmp_path / "state"), order="t")
    write(spark.createDataFrame([(1, 5, "done"), (1, 3, "running")], "task_id int, t int, status string"), 4)
    write(spark.createDataFrame([(2, 1, "running")], "task_id int, t int, status string"), 7)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "state/v7")).collect())) == [(1, 5, "done"), (2, 1, "running")]


def test_the_last_line_of_a_term_counts(spark, tmp_path):
    path = write(tmp_path / "t.csv", "term,domain,frequency\na,x,9\nb,y\na,w,2\nc,z,many\n")
    assert sorted(map(tuple, LD.resumed_terms(spark, path).collect())) == [("a", "w", 2), ("c", "z", 1)]


def test_domain_exports_and_report(spark, tmp_path):
    ST.write_domain_terms(LD.terms_of(spark, [("a", "x", 1), ("b", "x", 5), ("c", "y/z", 2)]), str(tmp_path))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "minimal"), header=True).select("term", "domain").collect())) == [("a", "x"), ("b", "x"), ("c", "y/z")]
    assert [r["term"] for r in spark.read.json(str(tmp_path / "full/_domain=x")).collect()] == ["b", "a"]
    results = spark.createDataFrame([("sbert", 0.5, 0.25, 0.125, 3)], "method string, spearman double, pearson double, mse double, missing long")
    lines = ST.result_report(results, "hj-rg", 65, 1.25).splitlines()
    assert lines[0].endswith("hj-rg") and lines[-1] == "| sbert | 0.5000 | 0.2500 | 0.1250 | 3 |"


def test_extended_corpus(spark):
    some = lambda names: spark.createDataFrame(list(enumerate(names)), "place long, term string")
    listed = lambda df: [r["term"] for r in df.orderBy("place").collect()]
    assert listed(ST.extended_corpus(some(["z", "a"]), some(["a", "b", "c", "d"]), least=4)) == ["z", "a", "b", "c"]
    assert listed(ST.extended_corpus(some(["z", "a"]), some(["b"]), least=2)) == ["z", "a"]
    assert listed(ST.extended_corpus(some(["z", "a"]), some(["a", "b"]), least=2, force=True)) == ["z", "a", "b"]


def test_methods_of_data_sets():
    from kindred.operators import metrics as M

    assert [len(M.methods_of(d)) for d in ("hj-rg", "simlex999_rus", "simlex999", "other")] == [9, 9, 6, 1]


def test_terms_by_a_condition_on_words(spark):
    from kindred.operators import harvest as H

    docs = spark.createDataFrame([(i, "d", "red apples grow" + " here" * (i % 2)) for i in range(8)], "doc_id long, domain string, text string")
    found = H.extracted_terms(docs, min_df=1, max_df=1.0, content=lambda w: w != "grow")
    assert {r["term"] for r in found.collect()} == {"red", "apples", "here", "red apples", "apples here", "red apples here"}


def test_terms_of_small_vocabularies_against_a_plain_count(spark, monkeypatch):
    """Runs of frequent words only are counted, in several passes and portions, and no row for each document moves."""
    import math
    import random
    from collections import Counter

    from kindred.operators import harvest as H

    rng = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "zeta", "lambda"]
    docs = [(i, rng.choice("pqr"), " ".join(names[int(rng.random() ** 2 * 10)] for _ in range(rng.randrange(25)))) for i in range(120)] + [(500, "p", None), (501, None, "alpha beta")]
    most, wanted, qualified = 6, {}, 0
    for domain in "pqr":
        own = [(t or "").split() for _, d, t in docs if d == domain]
        runs = [Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in own]
        total, df = sum(runs, Counter()), Counter(t for r in runs for t in r)
        known = sorted((t for t in total if df[t] >= 3 and df[t] <= 0.8 * len(own)), key=lambda t: (-total[t], t))
        qualified += len(known)
        idf = {t: math.log((1 + len(own)) / (1 + df[t])) + 1 for t in known[:most]}
        sums = Counter()
        for r in runs:
            w = {t: c * idf[t] for t, c in r.items() if t in idf}
            norm = math.sqrt(sum(x * x for x in w.values()))
            sums.update({t: x / norm for t, x in w.items()})
        wanted |= {(domain, t): (df[t], round(sums[t] / len(own), 9)) for t in idf}
    sizes, keep = [], H.kept
    monkeypatch.setattr(H, "kept", lambda frame: sizes.append((found := keep(frame)).count()) or found)
    monkeypatch.setattr(H, "SENT", 20)
    monkeypatch.setattr(H, "HELD", 15)
    found = H.extracted_terms(spark.createDataFrame(docs, "doc_id long, domain string, text string").repartition(3), max_features=most)
    assert {(r["domain"], r["term"]): (r["frequency"], round(r["tfidf_score"], 9)) for r in found.collect()} == wanted
    assert max(sizes) < qualified / 2
    assert "doc_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_seeded_topics(spark, folder):
    from kindred.operators import metrics as M
    from kindred.operators import topics as TP

    pairs = D.vector_pairs(spark, folder).limit(40).withColumns({"word1": F.col("word1").cast("string"), "word2": F.col("word2").cast("string")})
    vectors = D.vectors(spark, folder).withColumn("term", F.col("term").cast("string"))
    for found in (TP.clustered(pairs, vectors), TP.document_vectors(pairs, size=8), TP.topic_mixtures(pairs)):
        row = M.evaluated(found).first()
        assert row["predictions_count"] + row["missing"] == 40
    assert M.evaluated(TP.clustered(pairs.limit(1), vectors)).first()["missing"] == 1


def test_topics_take_the_words_of_the_table(spark, folder, monkeypatch):
    from kindred.operators import metrics as M
    from kindred.plans import suites

    pairs = D.vector_pairs(spark, folder)
    n = pairs.select("word1").union(pairs.select("word2")).distinct().count()
    assert n > 50
    monkeypatch.setattr(M, "evaluated", lambda found: found)
    for name in ("topics_documents", "topics_mixtures"):
        found = suites.QUERIES[name](spark, folder)
        assert found.select("word1").union(found.select("word2")).distinct().count() == n


def test_terms_of_three_words(spark, folder):
    from kindred.plans.words import QUERIES

    assert QUERIES["harvest_terms_whole"](spark, folder).filter(F.size(F.split("term", " ")) == 3).count() > 0


def test_whole_queries(spark, folder):
    from kindred.plans.words import QUERIES

    names = D.terms(spark, folder).select("term").distinct().count()
    assert QUERIES["tfidf_most_similar_whole"](spark, folder).select("query").distinct().count() == names
    # 40 of each category's pages, of all orders and not of 500 numbers
    pages = QUERIES["harvest_tree_whole"](spark, folder).select(F.regexp_extract("page", r"(\d+)", 1).cast("long").alias("n"))
    assert pages.filter("n >= 500").count() > 0


def test_upserts_of_rows_that_tie(spark, tmp_path):
    """Of rows that are equal in order the largest counts, whichever comes first."""
    rows = [(1, 5, "b"), (1, 5, "c"), (1, 5, "a")]
    for k, given in enumerate((rows, rows[::-1])):
        P.upsert_into(str(tmp_path / f"state{k}"), order="t")(spark.createDataFrame(given, "task_id int, t int, status string").repartition(3), 0)
        assert list(map(tuple, spark.read.parquet(str(tmp_path / f"state{k}/v0")).collect())) == [(1, 5, "c")]


def test_a_large_domain_is_several_files(spark, tmp_path):
    """Its rows follow each other over the files, by frequency."""
    terms = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), F.when(F.col("id") < 19_000, "big").otherwise("small").alias("domain"), (F.col("id") % 997).cast("int").alias("frequency"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ST.write_domain_terms(terms, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted((tmp_path / "minimal/_domain=big").glob("part-*"))
    rows = [line.split(",") for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and len(rows) == 19_000
    assert [(-int(f), t) for t, _, f in rows] == sorted((-int(f), t) for t, _, f in rows)


def test_combined_files(spark, tmp_path):
    one, two = LD.terms_of(spark, [("a", "x", 1), ("b", "x", 5)]), LD.terms_of(spark, [("a", "x", 9), ("c", "w", 2)]).withColumn("depth", F.lit(1))
    ST.write_combined([one, two], str(tmp_path))
    rows = spark.read.csv(str(tmp_path / "minimal"), header=True, schema="term string, domain string, frequency int")
    assert sorted(map(tuple, rows.collect())) == [("a", "x", 1), ("b", "x", 5), ("c", "w", 2)]
    assert spark.read.json(str(tmp_path / "full")).count() == 4


def test_the_catalogue_lists_what_can_be_read(spark, tmp_path):
    paths = {"one": write(tmp_path / "one.csv", "word1,word2,sim\na,b,1\nc,d,2\n"), "none": str(tmp_path / "none.csv")}
    assert [(r["dataset"], r["n_rows"]) for r in LD.dataset_catalogue(spark, paths).collect()] == [("one", 2)]


def test_status_of_data_sets_and_one_pair(spark):
    results = spark.createDataFrame([("hj-rg", "sbert", 0.5), ("hj-rg", "hybrid", 0.4), ("simlex999", "sbert", 0.3)], "dataset string, method string, spearman double")
    assert {r["dataset"]: (r["methods"], r["done"]) for r in SU.dataset_status(results).collect()} == {"hj-rg": (2, 2), "simlex999_rus": (2, 0), "simlex999": (1, 1)}
    vectors = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [1.0, 1.0])], "term string, domain string, embedding array<float>")
    assert abs(SU.pair_similarity(vectors, "x", "y") - 0.5**0.5) < 1e-9
    with pytest.raises(ValueError, match="two known domains"):
        SU.pair_similarity(vectors, "x", "z")


def test_first_five_terms_tell_the_script(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d", "e", "ё"],), (["a", "я"],), ([],)], "terms array<string>")
    assert [r["c"] for r in rows.select(X.is_cyrillic(F.col("terms")).alias("c")).collect()] == [False, True, False]


def test_clusters_that_are_apart(spark):
    """Words of one cluster score 0.9, others by their clusters' means; a word without a vector is missing."""
    near = [("a", [1.0, 0.02]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.02, 1.0]), ("e", [-1.0, 0.0]), ("f", [-1.0, 0.02]), ("g", [0.0, -1.0])]
    vectors = spark.createDataFrame([(t, "x", v) for t, v in near], "term string, domain string, embedding array<float>")
    pairs = [("a", "b"), ("c", "d"), ("e", "f"), ("a", "c"), ("a", "e"), ("c", "g"), ("g", "g"), ("a", "none")]
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "word1 string, word2 string, human_score double")
    found = {(r["word1"], r["word2"]): r["score"] for r in TP.clustered(frame, vectors).collect()}
    assert found["a", "b"] == found["g", "g"] == 0.9 and found["a", "none"] is None
    assert all(v == 0.9 or v < 0.6 for v in found.values() if v is not None) and found["a", "e"] < 0.5


def test_a_mixture_without_mass_is_missing(spark):
    """A text without a token of the vocabulary has no topics; under three words all are missing."""
    frame = spark.createDataFrame([("red apple", "green apple", 1.0), ("red pear", "green pear", 2.0)], "word1 string, word2 string, human_score double")
    found = TP.topic_mixtures(frame).collect()
    assert len(found) == 2 and all(0 <= r["score"] <= 1 for r in found)
    assert [r["score"] for r in TP.topic_mixtures(frame.limit(1)).collect()] == [None]
    assert spark.range(1).select(X.topic_tokens(F.lit("Ab")).alias("t"), X.topic_tokens(F.lit("ab cd")).alias("u"), X.document_tokens(F.lit("A-b. c")).alias("d"), X.document_tokens(F.lit("-")).alias("e")).first().asDict() == {"t": ["a", "b"], "u": ["ab", "cd"], "d": ["a", "b", "c"], "e": ["-"]}
