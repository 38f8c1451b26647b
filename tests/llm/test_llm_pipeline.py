"""The pipeline's stages on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F

from kindred.llm import suffix_dedup


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(-1, "123", None, "s", 3), (-2, None, None, "s", 0), (-3, "", "en", "s", 0)], docs.schema)
    docs, sizes = docs.unionByName(extra), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        sizes.append(docs.count())
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert sizes[0] - sizes[1] == 3 and sizes == sorted(sizes, reverse=True)
    assert docs.select("doc_id").distinct().count() == sizes[4]
    suffix_dedup.drop_tables()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    suffix_dedup.drop_tables()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], SCHEMA)


def test_exact_copies_go_by_row(spark, folder):
    rows = [(5, "dup id A"), (5, "A different text, longer"), (7, "dup id A  "), (None, "alone here"), (None, "dup id A"), (9, "alone  here"), (6, "twice"), (6, "twice")]
    out = corpus_pipeline.drop_exact(spark, table(spark, rows), folder)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(5, "A different text, longer"), (6, "twice"), (7, "dup id A  "), (9, "alone  here")]
    assert corpus_pipeline.drop_exact(spark, table(spark, []), folder).count() == 0


def test_near_copies_go_by_row(spark, folder):
    words = [f"w{i}" for i in range(200)]
    base, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1])
    rows = [(5, base), (5, other), (3, near), (None, base + " x"), (None, "quite another text of its own"), (8, near + " y"), (9, None)]
    out = corpus_pipeline.drop_near(spark, table(spark, rows), folder).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted([(0, "quite another text of its own"), (3, near), (5, other), (9, None)], key=lambda r: (r[0], r[1] or ""))
    assert corpus_pipeline.drop_near(spark, table(spark, []), folder).count() == 0


def test_near_copies_are_those_of_all_pairs(spark):
    """The near-dedup stage on a whole table against all pairs of fingerprints and sets of shingles."""
    from test_llm_dedup import brute_simhash
    from test_llm_shingles import cosine, parts

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    fps = [brute_simhash(t, 5) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for _, t in rows)]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2 or cosine(sets[a], sets[b]) >= 0.8]
    wanted = [rows[i][0] for i, label in enumerate(parts(pairs, len(rows))) if label == i]
    assert len(wanted) < len(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect()) == wanted


def test_run_leaves_no_folder(spark, folder):
    import os

    from kindred.llm.common import checkpoint_dir

    corpus_pipeline.run(spark, folder)
    left = os.listdir(checkpoint_dir(spark).removeprefix("file:"))
    assert not [n for n in left if n.startswith(("pipeline-", "near-", "blocks-", "kindred_"))]
