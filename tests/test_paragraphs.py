"""Paragraph vectors: places, and texts with the same words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.functions import vectors as V
from kindred.operators import paragraphs as PV


def test_examples_stay_in_their_text():
    texts, targets, around = PV.examples([np.array([5, 6, 7]), np.array([], dtype=int), np.array([8])], 2)
    assert texts.tolist() == [0, 0, 0, 2] and targets.tolist() == [5, 6, 7, 8]
    assert around.tolist() == [[-1, -1, 6, 7], [-1, 5, 7, -1], [5, 6, -1, -1], [-1, -1, -1, -1]]


def cosines(frame):
    rows = sorted((r["term"], r["embedding"]) for r in frame.collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [t for t, _ in rows], x @ x.T


@pytest.mark.parametrize("part", [1_000, 15])
def test_texts_with_the_same_words_are_nearest(spark, folder, part):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("length(text) BETWEEN 500 AND 1500 AND lang = 'en'")
    own = docs.select("doc_id", X.tokens(F.col("text")).alias("tokens")).dropDuplicates(["tokens"]).orderBy("doc_id").limit(16)
    twice = own.select(F.concat(F.col("doc_id").cast("string"), F.lit("a")).alias("term"), "tokens").union(own.select(F.concat(F.col("doc_id").cast("string"), F.lit("b")).alias("term"), "tokens"))
    names, near = cosines(PV.paragraph_vectors(twice, PV.Training(part=part, rounds=3, epochs=6)))
    np.fill_diagonal(near, -1)
    met = sum(names[int(row.argmax())][:-1] == names[i][:-1] for i, row in enumerate(near))
    assert len(names) == 32 and met >= 29
    assert all(len(v) == 100 for v in [r["embedding"] for r in PV.paragraph_vectors(twice.limit(3), PV.Training(rounds=1, epochs=1)).collect()])


def test_it_repeats(spark):
    texts = spark.createDataFrame([(f"t{i}", [f"w{i % 7}", f"w{i % 5}", "x"]) for i in range(50)], "term string, tokens array<string>")
    one, two = ({r["term"]: r["embedding"] for r in PV.paragraph_vectors(f, PV.Training(size=8, rounds=2, epochs=2, part=20)).collect()} for f in (texts, texts.repartition(3)))
    assert set(one) == set(two) and all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_empty_texts_and_a_bounded_vocabulary(spark):
    texts = spark.createDataFrame([("a", []), ("b", ["x", "y", "y"]), ("c", None)], "term string, tokens array<string>")
    found = {r["term"]: r["embedding"] for r in PV.paragraph_vectors(texts, PV.Training(size=4, rounds=2, vocabulary=1)).collect()}
    assert set(found) == {"a", "b", "c"} and all(len(v) == 4 for v in found.values())
    assert PV.paragraph_vectors(texts.limit(0), PV.Training(size=4, rounds=1)).collect() == []


def test_words_come_to_the_driver_as_floats(spark):
    """Which is what the state holds; as doubles they were twice as many bytes."""
    from kindred.operators import paragraphs

    rows = [(0, 1, [1.0, 0.1]), (0, 3, [3.0, 0.1]), (-1, 0, [9.0, 9.0])]
    found = paragraphs.averaged(spark.createDataFrame(rows, "word int, n long, vector array<float>"))
    assert dict(found.dtypes)["v"] == "array<float>"
    assert [(r["word"], [round(x, 6) for x in r["v"]]) for r in found.collect()] == [(0, [2.5, 0.1])]


def test_parts_are_trained_in_tasks_of_their_own(spark):
    """Texts of few bytes are not merged into one task."""
    texts = spark.createDataFrame([(i, [f"w{i % 3}", "x"]) for i in range(40)], "term int, tokens array<string>")
    assert PV.paragraph_vectors(texts, PV.Training(size=4, part=5, rounds=1, epochs=1)).rdd.getNumPartitions() == 8


def test_a_length_is_computed_once(spark):
    """Not again for each number of the vector."""
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(V.unit(F.col("v")).alias("u"))
    assert frame._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r["u"] for r in frame.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
