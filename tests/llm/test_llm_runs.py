"""Periodic runs against all periods tried one by one."""

import random
from hashlib import sha256

import numpy as np
import pytest

from kindred.llm import runs as R


def plain(words, shortest=6, exponent=4):
    """Every period is tried at every place."""
    number, found = {}, {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    for p in range(1, len(words) // exponent + 1):
        step = np.diff(np.concatenate([[0], (ids[:-p] == ids[p:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if b - a + p >= max(shortest, exponent * p):
                found.setdefault((a, b - a + p), p)
    return sorted((a, n, p) for (a, n), p in found.items())


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    out = [" ".join(rng.choice("ab" if i % 3 else "abc") for _ in range(rng.randrange(0, 120))) for i in range(600)]
    for _ in range(60):  # a phrase over and over, between other words, with a word changed now and then
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))]
        for _ in range(rng.randrange(1, 4)):
            phrase = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]
            more = phrase * rng.randrange(3, 9)
            if rng.random() < 0.3:
                more[rng.randrange(len(more))] = "z"
            words += more + [rng.choice("xyz") for _ in range(rng.randrange(4))]
        out.append("\t".join(words))
    return [*out, ("a b " * 50 + "c ") * 20, "x " * 5000, ("a b c " * 40 + "d ") * 30, None, "", "one", " \n ", "Ab ab " * 9]


def test_runs_and_collapsed_texts_equal_the_plain_version(spark):
    given = texts()
    rows = R.word_runs(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(given)
    for r in rows:
        words = (given[r["doc_id"]] or "").split()
        wanted = plain(words)
        assert [tuple(x) for x in r["runs"]] == wanted and r["collapsed"] == collapsed(words, wanted) and r["n_words"] == len(words)


def test_other_lengths_and_exponents(spark):
    given = texts()[:250]
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for shortest, exponent in ((3, 3), (12, 5)):
        for r in R.word_runs(frame, shortest=shortest, exponent=exponent).collect():
            assert [tuple(x) for x in r["runs"]] == plain(given[r["doc_id"]].split(), shortest, exponent)
    with pytest.raises(ValueError):
        R.word_runs(frame, exponent=2)


def test_pairs_of_one_list_are_never_looked_at():
    """In a run of n words the pairs grow with n, not with its square."""
    count = {}
    for n in (2_000, 8_000):
        pairs, plain_pairs = 0, R.maximal_pairs

        def counting(*args, plain_pairs=plain_pairs):
            nonlocal pairs
            for pair in plain_pairs(*args):
                pairs += 1
                yield pair

        R.maximal_pairs = counting
        try:
            assert R.runs_of(np.array([1] * n + [0])) == [(0, n, 1)]
        finally:
            R.maximal_pairs = plain_pairs
        count[n] = pairs
    assert count[8_000] <= 4 * count[2_000] + 8 and count[8_000] <= 8_000


def test_equal_texts_of_a_batch_do_not_meet():
    key = np.array([0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15, 19])  # twice the same text, each with integers of its own
    assert R.runs_of(key) == []


def test_odd_rows(spark):
    rows = [(None, "a " * 9, 1), (None, "a " * 9, 1), (2, None, 2), (3, "w " * 400_000, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    out = {(r["doc_id"], r["n_words"]): [tuple(x) for x in r["runs"]] for r in R.word_runs(frame).collect()}
    assert out == {(None, 9): [(0, 9, 1)], (2, 0): [], (3, 400_000): [(0, 400_000, 1)]}
    assert R.word_runs(frame.limit(0)).collect() == []


def test_whole_query_equals_the_plain_version(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = R.op12_periodic_runs(spark, folder).collect()
    assert len(rows) == len(docs) and sum(r["n_runs"] for r in rows) > 0
    for r in rows:
        words = (docs[r["doc_id"]] or "").split()
        places = R.planted(r["doc_id"], len(words))
        words = words if places is None else [words[i] for i in places]
        runs = plain(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(collapsed(words, runs).encode()).hexdigest()
