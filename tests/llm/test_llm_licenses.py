"""License scans against every block and template compared."""

import random

import pytest
from oracle import compare

from kindred.llm import licenses as L


def plain(text, templates, phrases):
    words = L.words_of(text or "")
    places = sorted((label, i) for phrase, label in phrases for own in [L.words_of(phrase)] for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own)
    blocks = []
    for t, (label, share, notice) in enumerate(templates):
        own = L.words_of(notice)
        step = 1
        while step < len(own):
            step *= 2
        for at in range(0, max(1, len(words)), step):
            block = words[at : at + 2 * step]
            common = len(set(own) & set(block))
            if common * 100 >= share * len(set(own)):
                blocks.append((label, t, at, len(block), common / len(set(own))))
    return places, sorted(blocks)


def made():
    rng, out = random.Random(5), [None, "", "CC BY-NC", "under the MIT license under the mit license"]
    common = ["the", "of", "license", "under", "this", "work", "is", "version", "and", "to", "in", "software", "notice", "or", "copy"]
    for _ in range(250):
        words = [rng.choice(common + [f"w{i}" for i in range(15)]) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice(L.TEMPLATES)[2].split()
            for _ in range(rng.randrange(0, len(notice) // 3)):  # some words changed, some put in
                notice[rng.randrange(len(notice))] = rng.choice(common)
                notice.insert(rng.randrange(len(notice)), "x")
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        out.append(" ".join(words))
    return out


def test_join_equals_all_pairs(spark):
    given = made()
    rows = L.license_scan(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(given)
    met = 0
    for r in rows:
        places, blocks = plain(given[r["doc_id"]], L.TEMPLATES, L.PHRASES)
        assert sorted(map(tuple, r["places"])) == places and sorted(map(tuple, r["blocks"])) == blocks
        met += len(blocks)
    assert met > 100


def test_few_blocks_are_compared_word_by_word():
    """Words that every text has make no candidates: prefixes hold the rarest ones."""
    known = L.Templates(list(L.TEMPLATES), list(L.PHRASES))
    counts = [0] * len(known.number)
    for w in ("the", "of", "this", "license", "under", "and", "to", "in", "is"):
        counts[known.number[w.encode()]] = 10_000
    known.order(counts)
    assert not list(known.blocks(known.numbers(b"the of this license under and to in is " * 500)))
    assert not known.in_prefix[known.rank[known.number[b"the"]]]


def test_labels_of_the_query_and_odd_rows(spark, tmp_path):
    notice = L.TEMPLATES[0][2]
    rows = [(1, f"Text. {notice} More.", "x"), (2, None, None), (None, "Released under the MIT license", "y"), (3, "x " * 300_000 + "licensed under the GNU General Public License, version 3", "z"), (4, "under the license", ""), (4, "under the license", "")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in L.op13_license_scan(spark, str(tmp_path)).collect()}
    assert found[1]["labels"] == "mit" and found[1]["base_labels"] == "" and found[1]["score"] == 1.0 and found[1]["first_word"] is None
    assert found[None]["base_labels"] == "mit" and (found[None]["first_word"], found[None]["last_word"], found[None]["n_base"]) == (1, 1, 1)
    assert found[3]["labels"] == "gpl-3" and found[3]["n_words"] == 300_009
    assert found[2]["n_words"] == 0 and found[2]["labels"] == "" and found[2]["score"] == 0.0 and found[4]["labels"] == ""
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_templates_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        L.license_scan(docs, templates=[("big", 80, "w " * (L.MOST_WORDS + 1))])
    with pytest.raises(ValueError):
        L.license_scan(docs, templates=[("none", 80, "...")])


def test_query_equals_sql(spark, folder):
    compare(spark, folder, L.op13_license_scan, L.OP13_SQL)
