r"""License notices in texts, by an exact set-similarity join of blocks of words with templates.

A template is a set of words, and a block contains it if it has at least a given share of them. The words of all templates
are counted over all documents and ordered from the rarest on. A block that contains a template has one of the template's
first words in that order, its prefix, so only blocks around such a word are candidates. A candidate with too few words of
any template is dropped (length), as is one whose first common word leaves too few words behind it, in the template's
order or in the block's (position). What is left is compared word by word. No block that meets a template's share is lost.

A template of m words is looked for in blocks of 2s words that begin at each multiple of s, the power of two from m on, so
that every stretch of m words lies in a block. Templates are few and go to all tasks; a text meets them where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, read_table, release
from kindred.llm.slices import letter_words

#: Words of all templates and phrases together: bounds what is sent to the tasks.
MOST_WORDS = 200_000

# The phrases and labels of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Customary notices of public licenses, their labels, and the hundredths of their words that a block must have.
TEMPLATES = (
    ("mit", 80, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-0", 100, "This file is made available under the MIT No Attribution License MIT-0"),
    ("isc", 80, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", 80, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", 80, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl", 80, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version of the License, or (at your option) any later version"),
    ("gpl-3", 100, "licensed under the GNU General Public License, version 3"),
    ("gpl-2", 100, "licensed under the GNU General Public License, version 2"),
    ("lgpl", 100, "under the terms of the GNU Lesser General Public License"),
    ("agpl", 100, "under the terms of the GNU Affero General Public License"),
    ("mpl-2", 80, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", 80, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means"),
    ("cc-by", 100, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", 100, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", 100, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", 80, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, which is dedicated to the public domain under CC0"),
)


def words_of(text: str) -> list[bytes]:
    return [w for words in letter_words(text.encode()) for w in words]


class Templates:
    """Templates and phrases by the numbers of their words. `rank` is the number's place in the global order."""

    def __init__(self, templates: list[tuple[str, int, str]], phrases: list[tuple[str, str]]):
        self.labels, self.phrase_labels = [t[0] for t in templates], [p[1] for p in phrases]
        texts, self.phrases = [words_of(t[2]) for t in templates], [words_of(p[0]) for p in phrases]
        if not all(texts) or not all(self.phrases):
            raise ValueError("a template or phrase has no words")
        if sum(map(len, texts + self.phrases)) > MOST_WORDS:
            raise ValueError(f"templates and phrases have more than {MOST_WORDS} words")
        if any(not 0 < t[1] <= 100 for t in templates):
            raise ValueError("a share is from 1 to 100 hundredths")
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts + self.phrases for w in words))}
        self.sets = [sorted({self.number[w] for w in words}) for words in texts]
        self.phrases = [[self.number[w] for w in words] for words in self.phrases]
        self.needed = [-(-t[1] * len(s) // 100) for t, s in zip(templates, self.sets, strict=True)]
        self.steps = [1 << (len(words) - 1).bit_length() for words in texts]
        self.used = np.zeros(len(self.number), dtype=bool)  # by a template
        for s in self.sets:
            self.used[s] = True

    def numbers(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, -1 for words of no template or phrase."""
        parts = [np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int32, count=len(words)) for words in letter_words(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def order(self, counts: np.ndarray) -> None:
        """Fix the global order, rarest words first, and with it the prefixes."""
        names = list(self.number)
        by = sorted(range(len(names)), key=lambda i: (counts[i], names[i]))
        self.rank = np.empty(len(by) + 1, dtype=np.int64)  # the last, for -1, is no word of a template
        self.rank[by] = np.arange(len(by))
        self.rank[:-1][~self.used] = self.rank[-1] = len(by)
        self.sorted = [np.sort(self.rank[s]) for s in self.sets]
        self.starts: dict[int, list[tuple[int, int]]] = {}  # by rank, the templates that have the word in their prefix, and where
        for t, ranks in enumerate(self.sorted):
            for i, r in enumerate(ranks[: len(ranks) - self.needed[t] + 1].tolist()):
                self.starts.setdefault(r, []).append((t, i))
        self.in_prefix = np.zeros(len(by) + 1, dtype=bool)
        self.in_prefix[list(self.starts)] = True

    def places(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Phrases and the words they begin at."""
        for k, phrase in enumerate(self.phrases):
            at = np.flatnonzero(numbers[: max(0, len(numbers) - len(phrase) + 1)] == phrase[0])
            for i, word in enumerate(phrase[1:], 1):
                at = at[numbers[at + i] == word]
            for place in at.tolist():
                yield k, place

    def blocks(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Templates, the first words of the blocks that contain them, and how many of their words these have."""
        ranks = self.rank[numbers]
        first: dict[tuple[int, int], int] = {}  # of a candidate, where in the template its first common word is
        for at in np.flatnonzero(self.in_prefix[ranks]).tolist():
            for t, i in self.starts[int(ranks[at])]:
                block = at // self.steps[t]
                for k in (block - 1, block) if block else (0,):
                    first[t, k] = min(i, first.get((t, k), i))
        kept: dict[tuple[int, int], np.ndarray] = {}  # the words of a block, for templates of one step
        for (t, k), i in first.items():
            step, own, needed = self.steps[t], self.sorted[t], self.needed[t]
            if (step, k) not in kept:
                found = np.unique(ranks[k * step : (k + 2) * step])
                kept[step, k] = found[found < len(self.number)]
            block = kept[step, k]
            after = min(len(own) - i, len(block) - int(np.searchsorted(block, own[i])))
            if len(block) < needed or after < needed:
                continue
            common = len(np.intersect1d(own, block, assume_unique=True))
            if common >= needed:
                yield t, k * step, common


def word_counts(texts: DataFrame, known: Templates) -> np.ndarray:
    """How often the texts have each word of the templates."""

    def run(batches):
        counts = np.zeros(len(known.number), dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                numbers = known.numbers(text.as_py() or b"")
                counts += np.bincount(numbers[numbers >= 0], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["word", "n"])
        release()

    out = np.zeros(len(known.number), dtype=np.int64)
    for r in texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each word of a template
        out[r["word"]] = r["n"]
    return out


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, places, blocks`: a row for each row of `docs`. `places`: `label, word` of each place, counted in
    words from 0, where a phrase's words follow each other. `blocks`: `label, template, word, n_words, share` of each block
    that contains a template: which one, the block's first word and length, and the share of the template's words in it.

    `templates` are (label, hundredths of its words that a block must have, text) and `phrases` (text, label); all of them
    together have `MOST_WORDS` words at most, or a ValueError is raised. Letters A-Z count as a-z. A null or empty text
    has no words. Rows are judged each by itself, so repeated rows and null ids are like any other; an empty table gives
    an empty result, and other columns are ignored. A long text takes four bytes for each of its words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = Templates(list(templates), list(phrases))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    known.order(word_counts(own.select("text"), known))
    shared = spark.sparkContext.broadcast(known)  # bounded by MOST_WORDS

    def nested(rows: list[list[tuple]], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
        flat = [r for part in rows for r in part]
        fields = [pa.array([r[i] for r in flat], kind) for i, (_, kind) in enumerate(kinds)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.StructArray.from_arrays(fields, fields=[pa.field(*k) for k in kinds]))

    def run(batches):
        t = shared.value
        for batch in batches:
            sizes, places, blocks = [], [], []
            for text in batch.column("text"):
                numbers = t.numbers(text.as_py() or b"")
                sizes.append(len(numbers))
                places.append([(t.phrase_labels[k], at) for k, at in t.places(numbers)])
                blocks.append([(t.labels[k], k, at, min(2 * t.steps[k], len(numbers) - at), n / len(t.sets[k])) for k, at, n in sorted(t.blocks(numbers))])
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), nested(places, [("label", pa.string()), ("word", pa.int64())]),
                    nested(blocks, [("label", pa.string()), ("template", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]),
                ], names=["doc_id", "n_words", "places", "blocks"],
            )
        release()

    return own.mapInArrow(run, "doc_id long, n_words long, places array<struct<label: string, word: long>>, blocks array<struct<label: string, template: long, word: long, n_words: long, share: double>>")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        listed(F.col("places.label")).alias("base_labels"), listed(F.concat("places.label", "blocks.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0))).alias("score"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP13_SQL = f"""
WITH tp(label, share, text) AS (VALUES {_values(TEMPLATES)}), tl AS (SELECT *, row_number() OVER () AS id, {_words("text")} AS ws FROM tp
), tn AS (SELECT id, label, len(list_distinct(ws)) AS size, ceil(share * len(list_distinct(ws)) / 100.0) AS needed, pow(2, ceil(log2(len(ws))))::BIGINT AS step, list_distinct(ws) AS ws FROM tl
), tw AS (SELECT id, label, size, needed, step, unnest(ws) AS w FROM tn
), dl AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents
), dw AS MATERIALIZED (SELECT doc_id, w, i - 1 AS i, lead(w, 1) OVER k AS w1, lead(w, 2) OVER k AS w2, lead(w, 3) OVER k AS w3 FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM dl) WINDOW k AS (PARTITION BY doc_id ORDER BY i)
), ph(phrase, label) AS (VALUES {_values(PHRASES)}
), pl AS (SELECT doc_id, i, label FROM dw JOIN ph ON phrase IN (concat_ws(' ', w, w1, w2, w3), concat_ws(' ', w, w1, w2))
), bl AS (
  SELECT doc_id, label, max(c / size) AS share FROM (
    SELECT doc_id, id, label, size, needed, k, count(DISTINCT w) AS c FROM (SELECT doc_id, id, label, size, needed, w, unnest([i // step, i // step - 1]) AS k FROM dw JOIN tw USING (w)) WHERE k >= 0 GROUP BY ALL
  ) WHERE c >= needed GROUP BY ALL
), b AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pl GROUP BY 1
), a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT doc_id, label, 1.0::DOUBLE AS share FROM pl UNION ALL SELECT doc_id, label, share FROM bl) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.share, 0) AS score
FROM dl LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
