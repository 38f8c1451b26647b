"""Paragraph vectors by distributed memory: a text's vector and the mean of the words around a place predict the word there.

Texts are dealt into parts, which are trained side by side. A part keeps its texts' vectors to itself and starts from the
words' vectors of the round before; after each round the parts' words are averaged by how often each trained them, and sent
out again. A last round trains the texts' vectors from nothing against the words as they then are, so that texts of
different parts compare. Only the words are sent, and their number is bounded by `vocabulary`. All draws are seeded by part
and round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.stores.lineage import kept


@dataclass(frozen=True)
class Training:
    """size: of a vector; window: words on each side of a place; negative: drawn words for each true one; rounds, and
    epochs in each; rate: of the first round, falling to a hundredth; vocabulary: most frequent words that are trained;
    part: texts that are trained together, on average; batch: places of one step."""

    size: int = 100
    window: int = 5
    negative: int = 5
    rounds: int = 5
    epochs: int = 8
    rate: float = 0.05
    vocabulary: int = 50_000
    part: int = 1_000
    batch: int = 64
    seed: int = 42


def examples(tokens: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of each text: the text, the word, and the words around it (-1: none)."""
    texts = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
    around = np.full((len(flat), 2 * window), -1, dtype=np.int64)
    for k, shift in enumerate([*range(-window, 0), *range(1, window + 1)]):
        at = np.arange(len(flat)) + shift
        inside = (at >= 0) & (at < len(flat))
        inside[inside] &= texts[at[inside]] == texts[inside]
        around[inside, k] = flat[at[inside]]
    return texts, flat.astype(np.int64), around


def trained(tokens: list[np.ndarray], vectors: np.ndarray, words: np.ndarray, outputs: np.ndarray, chance: np.ndarray, t: Training, rate: float, rng: np.random.Generator, fixed: bool) -> None:
    """Train a part's text vectors and, unless they are fixed, its copies of the words' two vectors, in place. chance:
    cumulated, of drawn words."""
    texts, targets, around = examples(tokens, t.window)
    for _ in range(t.epochs):
        order = rng.permutation(len(targets))
        for begin in range(0, len(order), t.batch):
            rows = order[begin : begin + t.batch]
            near, text = around[rows], texts[rows]
            used = near >= 0
            hidden = (vectors[text] + (words[near] * used[..., None]).sum(axis=1)) / (1 + used.sum(axis=1))[:, None]
            ids = np.concatenate([targets[rows, None], np.searchsorted(chance, rng.random((len(rows), t.negative)))], axis=1)
            true = np.zeros(ids.shape)
            true[:, 0] = 1
            step = rate * (true - 1 / (1 + np.exp(-np.clip(np.einsum("es,ens->en", hidden, outputs[ids]), -30, 30))))
            step[:, 1:] *= ids[:, 1:] != ids[:, :1]  # a word that was drawn and is true is true
            back = np.einsum("en,ens->es", step, outputs[ids])
            np.add.at(vectors, text, back)
            if not fixed:
                np.add.at(outputs, ids, step[..., None] * hidden[:, None, :])
                np.add.at(words, near[used], np.broadcast_to(back[:, None, :], (*near.shape, back.shape[1]))[used])


def round_of(sent, t: Training, step: int):
    """A round of a part: its texts with their new vectors (`word` -1), and a row for each word that it trained. sent: a
    broadcast of the words' vectors and of the chances to be drawn."""
    fixed = step == t.rounds
    rate = t.rate * (1 - 0.99 * (0 if fixed else step) / max(1, t.rounds - 1))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both, likely = sent.value
        rows = rows.sort_values("term", kind="stable")
        draws = np.random.default_rng([t.seed, step, int(key[0])])
        words, outputs = both[:, : t.size].astype(float), both[:, t.size :].astype(float)
        if fixed:
            vectors = np.zeros((len(rows), t.size))
        elif step:
            vectors = np.stack(rows["vector"].tolist()).astype(float)
        else:
            vectors = (draws.random((len(rows), t.size)) - 0.5) / t.size
        tokens = [np.asarray(x, dtype=np.int64) for x in rows["tokens"]]
        trained(tokens, vectors, words, outputs, likely, t, rate, draws, fixed)
        used, n = np.unique(np.concatenate(tokens), return_counts=True) if tokens and not fixed else ([], [])
        ended = pd.DataFrame({"word": -1, "n": 0, "part": key[0], "term": rows["term"], "tokens": rows["tokens"], "vector": list(vectors.astype(np.float32))})
        taught = pd.DataFrame({"word": used, "n": n, "part": key[0], "term": None, "tokens": None, "vector": list(np.concatenate([words[used], outputs[used]], axis=1).astype(np.float32)) if len(used) else []})
        return pd.concat([ended, taught]) if len(used) else ended

    return run


def averaged(out: DataFrame) -> DataFrame:
    """`word, v`: the mean of what the parts made of a word, by how often each trained it; as floats, which the state holds."""
    mean = out.filter("word >= 0").groupBy("word").agg(Summarizer.mean(array_to_vector("vector"), F.col("n").cast("double")).alias("v"))
    return mean.select("word", vector_to_array("v", "float32").alias("v"))


def paragraph_vectors(texts: DataFrame, training: Training | None = None) -> DataFrame:
    """`term, embedding` for `texts` of `term` (once each) and `tokens`. Texts with the same words get vectors near each
    other. A text without a word of the vocabulary gets zeros."""
    t = training or Training()
    texts = kept(texts.select("term", "tokens"))
    kind, parts = dict(texts.dtypes)["term"], max(1, -(-texts.count() // t.part))
    counts = texts.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(t.vocabulary).collect()  # bounded by `vocabulary`
    spark = texts.sparkSession
    number = spark.createDataFrame([(r["word"], i) for i, r in enumerate(counts)], "word string, number int")
    chance = np.cumsum(np.array([r["n"] for r in counts], dtype=float) ** 0.75)
    chance = chance / chance[-1] if len(chance) else chance
    placed = texts.select("term", F.posexplode("tokens").alias("at", "word")).join(F.broadcast(number), "word")
    own = placed.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "number"))), lambda p: p["number"]).alias("tokens"))  # of one text
    docs = texts.select("term").join(own, "term", "left").select(
        F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"), F.lit(None).cast("array<float>").alias("vector")
    )
    rng = np.random.default_rng(t.seed)
    state = np.concatenate([(rng.random((len(counts), t.size)) - 0.5) / t.size, np.zeros((len(counts), t.size))], axis=1).astype(np.float32)
    schema = f"word int, n long, part int, term {kind}, tokens array<int>, vector array<float>"
    for step in range(t.rounds + 1):
        sent = spark.sparkContext.broadcast((state, chance))
        dealt = docs.repartition(parts, "part")  # texts are few bytes and much work: Spark would merge the parts into few tasks
        out = kept(dealt.groupBy("part").applyInPandas(round_of(sent, t, step), schema))  # a part has `part` texts on average, each once
        docs = out.filter("word < 0").select("part", "term", "tokens", "vector")
        if step == t.rounds:
            break
        for r in averaged(out).collect():  # the vocabulary
            state[r["word"]] = r["v"]
        sent.unpersist()
    return docs.select("term", F.col("vector").alias("embedding"))
