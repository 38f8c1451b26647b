"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

Strings are read as letters in lower case and one symbol for anything else. Their kernel counts common subsequences of
three symbols; each symbol skipped, up to `GAPS` in each gap, costs the factor `DECAY`. So `i d i o t`, `id*iot` and
`idioot` still share most subsequences with `idiot`.

The machine is trained on stretches of labelled sentences. In a toxic document these are the stretches that begin
with runs of letters which toxic documents have far more often than their share of the text lets expect, as they are
and with characters put in; in a clean document random ones, the most similar ones, and in each round those that the
last machine likes best. It is fitted on the kernel values with the landmarks (Nyström features), by Newton steps on
the squared hinge loss.

A landmark expansion is linear in the counts of subsequences, so the fitted machine is one table of weights of all
subsequences. A text is scored whole, at every place, by a few table lookups a character. The best two stretches of
its sentences and its length give the score, through a logistic curve fitted on the sampled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import bounded_batches, fold, read_table

#: Bounds of the labelled sample: toxic and clean documents, and code points of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1_000, 2_500, 20_000
#: Symbols skipped in a gap at most, and the weight of each; places at which a stretch's subsequences begin.
GAPS, DECAY, PLACES = 3, 0.6, 8
#: Symbols: 0 for what is no letter, then the most frequent letters, the last for other letters.
SYMBOLS = 64
#: Lengths of neighbouring symbols that mark stretches of toxic documents, and the least log-likelihood ratio.
NEIGHBOURS, LEAST_TELLING = (4, 5, 6, 7), 12.0
LANDMARKS, ROUNDS, PENALTY = 512, 4, 1e-3
#: The share of toxic documents that the logistic curve reckons with.
SHARE = 0.1
#: The score from which a text is predicted toxic.
THRESHOLD = 0.3
REACH = PLACES + 2 * (GAPS + 1)
STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, GAPS + 2) for b in range(1, GAPS + 2)]


@dataclass
class Model:
    letters: np.ndarray  # code points, sorted, with `symbol_of` beside them
    symbol_of: np.ndarray
    weights: np.ndarray  # of each subsequence
    bias: float
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, -60.0)  # of the best and second stretch, the logarithm of the length, 1

    def encode(self, text: str) -> np.ndarray:
        """Symbols of the text, with a separator before and enough of them behind."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        table = self.table()
        out = np.zeros(len(points) + 1 + REACH, dtype=np.int32)
        out[1 : len(points) + 1] = table[np.minimum(points, len(table) - 1)]
        high = np.flatnonzero(points >= len(table) - 1)
        if len(high):
            found = {c: self.symbol(c) for c in np.unique(points[high]).tolist()}
            out[high + 1] = [found[c] for c in points[high].tolist()]
        return out

    def symbol(self, point: int) -> int:
        at = int(np.searchsorted(self.letters, point))
        if at < len(self.letters) and self.letters[at] == point:
            return int(self.symbol_of[at])
        return SYMBOLS - 1 if chr(point).isalpha() else 0

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.array([self.symbol(c) for c in range(0x600)] + [0], dtype=np.int32)
        return self._table

    def stretches(self, symbols: np.ndarray) -> np.ndarray:
        """The machine's value for the stretch that begins at each place of an encoded text."""
        return stretch_sums(symbols, self.weights) + self.bias

    def evidence(self, symbols: np.ndarray) -> tuple[float, float, float]:
        """The best value of a stretch, the best one apart from it, and the logarithm of the text's length."""
        values = self.stretches(symbols)
        best = int(values.argmax())
        apart = np.concatenate([values[: max(0, best - PLACES + 1)], values[best + PLACES :]])
        return float(values[best]), float(apart.max()) if len(apart) else self.bias, math.log(len(symbols))

    def score(self, text: str) -> float:
        value = sum(c * x for c, x in zip(self.curve, (*self.evidence(self.encode(text)), 1.0), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, value))))


def stretch_sums(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of the subsequences that begin at each place and the `PLACES` - 1 behind it."""
    n = len(symbols) - 2 * (GAPS + 1)
    first, value = symbols[:n] << 12, np.zeros(n, dtype=np.float32)
    for a, b, w in STEPS:
        value += np.float32(w) * weights[first | symbols[a : n + a] << 6 | symbols[a + b : n + a + b]]
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return total[PLACES:] - total[:-PLACES]


def subsequences(stretches: np.ndarray) -> np.ndarray:
    """Subsequences of encoded stretches (rows of REACH symbols), one column for each place and step."""
    columns = [stretches[:, i] << 12 | stretches[:, i + a] << 6 | stretches[:, i + a + b] for i in range(PLACES) for a, b, _ in STEPS]
    return np.stack(columns, axis=1)


STEP_WEIGHTS = np.array([w for _ in range(PLACES) for _, _, w in STEPS])


class Kernel:
    """Kernel values with the landmarks, which are scaled to unit length."""

    def __init__(self, landmarks: np.ndarray):
        found = subsequences(landmarks)
        self.features, at = np.unique(found, return_inverse=True)
        self.table = np.zeros((len(self.features) + 1, len(landmarks)), dtype=np.float32)  # the last row: subsequences of no landmark
        np.add.at(self.table, (at.reshape(found.shape), np.arange(len(landmarks))[:, None]), np.broadcast_to(STEP_WEIGHTS, found.shape).astype(np.float32))
        self.table /= np.linalg.norm(self.table, axis=0)

    def __call__(self, stretches: np.ndarray) -> np.ndarray:
        out = np.empty((len(stretches), self.table.shape[1]), dtype=np.float32)
        for i in range(0, len(stretches), 128):
            found = subsequences(stretches[i : i + 128])
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            at = np.where(self.features[at] == found, at, len(self.features))
            out[i : i + 128] = np.einsum("nfm,f->nm", self.table[at], STEP_WEIGHTS.astype(np.float32))
        return out

    def expand(self, alpha: np.ndarray) -> np.ndarray:
        """The weight of every subsequence under these coefficients of the landmarks."""
        out = np.zeros(SYMBOLS**3, dtype=np.float32)
        out[self.features] = self.table[:-1] @ alpha
        return out


def machine(kernel: Kernel, landmarks: np.ndarray, stretches: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of subsequences and bias of the machine with the squared hinge loss, both classes weighing alike."""
    values, vectors = np.linalg.eigh(kernel(landmarks).astype(np.float64))
    keep = values > 1e-8 * values.max()
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    z = np.ones((len(stretches), whiten.shape[1] + 1), dtype=np.float32)
    for i in range(0, len(z), 2048):
        z[i : i + 2048, :-1] = kernel(stretches[i : i + 2048]) @ whiten
    cost = np.where(signs > 0, 0.5 / (signs > 0).sum(), 0.5 / (signs < 0).sum())
    ridge = np.eye(z.shape[1]) * PENALTY
    ridge[-1, -1] = 1e-6
    w, active = np.zeros(z.shape[1]), np.ones(len(z), dtype=bool)
    for _ in range(40):
        share = (cost * active * z.shape[1]).astype(np.float32)
        gram = np.zeros((z.shape[1], z.shape[1]))
        for i in range(0, len(z), 2048):
            gram += z[i : i + 2048].T @ (z[i : i + 2048] * share[i : i + 2048, None])
        w = np.linalg.solve(gram + ridge, z.T @ (signs * share).astype(np.float32))
        now = signs * (z @ w.astype(np.float32)) < 1
        if (now == active).all():
            break
        active = now
    return kernel.expand(whiten @ w[:-1]), float(w[-1])


def cut(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    return symbols[places[:, None] + np.arange(REACH)]


def best_places(values: np.ndarray, most: int, least: float) -> list[int]:
    """The best places at least a stretch apart, best first."""
    out: list[int] = []
    for p in np.argsort(-values, kind="stable")[: 40 * most].tolist():
        if values[p] < least or len(out) == most:
            break
        if all(abs(p - q) >= PLACES for q in out):
            out.append(p)
    return out


def with_insertions(stretches: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copies with symbols put in: a separator between any two, or one other symbol somewhere within a letter run."""
    out = []
    for row in stretches:
        kind = rng.integers(3)
        spots = set(range(2, 7)) if kind == 0 else {int(rng.integers(2, 7))} if kind == 1 else {int(x) for x in rng.integers(2, 7, 2)}
        new: list[int] = []
        for i, s in enumerate(row.tolist()):
            if i in spots:
                new.append(0 if kind == 0 else int(rng.integers(0, 27)))
            new.append(s)
        out.append(new[:REACH])
    return np.array(out, dtype=np.int32)


def neighbours(symbols: np.ndarray, n: int) -> np.ndarray:
    """Each n neighbouring symbols as a number."""
    out = symbols[: len(symbols) - n + 1].astype(np.int64)
    for i in range(1, n):
        out = out << 6 | symbols[i : len(symbols) - n + 1 + i]
    return out


def telling(toxic: list[np.ndarray], clean: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of n neighbours that are in far more toxic documents than the toxic share of text lets expect, and how
    telling they are (a log-likelihood ratio)."""
    known, have = np.unique(np.concatenate([np.unique(neighbours(s, n)) for s in toxic]), return_counts=True)
    known, have = known[have >= 3], have[have >= 3]
    others = np.zeros(len(known))
    for s in clean:
        found = np.unique(neighbours(s, n))
        at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
        if len(known):
            others[at[known[at] == found]] += 1
    share = sum(map(len, toxic)) / (sum(map(len, toxic)) + sum(map(len, clean)))
    ratio = have / ((have + others) * share)
    value = have * np.log(ratio)
    keep = (value >= LEAST_TELLING) & (ratio * share >= 0.6)
    return known[keep], value[keep]


def fit_texts(toxic: list[str], clean: list[str], seed: int = 2026) -> Model:
    """The machine for these labelled texts. Without toxic or without clean ones it scores all texts alike, 0."""
    points = np.frombuffer("".join([*toxic, *clean]).lower().encode("utf-32-le", "replace"), dtype="<u4")
    found, counts = np.unique(points, return_counts=True)
    is_letter = np.array([chr(c).isalpha() for c in found.tolist()], dtype=bool)
    found, counts = found[is_letter], counts[is_letter]
    letters = np.sort(found[np.argsort(-counts, kind="stable")[: SYMBOLS - 2]])
    model = Model(letters, np.arange(1, len(letters) + 1), np.zeros(SYMBOLS**3, dtype=np.float32), 0.0)
    toxic, clean = [t for t in toxic if t], [t for t in clean if t]
    if not toxic or not clean:
        return model
    rng = np.random.default_rng(seed)
    coded = [[model.encode(t) for t in texts] for texts in (toxic, clean)]
    signs_of = {n: telling(*coded, n) for n in NEIGHBOURS}

    def suspicion(s: np.ndarray) -> np.ndarray:
        out = np.zeros(max(1, len(s) - REACH))
        for n, (known, weight) in signs_of.items():
            if len(known):
                found = neighbours(s, n)[: len(out)]
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                out[: len(found)] = np.maximum(out[: len(found)], np.where(known[at] == found, weight[at], 0.0))
        return out

    positive = []
    for s in coded[0]:
        value = suspicion(s)
        places = best_places(value, 6, 1e-6)
        positive.append(cut(s, np.array(places, dtype=np.int64)))
    positive = np.concatenate(positive)
    if not len(positive):
        return model
    positive = np.concatenate([positive, with_insertions(positive, rng)])
    negative = []
    for s in coded[1]:
        last = len(s) - REACH
        negative.append(cut(s, np.concatenate([rng.integers(0, last, 2), best_places(suspicion(s), 1, 0.0)]).astype(np.int64)))
    negative = np.concatenate(negative)
    for step in range(ROUNDS):
        half = LANDMARKS // 2
        landmarks = np.concatenate([rng.permutation(np.unique(positive, axis=0))[:half], rng.permutation(np.unique(negative, axis=0))[:half]])
        kernel = Kernel(landmarks)
        data, signs = np.concatenate([positive, negative]), np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        model.weights, model.bias = machine(kernel, landmarks, data, signs)
        if step < ROUNDS - 1:
            hard = [cut(s, np.array(best_places(model.stretches(s)[: len(s) - REACH], 2, -0.7), dtype=np.int64)) for s in coded[1]]
            negative = np.concatenate([negative, *hard])
    model.curve = logistic(*(np.array([model.evidence(s) for s in docs]) for docs in coded))
    return model


def logistic(high: np.ndarray, low: np.ndarray) -> tuple[float, ...]:
    """Coefficients of the logistic curve through two groups of rows, the last for the constant, with Platt's softened
    targets."""
    x = np.concatenate([high, low])
    y = np.concatenate([np.full(len(high), (len(high) + 1) / (len(high) + 2)), np.full(len(low), 1 / (len(low) + 2))])
    weight = np.concatenate([np.full(len(high), SHARE / len(high)), np.full(len(low), (1 - SHARE) / len(low))])
    design, ridge = np.hstack([x, np.ones((len(x), 1))]), 1e-5 * np.eye(x.shape[1] + 1)
    w = np.zeros(design.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        gradient = design.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge, gradient)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the labelled documents that are not held out: the `sample_toxic` toxic and `sample_clean` clean ones
    whose hashed ids are smallest, and at most `sample_chars` code points of each. These bound the sample."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter((fold(F.col("doc_id")) != 2) & F.col("label").isin(0, 1)).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 1").orderBy(*order).limit(sample_toxic).union(known.filter("label = 0").orderBy(*order).limit(sample_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.substring(F.col(text_col).cast("string"), 1, sample_chars).alias("text"))
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").filter("text is not null").collect(), key=lambda r: (r["doc_id"], r["text"]))
    return fit_texts([r["text"] for r in rows if r["label"]], [r["text"] for r in rows if not r["label"]])


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher: toxic likelier); an existing column of this name is replaced. Null and
    empty texts are scored as an empty text, repeated rows alike; an empty table gives an empty result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    plain = docs.drop("score")
    names = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.score(t or "") for t in batch.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "score"])

    return plain.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
