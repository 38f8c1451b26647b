"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a labelled text sample accepts exactly the sample's substrings. A text is
parsed against each of them into longest matches: a phrase runs on while the automaton has a transition and a new one
starts where it has none (a letter the sample lacks is a phrase of its own). The phrases for each letter, times the
logarithm of the sample's length, estimate the cross entropy; the language that needs the fewest bits wins.

Letters are lower-cased, and each run of other characters becomes one separator. Blocks of `BLOCK` symbols walk their
automata in step as NumPy arrays. A block is first parsed as if a phrase began with it; then the phrase that really
runs into it is followed until one begins where the first parse began one too, and from there on the two are the same.
So the phrases are those of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import bounded_batches, fold, read_table, release

#: Bounds of the labelled sample: documents of a language, code points of each, and languages (those with the most
#: labelled documents).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LANGS = 40, 600, 500
#: Symbols of a block.
BLOCK = 1024
#: Symbols whose transitions are a table; those of others, which few languages have, are sorted and searched.
DENSE = 252
#: The prediction for a text that is null or has no letter.
UNDETERMINED = "und"


def suffix_automaton(text: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton; state 0 is the start. Those of the first `DENSE` symbols flat: state * width
    + symbol gives the next state, 0 if there is none. Those of the others as sorted state * symbols + symbol, and the
    next state of each."""
    links, lengths, moves, last = [-1], [0], [{}], 0
    for c in text.tolist():
        new = len(moves)
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = links[p]
        if p >= 0:
            q = moves[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                twin = len(moves)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                moves.append(dict(moves[q]))
                links[q] = links[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = links[p]
        last = new
    width, rare = min(symbols, DENSE), {}
    flat = np.zeros(len(moves) * width, dtype=np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            if c < width:
                flat[state * width + c] = to
            else:
                rare[state * symbols + c] = to
    keys = sorted(rare)
    return flat, np.array(keys, dtype=np.int64), np.array([rare[k] for k in keys], dtype=np.int32)


class Model:
    """Languages in order, the code points of the alphabet, and each language's automaton and sample length."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        points = np.frombuffer("".join(samples.values()).lower().encode("utf-32-le", "replace"), dtype="<u4")
        letters, counts = np.unique(points, return_counts=True)
        letters = letters[np.array([chr(c).isalpha() for c in letters.tolist()], dtype=bool)] if len(letters) else letters
        self.letters = np.sort(letters)
        self.symbols = len(self.letters) + 2  # 0: separator, 1: a letter that no sample has
        self.dtype = np.min_scalar_type(self.symbols)
        self.automata = [suffix_automaton(self.encode(samples[k]), self.symbols) for k in self.langs]
        self.bits = np.array([math.log2(max(2, len(samples[k]))) for k in self.langs])  # of a phrase

    def encode(self, text: str) -> np.ndarray:
        """Symbols of the text: letters, and one separator for each run of other characters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        if not len(points):
            return np.zeros(0, dtype=self.dtype)
        table = self.table()
        out = table[np.minimum(points, len(table) - 1)]
        high = points >= len(table) - 1
        if high.any():
            found, at = np.unique(points[high], return_inverse=True)
            out[high] = np.array([self.symbol(c) for c in found.tolist()], dtype=self.dtype)[at]
        keep = out > 0
        keep[1:] |= out[:-1] > 0
        return out[keep]

    def symbol(self, point: int) -> int:
        at = int(np.searchsorted(self.letters, point))
        if at < len(self.letters) and self.letters[at] == point:
            return at + 2
        return int(chr(point).isalpha())

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.array([self.symbol(c) for c in range(0x600)] + [0], dtype=self.dtype)
        return self._table

    def step(self, k: int, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states in the automaton of language k, 0 where there is none."""
        flat, keys, targets = self.automata[k]
        width = min(self.symbols, DENSE)
        if not len(keys):
            if width == self.symbols:
                return flat[states * width + symbols]
            return np.where(symbols < width, flat[states * width + np.minimum(symbols, width - 1)], 0)
        out = flat[states * width + np.minimum(symbols, width - 1)]
        far = np.flatnonzero(symbols >= width)
        wanted = states[far].astype(np.int64) * self.symbols + symbols[far]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out[far] = np.where(keys[at] == wanted, targets[at], 0)
        return out


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each encoded text under each language: texts x languages."""
    cuts = [(d, i, t[i : i + BLOCK]) for d, t in enumerate(texts) for i in range(0, len(t), BLOCK)]
    cuts.sort(key=lambda x: -len(x[2]))
    total = np.zeros((len(texts), len(model.langs)), dtype=np.int64)
    if not cuts:
        return total
    owner = np.array([d for d, _, _ in cuts])
    lengths = np.array([len(b) for _, _, b in cuts])
    number = {(d, i): at for at, (d, i, _) in enumerate(cuts)}
    after = np.array([number.get((d, i + BLOCK), -1) for d, i, _ in cuts])  # the block that follows in the text
    columns = np.zeros((lengths[0], len(cuts)), dtype=model.dtype)  # a row holds each block's symbol at one place
    for at, (_, _, b) in enumerate(cuts):
        columns[: len(b), at] = b
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # blocks longer than each place
    for k in range(len(model.automata)):
        state, begun = np.zeros(len(cuts), dtype=np.int32), np.zeros(columns.shape, dtype=bool)
        for place, m in enumerate(active.tolist()):
            begun[place, :m], state[:m] = advanced(model, k, state[:m], columns[place, :m])
        starts = begun.sum(axis=0)
        came = np.flatnonzero(after >= 0)
        entering = np.zeros(len(cuts), dtype=np.int32)  # the state that each block was last entered with
        while len(came):  # once, but for blocks that no phrase begins in
            came = came[entering[after[came]] != state[came]]
            to = after[came]
            entering[to] = state[came]
            came = followed(model, k, columns, lengths, to, entering[to], begun, starts, state)
            came = came[after[came] >= 0]
        np.add.at(total[:, k], owner, starts)
    return total


def advanced(model: Model, k: int, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a phrase begins with each symbol, and the states after it."""
    out = model.step(k, state, symbols)
    ended = out == 0
    at = np.flatnonzero(ended)
    out[at] = model.step(k, np.zeros(len(at), dtype=np.int32), symbols[at])
    return ended | (state == 0), out


def followed(model: Model, k: int, columns: np.ndarray, lengths: np.ndarray, blocks: np.ndarray, state: np.ndarray, begun: np.ndarray, starts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Parse these blocks from the states they are entered with, up to where a known phrase begins; `begun`, `starts` and
    `last`, the state at a block's end, are put right. The blocks whose last state has changed."""
    changed, place = [], 0
    while len(blocks):
        over = lengths[blocks] <= place
        if over.any():
            ended = blocks[over]
            other = last[ended] != state[over]
            last[ended] = state[over]
            changed.append(ended[other])
            blocks, state = blocks[~over], state[~over]
            continue
        begins, state = advanced(model, k, state, columns[place, blocks])
        known = begun[place, blocks]
        starts[blocks] += begins.astype(np.int64) - known
        begun[place, blocks] = begins
        apart = ~(begins & known)
        blocks, state, place = blocks[apart], state[apart], place + 1
    return np.concatenate([np.zeros(0, dtype=np.int64), *changed])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_langs: int = SAMPLE_LANGS) -> Model:
    """Learn from the labelled rows that are not held out: of the `sample_langs` languages with the most of them the
    `sample_docs` documents each whose hashed ids are smallest, and `sample_chars` code points of each. The sample is
    bounded by these three; fitting is on it alone. Rows of other languages are predicted as the nearest of these.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_langs).collect()}
    if not counts:
        return Model({})
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * sample_docs / n))))
    near = rows.filter(unit < F.try_element_at(share, F.col("lang"))).select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("text"))
    first = near.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))).filter(F.col("at") <= sample_docs)
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["at"])):
        samples[r["lang"]].append(r["text"])
    return Model({k: "\n".join(v) for k, v in samples.items() if v})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, and no other change; existing columns of these names are replaced.

    lang_pred is `und` where the text is null or has no letter, or the model knows no language; its score is 0 there.
    Else the score is the winner's weight among the languages, each weighing 2 to the power of minus its bits:
    its phrases, times the logarithm of its sample's length. Equal ones go to the language that sorts first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score")
    names = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text_col)).cast(pa.string()).to_pylist()]
            langs, scores = [], []
            at = 0
            while at < len(texts):  # a bounded number of code points at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 4_000_000):
                    size += len(texts[end])
                    end += 1
                encoded = [known.encode(t) for t in texts[at:end]]
                counts = phrases(known, encoded) * known.bits if known.langs else np.zeros((end - at, 1))
                best = counts.argmin(axis=1)
                lead = np.minimum(counts - counts.min(axis=1, keepdims=True), 1000.0)
                weights = 1.0 / np.exp2(-lead).sum(axis=1)
                for i, e in enumerate(encoded):
                    ok = bool(known.langs) and bool((e > 0).any())
                    langs.append(known.langs[best[i]] if ok else UNDETERMINED)
                    scores.append(float(weights[i]) if ok else 0.0)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
        release()

    return plain.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
