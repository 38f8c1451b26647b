"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each character its output links list every piece that ends there, longest first;
each relaxes the best score at that place. A character that has no piece of its own may also be spelled in bytes.
The best-scoring segmentation follows from the places' back pointers. Of equal scores the longest last piece wins.

No piece has a space anywhere but at its beginning, so every segmentation cuts before a space that follows another
character. Texts are cut there, and each distinct stretch is segmented once for a worker.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, read_table
from kindred.llm.words import Words, listed, own_store

#: How the pieces write a space, and how far below the lowest piece a character spelled in bytes scores.
SPACE, BYTES_BELOW = "▁", 10.0
#: Distinct stretches that a worker remembers.
MEMORY = 250_000


class Automaton:
    """goto, fail and output links over the pieces; a state's own piece is (length, score, id)."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]
        self.byte_ids = byte_ids
        for text, score, number in pieces:
            state = 0
            for c in text:
                to = self.goto[state].get(c)
                if to is None:
                    to = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                state = to
            self.piece[state] = (len(text), score, number)
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)  # the nearest state with a piece among this one and its suffixes
        ready = deque([0])
        while ready:
            state = ready.popleft()
            self.output[state] = state if self.piece[state] else self.output[self.fail[state]] if state else 0
            for c, to in self.goto[state].items():
                back = self.fail[state]
                while state and back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[to] = self.goto[back].get(c, 0) if state else 0
                ready.append(to)
        self.spelled = min((s for _, s, _ in pieces), default=0.0) - BYTES_BELOW
        self.divisible = not any(" " in text.lstrip(" ") for text, _, _ in pieces)

    def encode(self, text: str) -> list[int]:
        """Ids of the best-scoring segmentation of the whole text, spaces written as they are."""
        goto, fail, output, piece, state = self.goto, self.fail, self.output, self.piece, 0
        best, last = [0.0], [(0, -1)]  # at each place: the score, and the length and id of the piece that ends there
        for i, c in enumerate(text):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            top, how, at = float("-inf"), (1, -1), output[state]
            while at:
                length, score, number = piece[at]
                if (total := best[i + 1 - length] + score) > top:
                    top, how = total, (length, number)
                at = output[fail[at]]
            if not piece[goto[0].get(c, 0)] and (total := best[i] + self.spelled) > top:
                top, how = total, (1, -1)
            best.append(top)
            last.append(how)
        out, at = [], len(text)
        while at:
            length, number = last[at]
            out += [number] if number >= 0 else [self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "replace"))]
            at -= length
        return out[::-1]


def pieces_of(path: str) -> tuple[list[tuple[str, float, int]], list[int], list[bytes]]:
    """A model file's pieces (text, score, id), the ids of the 256 bytes, and the bytes that each id stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, spelled = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i).replace(SPACE, " ")
        if model.is_byte(i):
            value = int(text[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            pieces.append((text, model.get_score(i), i))
            spelled.append(text.encode())
    return pieces, byte_ids, spelled


def encoder(path: str) -> Words:
    """The worker's encoder. A space is put before a text that is not empty."""
    known = own_store()
    if path not in known:
        automaton = Automaton(*pieces_of(path)[:2])
        stretch = re.compile(rb" +[^ ]*") if automaton.divisible else re.compile(rb"(?s).+")
        known[path] = Words(lambda words: listed([automaton.encode(w) for w in words]), lambda text: stretch.findall(b" " + text) if text else [], memory=MEMORY)
    return known[path]


def spelling(path: str) -> list[bytes]:
    known = own_store()
    if ("spelling", path) not in known:
        known["spelling", path] = pieces_of(path)[2]
    return known["spelling", path]


def decode(ids: np.ndarray, spelled: list[bytes]) -> str:
    """The text of the ids, without the space put before it."""
    return b"".join(map(spelled.__getitem__, ids.tolist())).removeprefix(b" ").decode("utf-8", "replace")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, ids`: the ids of each row's whole text. Null and empty texts have no ids. Rows stay as they come."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = encoder(model).batch([t or "" for t in batch.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, dtype=np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """`doc_id, ids, text`: the text that each row's ids stand for."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [decode(flat[a:b], spelling(model)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the ids of every document, and of the text decoded from them."""
    model = model_path()
    decoded = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), model), model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_crc32"),
        F.octet_length("text").cast("long").alias("decoded_bytes"), F.sha2("text", 256).alias("decoded_sha256"),
    )
