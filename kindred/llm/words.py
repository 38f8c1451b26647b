"""Token ids of whole texts, each distinct word encoded once for a worker."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from itertools import chain, islice

import numpy as np

#: Distinct words that a worker remembers; beyond, it starts anew. Bounds its memory, not its results.
MEMORY = 900_000
#: Words joined for one call of a tokenizer.
JOINED = 20_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lead bytes of characters from U+0300 on.
FROM_0300 = re.compile(rb"[\xcc-\xff]")
_LOCAL = threading.local()

Encoded = tuple[np.ndarray, np.ndarray]  # all ids, and how many each word has


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def whole(word: bytes) -> tuple[bytes, bytes]:
    return word, b""


class Words:
    """Ids of texts from a function that encodes a list of words, one that splits a text into them, and one that
    parts a word in two whose ids make up the word's ids (the second part empty: don't)."""

    def __init__(self, encode: Callable[[list[str]], Encoded], split: Callable[[bytes], list[bytes]], part: Callable[[bytes], tuple[bytes, bytes]] = whole, memory: int = MEMORY):
        self.encode, self.split, self.part, self.memory = encode, split, part, memory
        self.clear()

    def clear(self) -> None:
        self.at, self.known, self.used = _Numbers(), 0, 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.begin, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    def store(self, numbers: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), dtype=np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[numbers] = self.used + np.cumsum(lengths) - lengths
        self.size[numbers] = lengths
        self.used += len(flat)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        begin, size = self.begin[numbers], self.size[numbers]
        return self.ids[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]

    def learn(self) -> None:
        """Encode the words numbered since the last call."""
        simple, joint, parts = [], [], []
        at = self.known
        while at < len(self.at):  # parts are numbered as they come, and learned in the same go
            for word in list(islice(self.at, at, None)):
                head, tail = self.part(word)
                if tail:
                    joint.append(at)
                    parts += [self.at[head], self.at[tail]]
                else:
                    simple.append((at, word))
                at += 1
        if len(self.at) > len(self.begin):
            room = np.zeros(max(len(self.at), len(self.begin)), dtype=np.int64)
            self.begin, self.size = np.concatenate([self.begin, room]), np.concatenate([self.size, room])
        if simple:
            self.store(np.array([n for n, _ in simple]), *self.encode([w.decode() for _, w in simple]))
        if joint:
            pairs = np.array(parts)
            self.store(np.array(joint), self.gather(pairs), self.size[pairs].reshape(-1, 2).sum(axis=1))
        self.known = len(self.at)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.at) > self.memory:
            self.clear()
        numbers = []
        for t in texts:
            words = self.split(t.encode("utf-8", "replace"))
            numbers.append(np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words)))
        if len(self.at) > self.known:
            self.learn()
        return [self.gather(n) for n in numbers]


def own_store() -> dict:
    """What this worker keeps between batches and tasks."""
    return _LOCAL.__dict__.setdefault("known", {})


def listed(found: list[list[int]]) -> Encoded:
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum())), lengths


def lower_words(text: bytes) -> list[bytes]:
    """The words between ASCII white space. A-Z go to lower case, unless the text may hold a special token or has
    characters from U+0300 on, where lower case could compose with a mark that upper case does not."""
    if b"<|" not in text and (text.isascii() or not FROM_0300.search(text)):
        text = text.lower()
    return text.split()


def ending(word: bytes) -> tuple[bytes, bytes]:
    """A word and the punctuation at its end, if a letter stands before it: then the tokenizer's pattern cuts there."""
    head = word.rstrip(PUNCTUATION)
    if len(head) == len(word) or not head or b"<|" in word:
        return word, b""
    last = head.decode()[-1].lower()  # may become two characters, a letter and a mark
    return (head, word[len(head) :]) if len(last) == 1 and last.isalpha() else (word, b"")


def word_tokenizer(path: str, memory: int = MEMORY) -> Words:
    """The worker's `Words` for a `tokenizers` file whose tokenizer ignores case and white space, as `word_bpe_49k.json`
    does. Many words go through it in one call, a special token between them."""
    known = own_store()
    if path not in known:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        number, token = max((n, t.content) for n, t in tokenizer.get_added_tokens_decoder().items() if t.special)

        def encode(words: list[str]) -> Encoded:
            flat, lengths = [], []
            plain = np.array(["<|" not in w for w in words])
            for i in range(0, len(words), JOINED):
                part, simple = words[i : i + JOINED], plain[i : i + JOINED]
                if not simple.all():
                    a, b = listed([e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)])
                else:
                    ids = np.array(tokenizer.encode(token.join(part), add_special_tokens=False).ids, dtype=np.uint32)
                    cut = np.flatnonzero(ids == number)
                    b = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                    a = np.delete(ids, cut)
                flat.append(a)
                lengths.append(b)
            return np.concatenate(flat), np.concatenate(lengths)

        known[path] = Words(encode, lower_words, ending)
    known[path].memory = memory
    return known[path]
