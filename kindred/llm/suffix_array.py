"""Two-stage suffix sorting of many short byte strings at once, with NumPy.

A suffix is direct if it is smaller than its successor (the suffix one byte later), or ends its string. Only direct
suffixes are sorted by comparing bytes. The rest are induced by one scan over the buckets of first bytes, in ascending
order: each suffix scanned puts its predecessor, if that is not direct, at the end of the front part of the
predecessor's bucket; a bucket's direct suffixes follow its front part.
"""

from __future__ import annotations

import numpy as np

#: Bits of a symbol (0: the string's end; byte + 1), and symbols packed in a word.
BITS, PACKED = 9, 7


class Strings:
    """Rows of `bytes_` (a matrix) from column `begin` (a number for each row) up to column `end`.

    `depth` bounds how many leading symbols direct suffixes are compared by; induced ones are then in order of at
    least as many. Without it the order is complete."""

    def __init__(self, bytes_: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int | None = None):
        n, width = bytes_.shape
        self.begin, self.end, self.width = begin.astype(np.int64), end.astype(np.int64), width + 1
        self.depth = -(-(depth or width + 1) // PACKED)  # in words
        self.symbols = np.zeros((n, width + 1), dtype=np.uint16)
        inside = np.arange(width) < end[:, None]
        self.symbols[:, :width] = (bytes_.astype(np.uint16) + 1) * inside
        self.words = np.zeros((n, width + 1 + PACKED * self.depth), dtype=np.int64)  # the symbols from each column on
        for i in range(PACKED):
            self.words[:, : width + 1 - i] |= self.symbols[:, i:].astype(np.int64) << BITS * (PACKED - 1 - i)
        self.direct = np.zeros((n, width + 1), dtype=bool)
        self.direct[:, width] = end == width
        for c in range(width - 1, -1, -1):
            here, after = self.symbols[:, c], self.symbols[:, c + 1]
            self.direct[:, c] = (here < after) | ((here == after) & self.direct[:, c + 1]) | (end == c)

    def word(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The packed symbols at a place, at most `depth` symbols past the end."""
        return self.words.ravel()[rows * self.words.shape[1] + columns]

    def sort(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all suffixes that begin before column `wanted`, in order of their bytes.

        Sorted with them are the later ones up to each row's first direct one, from which others are induced."""
        n, width = self.symbols.shape
        later = self.direct[:, wanted:].argmax(axis=1) + wanted if n else np.zeros(0, dtype=np.int64)
        last = np.minimum(np.where(self.direct[np.arange(n), later], later, width), self.end)
        columns = np.arange(width)
        part = (columns >= self.begin[:, None]) & (columns <= last[:, None])
        rows, at = np.nonzero(part & self.direct)
        order = np.lexsort([self.word(rows, at + PACKED * j) for j in range(self.depth - 1, -1, -1)])
        flat, symbols, direct = (rows * width + at)[order], self.symbols.ravel(), self.direct.ravel()
        heads = symbols[flat]
        present = np.unique(self.symbols[part])
        cut = dict(zip(present.tolist(), np.searchsorted(heads, [present, present + 1], side="left").T.tolist(), strict=True))
        pending: dict[int, list[np.ndarray]] = {c: [] for c in cut}
        out = []
        for c, (a, b) in cut.items():
            found = list(pending.pop(c))
            fresh = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            while len(fresh):  # runs of one byte: predecessors in the bucket itself
                before = self.predecessors(fresh)
                fresh = before[symbols[before] == c]
                found.append(fresh)
            found.append(flat[a:b])
            bucket = np.concatenate(found)
            out.append(bucket)
            before = self.predecessors(bucket)
            before = before[~direct[before] & (symbols[before] > c)]
            if len(before):
                heads_ = symbols[before]
                by = np.argsort(heads_, kind="stable")
                before, heads_ = before[by], heads_[by]
                edges = np.flatnonzero(np.diff(heads_)) + 1
                for group in np.split(before, edges):
                    pending[int(symbols[group[0]])].append(group)
        flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
        rows, at = flat // width, flat % width
        keep = at < wanted
        return rows[keep], at[keep]

    def predecessors(self, flat: np.ndarray) -> np.ndarray:
        rows = flat // self.width
        return flat[flat - rows * self.width > self.begin[rows]] - 1

    def common_prefixes(self, rows: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """Leading bytes that each suffix but the first has in common with the one before it, counted up to `most`."""
        same, out = np.ones(max(0, len(rows) - 1), dtype=bool), np.zeros(max(0, len(rows) - 1), dtype=np.int64)
        for j in range(0, min(most, PACKED * self.depth), PACKED):
            word = self.word(rows, at + j)
            apart = word[1:] ^ word[:-1]
            out += PACKED * (same & (apart == 0))
            ended = np.flatnonzero(same & (apart != 0))
            for i in range(1, PACKED):
                out[ended] += apart[ended] >> BITS * (PACKED - i) == 0
            same &= apart == 0
        length = self.end[rows] - at  # beyond their ends all suffixes are alike
        return np.minimum(np.minimum(out, most), np.minimum(length[1:], length[:-1]))
