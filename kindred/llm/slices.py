"""Words of long texts, slice by slice, so that a text's words are never all in memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a slice; one goes on to the end of the word that it would cut.
SLICE = 1 << 20
#: The bytes of letters, digits and characters beyond ASCII as they are, A-Z as a-z, all others as spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_LETTER = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, gap: re.Pattern[bytes], size: int = SLICE) -> Iterator[bytes]:
    """The text in stretches of about `size` bytes that end before a `gap` or with the text."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def letter_words(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the UTF-8 text, A-Z in lower case, in lists."""
    for part in slices(text, NO_LETTER, size):
        yield part.translate(FOLDED).split()


def blank_words(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words between white space of ASCII, as they are, in lists."""
    for part in slices(text, BLANK, size):
        yield part.split()
