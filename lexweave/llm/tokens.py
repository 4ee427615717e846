"""Words of a text as small numbers: words of letters, digits and characters beyond ASCII, A-Z in lower case.

A text is read in pieces of bounded size, so that what a task holds for a long one is a few bytes a word, not an object for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np

#: The same words, and what stands between them, as patterns, for text in which A-Z are lower case already.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text split at once.
PIECE = 1 << 20

_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes | memoryview, size: int | None = None) -> Iterator[bytes]:
    """The text with words in lower case and a space for each byte between them, cut between words."""
    size = size or PIECE
    rest = b""
    for a in range(0, len(text), size):
        part = rest + bytes(text[a : a + size]).translate(_LOWERED)
        cut = len(part) if a + size >= len(text) else part.rfind(b" ") + 1
        rest = part[cut:]
        yield part[:cut]


def numbered(text: bytes | memoryview, number: Mapping[bytes, int], size: int | None = None) -> Iterator[np.ndarray]:
    """The number of each word in order, 0 for words that ``number`` lacks."""
    for part in pieces(text, size):
        words = part.split()
        yield np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words))


def split(text: str) -> list[str]:
    """All words of a short text."""
    return [w.decode() for part in pieces(text.encode()) for w in part.split()]
