"""Hashing of words, word n-grams and byte strings over whole Arrow batches with numpy.

A batch's texts lie one after another in one buffer; hashes are 64 bits wide and made from running sums of a polynomial,
so that the cost is a few passes over the buffer and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once, about; a longer text is hashed in parts.
PIECE = 1 << 20
#: Bytes of text whose hashes are packed together, about.
SLICE = 1 << 23


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of the base and of its inverse, kept for the longest piece so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n + n // 4), _powers(_BASE_INVERSE, n + n // 4)
        return cls.up, cls.down


class Spans:
    """Hashes of spans [start, end) of a buffer, equal for equal bytes wherever they stand.

    A polynomial over single bytes, modulo 2^64, is the same for some regular strings of a thousand bytes and more (Thue-Morse).
    From ``LONG`` bytes on, a second one over mixed strings of eight bytes is put in, which has no such pairs.
    """

    LONG = 64

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.get(len(data) + 1)
        self.data, self.deep = data, None
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        long = end - start >= self.LONG
        if long.any():
            if self.deep is None:
                eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, 8)).view("<u8").ravel()
                up, _ = _Powers.get(len(eights))
                self.deep = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(eights) * up[: len(eights)])))
            s, e = start[long], end[long] - 7
            h[long] = mixed(h[long] ^ ((self.deep[e] - self.deep[s]) * self.down[s]))
        return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8), off


def pieces(off: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, ``PIECE`` if none is given."""
    size = size or PIECE
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Part:
    """Rows [a, b) of a batch, or a part of the long text of row a: bytes, offsets, the place of its first word in the text, and whether more
    of the text follows."""

    a: int
    b: int
    data: np.ndarray
    off: np.ndarray
    word: int = 0
    more: bool = False


def parts(data: np.ndarray, off: np.ndarray, shared: int) -> Iterator[Part]:
    """A batch's rows in parts of about ``PIECE`` bytes. A text of more than two comes in several, cut between words, each with the last
    ``shared`` words of the one before, so that every run of shared + 1 words is whole in some part. Only a part with words this long that it
    has no more than ``shared`` of them grows on."""
    for a, b in pieces(off):
        x, y, end, word = int(off[a]), int(off[a]) + PIECE, int(off[b]), 0
        while b == a + 1 and end - x > 2 * PIECE and y < end:
            if not _IS_SPACE[data[y]]:
                y += 1
                continue
            starts = words(data[x:y], np.array([0, y - x])).start
            if len(starts) <= shared:
                y += PIECE
                continue
            yield Part(a, b, data[x:y], np.array([0, y - x]), word, True)
            word += len(starts) - shared
            x = x + int(starts[len(starts) - shared]) if shared else y
            y = max(x + PIECE, y + 1)
        yield Part(a, b, data[x:end], np.clip(off[a : b + 1], x, end) - x, word)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of text: a batch's rows are counted, its bytes are not, so what a task
    holds must not follow from a batch."""
    for batch in batches:
        _, off = buffers(batch.column("text"))
        for a, b in pieces(off, size):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """The words of a range of rows: where they start and end in ``data``, and the row that each is in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row: its first word's place; one more for the end

    def hashes(self) -> np.ndarray:
        return Spans(self.data).hashes(self.start, self.end)


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    """The words of consecutive texts ``data[off[i]:off[i + 1]]``; none runs over the end of a text."""
    n_rows, lens = len(off) - 1, np.diff(off)
    raw = data[off[0] : off[-1]]
    apart = np.full(len(raw) + n_rows, 32, np.uint8)  # a space after each text
    apart[np.arange(len(raw)) + np.repeat(np.arange(n_rows), lens)] = _LOWER[raw] if lower else raw
    edges = np.flatnonzero(np.diff(_IS_SPACE[apart].astype(np.int8), prepend=1, append=1))
    start, end = edges[::2], edges[1::2]
    row_start = off - off[0] + np.arange(n_rows + 1)
    return Words(apart, start, end, np.searchsorted(start, row_start))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k hashes in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + h[i : n + i]
    return mixed(out)


def in_row(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` places can start k words of the same row."""
    ok = np.zeros(n + 1, np.int32)
    counts = np.diff(first) - k + 1
    start, counts = first[:-1][counts > 0], counts[counts > 0]
    np.add.at(ok, start, 1)
    np.add.at(ok, start + counts, -1)
    return np.cumsum(ok[:-1]) > 0


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w places: the place of its least hash, the first if several are equal in their leading bits."""
    n = len(h)
    bits = U(24 if n <= 1 << 24 else int(n).bit_length())  # one number of compared bits for all but giant texts
    key = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    return (key & ((U(1) << bits) - U(1))).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0], ..., end[0] - 1, start[1], ..., end[1] - 1, ..."""
    n = end - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
