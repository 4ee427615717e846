"""BPE encoding and decoding by a tokenization automaton.

The states are the tokens (which of them was emitted last) and a start; an arc emits the next token. The automaton starts with one
state per symbol and all arcs between them. Each merge, in order of rank, puts in a gadget: where a path left, right is still there,
the merged token gets a state, with the arcs that the state of its right half has at that moment, and arcs into it from wherever
an arc of its left half comes; then the state of the left half loses the arc of the right half. States and arcs that are copied
later no longer have what was cut before.

The finished table holds, for each state, the arcs that it lacks; all others are there by default. Arcs are numbered in the order
of the tree in which a token hangs below its left half, older ones first, so that what one gadget cuts is one range of numbers:
for every token that still showed that half on its left side when the gadget came.

A word is read once, symbol by symbol. At each place the tokens that end there are those that the symbol automaton (Aho-Corasick
over the tokens' spellings) reports, and exactly one of them has an arc from the state of the place where it begins: what was
read so far has just one path. So no place is left again, and the path is read off at the end. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: What a Python worker keeps at most: encoded words, encoded pieces of words.
WORDS, PARTS = 500_000, 100_000
# Fixed value: how the tokenizer file's pre-tokenizer splits, over text without white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
#: White space of the tokenizer file's normalizer; str.split() would also split at U+001C to U+001F.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: Added to the letter that ends a word.
_END = 0x1000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tree:
    """Tokens below one of their halves. Numbers are dealt below first, older children first, so that a token and its children from
    some age on, with all below them, have a range of numbers."""

    def __init__(self, half: dict[int, int], born: dict[int, int], tokens: list[int]):
        self.children: dict[int, list[int]] = {}
        tops = []
        for t in sorted(tokens, key=lambda t: born.get(t, -1)):
            self.children.setdefault(half[t], []).append(t) if t in half else tops.append(t)
        self.number: dict[int, int] = {}
        self.first: dict[int, int] = {}
        for top in tops:
            stack = [(top, False)]
            while stack:
                t, done = stack.pop()
                if done:
                    self.number[t] = len(self.number)
                else:
                    self.first[t] = len(self.number)
                    stack.append((t, True))
                    stack += [(c, False) for c in reversed(self.children.get(t, []))]
        self.ages = {t: [born[c] for c in cs] for t, cs in self.children.items()}

    def since(self, token: int, rank: int) -> int:
        """The least number of the range of ``token`` and its children of ``rank`` and younger."""
        cs = self.children.get(token, [])
        i = bisect_right(self.ages.get(token, []), rank - 1)
        return self.first[cs[i]] if i < len(cs) else self.number[token]


class Automaton:
    """Compiled from a vocabulary (token -> id) and merges in order of rank; ``end`` marks tokens that end a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.label = {i: t for t, i in vocab.items()}
        self.cut: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            self._gadget(rank, vocab[left], vocab[right], vocab[left + right])
        symbols = {i for t, i in vocab.items() if len(self._spelled(t)) == 1}
        self._tabulate([i for i in vocab.values() if i in self.born or i in symbols])

    def _spelled(self, token: str) -> str:
        """A token as symbols: one letter each, the last one marked where the token ends a word."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def _path(self, a: int, b: int) -> bool:
        """Whether the gadgets so far left an arc ``b`` at the state ``a``: copies are followed back to what they were made of,
        the younger one first, and must not meet a cut that is older than the copy."""
        before = len(self.cut) + len(self.born) + 1
        while True:
            rank = self.cut.get((a, b))
            if rank is not None and rank < before:
                return False
            age_a, age_b = self.born.get(a, -1), self.born.get(b, -1)
            if age_a < 0 and age_b < 0:
                return True
            if age_a > age_b:
                before, a = age_a, self.right[a]
            else:  # of a rank's own places, the one further left was merged
                before, b = age_b + 1, self.left[b]

    def _gadget(self, rank: int, left: int, right: int, merged: int) -> None:
        if merged in self.born:
            raise ValueError(f"two merges make {self.label[merged]!r}")
        if self._path(left, right):
            self.left[merged], self.right[merged], self.born[merged] = left, right, rank
            self.cut[left, right] = rank

    def _tabulate(self, tokens: list[int]) -> None:
        """The table: of each state the ranges of arc numbers that it lacks."""
        inner = [t for t in tokens if not self._ends(t)]
        arcs, states = Tree(self.left, self.born, tokens), Tree(self.right, self.born, inner)
        rows = np.array([(states.since(u, r + 1), states.number[u], arcs.since(v, r), arcs.number[v] + 1) for (u, v), r in self.cut.items()], np.int64).reshape(-1, 4)
        n = rows[:, 1] - rows[:, 0] + 1
        state = K.ranges(rows[:, 0], rows[:, 1] + 1)
        low, high = np.repeat(rows[:, 2], n), np.repeat(rows[:, 3], n)
        order = np.argsort(state * (1 << 32) + low, kind="stable")
        state, low, high = state[order], low[order], high[order]
        reach = np.maximum.accumulate(high + state * (1 << 32)) - state * (1 << 32)
        new = np.ones(len(state), bool)
        new[1:] = (state[1:] != state[:-1]) | (low[1:] > reach[:-1])
        starts = np.flatnonzero(new)
        ends = np.concatenate((starts[1:], [len(state)])) - 1
        bounds = np.stack((low[starts], reach[ends]), 1).ravel().astype(np.int32) if len(starts) else np.zeros(0, np.int32)
        self.bounds = array("i", bounds.tobytes())
        of_state = 2 * np.searchsorted(state[starts], np.arange(len(inner) + 1))
        self.row = {t: (int(of_state[k]), int(of_state[k + 1])) for t, k in states.number.items()}
        self.arc = arcs.number
        self.symbols = ahocorasick.Automaton()
        for t in tokens:
            word = self._spelled(self.label[t])
            self.symbols.add_word(word, (len(word), t, self.arc[t], *self.row.get(t, (0, 0))))
        self.symbols.make_automaton()

    def _ends(self, token: int) -> bool:
        return bool(self.end) and self.label[token].endswith(self.end) and len(self.label[token]) > len(self.end)

    def follows(self, left: int, right: int) -> bool:
        """Whether the state of ``left`` has the arc of ``right``."""
        lo, hi = self.row[left]
        return not (bisect_right(self.bounds, self.arc[right], lo, hi) - lo) & 1

    def encode(self, word: str) -> list[int]:
        """Ids of a word in the letters of :func:`byte_letters`."""
        n, bounds = len(word), self.bounds
        if self.end:
            word = word[:-1] + chr(ord(word[-1]) + _END)
        came: list = [None] * n  # of each place: the arc that leads there, as it stands in the symbol automaton
        for last, arc in self.symbols.iter(word):
            if came[last] is None:
                size = arc[0]
                if size <= last:
                    before = came[last - size]
                    if before is None or (bisect_right(bounds, arc[2], before[3], before[4]) - before[3]) & 1:
                        continue
                came[last] = arc
        out, at = [], n - 1
        while at >= 0:
            if came[at] is None:
                raise ValueError(f"no path spells {word!r}")
            out.append(came[at][1])
            at -= came[at][0]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> list[str]:
        return list(map(self.label.__getitem__, ids))


def unsettled(normal, split) -> regex.Pattern:
    """A class of the code points on which other tables of Unicode could differ from Python's: all that Unicode 3.2 lacks, and those
    on which ``normal`` and ``split``, functions of texts, do differ."""
    old = unicodedata.ucd_3_2_0
    same = [chr(c) for c in range(0x80, 0x30000) if old.category(chr(c)) not in ("Cn", "Cs", "Co")]
    check = [c for c in same if not ("㐀" <= c <= "鿿" or "가" <= c <= "힣" or c >= "\U00020000")]
    mine = [normalised(c) for c in check]
    theirs = normal("\x01".join(check)).split("\x01")
    bad = {c for c, a, b in zip(check, mine, theirs) if a != b}
    if len(theirs) != len(check):
        bad = set(check)
    for head in "a!":
        joined = " ".join([head + c for c in check])
        ours = {m.span() for word in re.finditer(r"[^ ]+", joined) for m in PIECES.finditer(joined, *word.span())}
        for lo, _ in ours.symmetric_difference(split(joined)):
            if not check[lo // 3].isspace():
                bad.add(check[lo // 3])
    good = np.zeros(0x110000, bool)
    good[:0x80] = True
    good[[ord(c) for c in same if c not in bad]] = True
    edges = np.flatnonzero(np.diff((~good).astype(np.int8), prepend=0, append=0))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())) + "]")


def normalised(text: str) -> str:
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma


class Codec:
    """Encodes and decodes texts as the tokenizer of a file of the ``tokenizers`` library.

    Normalizing and splitting follow Python's tables of Unicode. A text with a code point on which the library's tables could
    differ is normalized and split by the library; words are encoded by the automaton all the same.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(vocab, merges, model["end_of_word_suffix"] or "")
        self.letters = byte_letters()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.automaton.label |= {i: t for t, i in self.special.items()}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.unsettled = unsettled(self.normalizer.normalize_str, lambda t: {at for _, at in self.splitter.pre_tokenize_str(t)})

    def _piece(self, plain: str) -> list[int]:
        """The ids of a piece in byte letters."""
        known = self.pieces.get(plain)
        if known is None:
            known = self.automaton.encode(plain)
            if len(self.pieces) >= PARTS:
                self.pieces.clear()
            self.pieces[plain] = known
        return known

    def _word(self, word: str) -> bytes:
        """The ids of a word without white space."""
        ids = []
        if word.isascii() and word.isalpha():  # a word of one piece is kept once
            ids = self.automaton.encode(word)
        else:
            for piece in PIECES.findall(word):
                ids += self._piece(piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode())))
        out = np.array(ids, "<u4").tobytes()
        if len(self.known) >= WORDS:
            self.known.clear()
        self.known[word] = out
        return out

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii() and self.unsettled.search(text):
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [np.array(self._piece(p), "<u4").tobytes() for p, _ in pieces]
        text = normalised(text)
        words = [w for w in _SPACES.split(text) if w] if _ODD.search(text) else text.split()
        get = self.known.get
        return [known if (known := get(w)) is not None else self._word(w) for w in words]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        parts = []
        for k, piece in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                parts.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                parts += self._plain(piece)
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.automaton.decode(ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One automaton for each file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _run(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
        for batch in batches:
            _, off = K.buffers(batch.column("text"))
            for lo, hi in K.pieces(off):  # what is held follows from a piece's size, not from a batch's
                ns, ids, texts = [], [], []
                for x in batch.column("text").slice(lo, hi - lo):
                    b = c.encode(x.as_py() or "")
                    row = np.frombuffer(b, "<u4")
                    t = c.decode(row)
                    ns.append(len(row))
                    ids.append(hashlib.sha256(b).hexdigest() if digest else row.astype(np.int32))
                    texts.append(hashlib.sha256(t.encode()).hexdigest() if digest else t)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ns, pa.int64()), pa.array(ids, kinds[0]), pa.array(texts, kinds[1])], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of ``docs`` (doc_id, text), by the tokenizer file at ``path``.

    Null text counts as empty: no ids. Rows stay in their partitions, so nothing is shuffled. ``path`` must be there on
    every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, decoded string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_run(path, False), schema)


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``, also for null and repeated doc_ids: a null text counts as empty, and long ones are encoded one by one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids string, decoded string"
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_run(path, True), schema)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
