"""Removal of repeated passages by repeated-phrase automata.

A window is 13 consecutive words. Words go that lie in a window which a document with a smaller doc_id has too.

1. Candidates: a window's anchor is the least hash among its substrings of ANCHOR words; windows whose anchor two documents
   have are cut out of their documents, the others are done with.
2. Passages are confirmed: the windows that two documents have get the least document that has them as their owner.
3. The owner's windows are compiled into Aho-Corasick automata, a shard of owners each, and the stretches of all documents with
   windows of these owners are streamed through them. An owner with very many stretches has its automaton on several
   tasks, which share the stretches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packed
from .common import n_buckets, shielded, written
from .suffixes import merged

ANCHOR = 7
#: Windows of an automaton, about; stretches that one copy of an owner's automaton reads, about; bytes read by a shard, about.
SHARD, READS, HELD = 15_000, 200, 1 << 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _hashed(data: np.ndarray, off: np.ndarray, size: int) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; and of each window in a row: row, place of its first word, anchor hash, window hash."""
    w = K.words(data, off)
    h = w.hashes()
    if len(h) < size:
        none = np.zeros(0, np.int64)
        return w, none, none, none.view(np.uint64), none.view(np.uint64)
    g = K.grams(h, ANCHOR)
    best = K.least_in_window(g, size - ANCHOR + 1)
    at = np.flatnonzero(K.in_row(w.first, size, len(h) - size + 1))
    row = np.searchsorted(w.first, at, "right") - 1
    return w, row, at, g[best[at]], K.grams(h, size)[at]


def _anchors(size: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, off = K.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for part in K.parts(data, off, size - 1):
                _, row, _, anchor, _ = _hashed(part.data, part.off, size)
                # A run also ends with its row: the next row needs an entry of its own for an equal anchor.
                s = np.union1d(K.runs(row)[0], K.runs(anchor)[0])
                rows.append(row[s] + part.a)
                hashes.append(anchor[s])
            row, h = np.concatenate(rows), np.concatenate(hashes)
            yield packed.pack((h % np.uint64(n_buckets)).astype(np.int64), row, ids, np.zeros(len(ids)), h)

    return run


def _shared(n_buckets: int):
    """Hashes that two or more owners have, dealt by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, h, _ = packed.unpack(batches)
        at, _ = packed.shared_entries(own, h)
        ids, row = np.unique(own[at], return_inverse=True)
        bucket = (K.mixed(ids.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        yield packed.pack(bucket[row], row, ids, np.zeros(len(ids)), h[at])

    return run


def _owned(n_buckets: int):
    """Hashes of windows that two or more documents have, dealt by document; ``n`` is then 0 and the hash is followed by
    its owner, the least document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, h, _ = packed.unpack(batches)
        at, _ = packed.shared_entries(own, h)  # in the order of hash and document
        own, h = own[at], h[at]
        s, e = K.runs(h)
        owner = np.repeat(own[s], e - s)
        ids, row = np.unique(own, return_inverse=True)
        bucket = (K.mixed(ids.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)[row]
        both = np.stack((h, owner.view(np.uint64)), 1).ravel()
        yield packed.pack(np.repeat(bucket, 2), np.repeat(row, 2), ids, np.zeros(len(ids)), both)

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, _, h, _ = packed.unpack(batches)
    order = np.argsort(own, kind="stable")
    own, h = own[order], h[order]
    s, e = K.runs(own)
    yield pa.RecordBatch.from_arrays([pa.array(own[s]), pa.array([h[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], names=["doc_id", "hits"])


_STRETCHES = "doc_id long, k long, first array<long>, text array<binary>"


def _stretches(size: int):
    """The stretches of each text whose windows have an anchor that another document has, one row for each text with any: row key, places of
    the stretches' first words, stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            hits, key = batch.column("hits"), batch.column("k").to_pylist()
            for part in K.parts(data, off, size - 1):
                a, ids, keys, firsts, texts = part.a, [], [], [], []
                w, row, at, anchor, _ = _hashed(part.data, part.off, size)
                rs, re_ = K.runs(row)
                for lo, hi in zip(rs.tolist(), re_.tolist()):
                    r = int(row[lo])
                    keep = at[lo:hi][np.isin(anchor[lo:hi], np.frombuffer(hits[a + r].as_buffer(), np.uint64))]
                    found = _joined(keep, size)
                    if found:
                        ids.append(batch.column("doc_id")[a + r].as_py())
                        keys.append(key[a + r])
                        firsts.append([x - int(w.first[r]) + part.word for x, _ in found])
                        texts.append([w.data[w.start[x] : w.end[y - 1]].tobytes() for x, y in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.binary()))], names=["doc_id", "k", "first", "text"])

    return run


def _each(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """A batch of :func:`_stretches` with a row for each stretch, and the row of the batch that each comes from."""
    of = np.repeat(np.arange(len(batch)), batch.column("text").value_lengths().to_numpy(zero_copy_only=False))
    taken = pa.array(of)
    cols = [batch.column("doc_id").take(taken), batch.column("k").take(taken), batch.column("first").flatten(), batch.column("text").flatten()]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "first", "text"]), of


def _joined(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) of runs of consecutive windows."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return list(zip(at[np.concatenate(([0], cut))].tolist(), (at[np.concatenate((cut - 1, [len(at) - 1]))] + size).tolist()))


def _window_hashes(size: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(_each(x)[0] for x in batches):
            data, off = K.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for part in K.parts(data, off, size - 1):
                _, row, _, _, h = _hashed(part.data, part.off, size)
                rows.append(row + part.a)
                hashes.append(h)
            row, h = np.concatenate(rows), np.concatenate(hashes)
            yield packed.pack((h % np.uint64(n_buckets)).astype(np.int64), row, ids, np.zeros(len(ids)), h)

    return run


def _by_owner(size: int):
    """Each stretch in parts whose windows have one owner: owner, doc_id, row key, first word's place, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of_text in batches:
            batch, of = _each(of_text)
            data, off = K.buffers(batch.column("text"))
            doc, key, first, hits = batch.column("doc_id").to_numpy(), batch.column("k").to_numpy(), batch.column("first").to_numpy(), of_text.column("hits")
            for part in K.parts(data, off, size - 1):
                a, out = part.a, []
                w, row, at, _, h = _hashed(part.data, part.off, size)
                rs, re_ = K.runs(row)
                for lo, hi in zip(rs.tolist(), re_.tolist()):
                    r = int(row[lo])
                    known = np.frombuffer(hits[int(of[a + r])].as_buffer(), np.uint64).reshape(-1, 2)
                    order = np.argsort(known[:, 0])
                    known = known[order]
                    place = np.minimum(np.searchsorted(known[:, 0], h[lo:hi]), len(known) - 1)
                    there = known[place, 0] == h[lo:hi]
                    owner = known[place, 1].view(np.int64)[there]
                    where = at[lo:hi][there]
                    s, e = K.runs(owner)
                    for x, y in zip(s.tolist(), e.tolist()):
                        for i, j in _joined(where[x:y], size):
                            k = a + r
                            out.append((int(owner[x]), int(doc[k]), int(key[k]), int(first[k]) + part.word + i - int(w.first[r]), w.data[w.start[i] : w.end[j - 1]].tobytes()))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["owner", "doc_id", "k", "first", "text"])

    return run


class Shard:
    """An automaton over windows of words. A word is a pair of letters, so that states have few arcs."""

    ARCS = 512

    def __init__(self, passages: list[bytes], size: int):
        self.size, self.codes = size, {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in passages:
            words = _WORD.findall(p)
            text = "".join([self._code(w) for w in words])
            for i in range(len(words) - size + 1):
                self.automaton.add_word(text[2 * i : 2 * (i + size)])
        if len(self.automaton):
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        code = self.codes.get(word)
        if code is None:
            n = len(self.codes)
            code = self.codes[word] = chr(0x100 + n % self.ARCS) + chr(0x400 + n // self.ARCS)
        return code

    def starts(self, text: bytes) -> np.ndarray:
        """Places of the words of ``text`` that start a window of the shard."""
        if not len(self.automaton):
            return np.zeros(0, np.int64)
        get = self.codes.get
        read = "".join([get(w, "\x01\x01") for w in _WORD.findall(text)])
        ends = np.array([end for end, _ in self.automaton.iter(read)], np.int64)
        return (ends[ends % 2 == 1] + 1) // 2 - self.size


def _located(size: int):
    """Over rows (owner, part, is_owner, doc_id, k, first, text), an owner's passages first: word ranges to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: list[bytes] = []
        reads: list[tuple[int, int, int, bytes]] = []
        held, size_held, last = 0, 0, None

        def flush() -> pa.RecordBatch:
            shard, out = Shard(passages, size), []
            for doc, key, first, text in reads:
                out += [(doc, key, first + a, first + b) for a, b in _joined(np.unique(shard.starts(text)), size)]
            cols = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "k", "a", "b"])

        for batch in batches:
            for owner, part, is_owner, doc, key, first, text in zip(*[batch.column(c).to_pylist() for c in ("owner", "part", "is_owner", "doc_id", "k", "first", "text")]):
                if (held >= SHARD or size_held >= HELD) and (owner, part) != last:
                    yield flush()
                    passages, reads, held, size_held = [], [], 0, 0
                last = owner, part
                held += text.count(b" ") + 1 if is_owner else 0
                size_held += len(text)
                if is_owner:
                    passages.append(text)
                else:
                    reads.append((doc, key, first, text))
        if passages:
            yield flush()

    return run


def repeated_ranges(docs: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` (doc_id, k, text; k tells unlike rows of a doc_id apart) to (doc_id, k, a, b): ranges of a row's words that a document with a smaller doc_id has."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    p = n_buckets(rows)
    hits = packed.by_bucket(rows.mapInArrow(_anchors(size, p), packed.SCHEMA), p).mapInArrow(_shared(p), packed.SCHEMA)
    hits = packed.by_bucket(hits, p).mapInArrow(_per_document, "doc_id long, hits binary")
    stretches = written(rows.join(hits, "doc_id").mapInArrow(_stretches(size), _STRETCHES))

    windows = packed.by_bucket(stretches.mapInArrow(_window_hashes(size, p), packed.SCHEMA), p).mapInArrow(_owned(p), packed.SCHEMA)
    windows = packed.by_bucket(windows, p).mapInArrow(_per_document, "doc_id long, hits binary")
    parts = written(stretches.join(windows, "doc_id").mapInArrow(_by_owner(size), "owner long, doc_id long, k long, first long, text binary"))

    is_owner = F.col("owner") == F.col("doc_id")
    # A table of its own, so that the joins read two shuffles and an owner with many stretches can be split over tasks.
    copies = written(parts.where(~is_owner).groupBy("owner").agg(F.ceil(F.count("*") / READS).cast("int").alias("n")))
    mine = parts.where(is_owner).join(copies, "owner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    theirs = parts.where(~is_owner).join(copies, "owner").withColumn("part", F.pmod(F.xxhash64("doc_id", "k", "first"), F.col("n")).cast("int"))
    both = mine.unionByName(theirs).select("owner", "part", (F.col("owner") == F.col("doc_id")).alias("is_owner"), "doc_id", "k", "first", "text")
    dealt = both.repartition(p, "owner", "part").sortWithinPartitions("owner", "part", F.desc("is_owner"))
    return dealt.mapInArrow(_located(size), "doc_id long, k long, a long, b long")


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[bytes]]]:
    for batch in K.slices(batches, K.PIECE):
        total, removed, kept = [], [], []
        for text, a, b in zip(batch.column("text"), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            words = _WORD.findall(text.as_buffer().to_pybytes()) if text.is_valid else []
            left, at = [], 0
            for x, y in merged(np.array([a, b]).T) if a else []:
                left += words[at:x]
                at = y
            left += words[at:]
            total.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield batch, total, removed, kept


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, total, removed, kept in _kept_words(batches):
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the removed words; a text that loses none stays as it is."""
    for batch, _, removed, kept in _kept_words(batches):
        text = [k.decode() if n else t for k, n, t in zip(kept, removed, batch.column("text").to_pylist())]
        i = batch.schema.get_field_index("text")
        cols = [pa.array(text, pa.string()) if j == i else c for j, c in enumerate(batch.columns)]
        n = batch.schema.names
        yield pa.RecordBatch.from_arrays([c for c, x in zip(cols, n) if x not in ("a", "b")], names=[x for x in n if x not in ("a", "b")])


def _with_ranges(docs: DataFrame, size: int) -> DataFrame:
    rows = docs.withColumn("k", F.xxhash64(F.col("text").cast("string")))
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "k", F.col("text").cast("string").alias("text"))
    lists = repeated_ranges(ids, size).groupBy("doc_id", "k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return rows.join(lists, ["doc_id", "k"], "left").drop("k")


def passage_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256. Null or empty text has no words; a row with a null doc_id loses
    nothing and takes nothing from others; rows that share a doc_id are one document and take nothing from each other, and each loses its own ranges."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_ranges(docs.select("doc_id", F.col("text").cast("string").alias("text")), 13)
    return rows.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_passages(docs: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; the words that stay are joined by one space, texts that lose none stay
    as they are. All columns stay, whatever their names. Null doc_ids and texts: as in :func:`passage_digest`."""
    plain = shielded(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    out = _with_ranges(plain, size)
    fields = [f for f in out.schema.fields if f.name not in ("a", "b")]
    return out.mapInArrow(_texts, type(out.schema)(fields)).select(*plain.columns).toDF(*docs.columns)
