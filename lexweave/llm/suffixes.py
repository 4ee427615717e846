"""Exact removal of long repeated byte strings.

Every window of 200 bytes belongs to one anchor: the least hash among its substrings of some length. Equal windows have equal anchors
at equal places, so an anchor that occurs once settles its windows at once, and those of other anchors can be judged anchor by
anchor. A stretch is a run of windows of one text with the same anchor. Stretches that are equal are sent on as one that counts as two.

The stretches of an anchor are put in one block of bounded size, and the block's Burrows-Wheeler transform is walked backward
breadth first: the boundaries between suffixes with a common prefix of 0, 1, 2, ... bytes are derived each level from the one
before, until the common prefix reaches 200; suffixes that no boundary has parted by then start the same window. An anchor with
more unlike stretches than a block holds is split: its stretches are cut anew by anchors of greater length, in the end by whole windows.

Hashes deal out the work and fold equal stretches (two hashes of 64 bits, of the anchor and of all bytes); what repeats is found
in the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import n_partitions, written

#: Parts of a window that anchors are chosen from: of an anchor that overflows a block, the next. The last is the window.
PARTS = (0.12, 0.5, 0.8, 1.0)
#: Bytes of a block, about.
BLOCK = 1 << 20


def most_stretches(size: int) -> int:
    """Unlike stretches of an anchor that a block holds: each has less than two windows' bytes."""
    return max(2, BLOCK // (2 * size))


def anchors(data: np.ndarray, off: np.ndarray, size: int, part: int) -> tuple[np.ndarray, ...]:
    """For consecutive texts in ``data``: row, anchor hash, first and last window of each stretch, and the hash of its bytes.
    ``part``: bytes of the substrings that anchors are chosen from."""
    n = len(data)
    if n < size:
        return (np.zeros(0, np.int64),) * 5
    spans = K.Spans(data)
    at = np.arange(n - part + 1)
    h = spans.hashes(at, at + part)
    best = K.least_in_window(h, size - part + 1)  # best[i]: the anchor of the window that starts at i
    counts = np.maximum(np.diff(off) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = K.ranges(off[:-1], off[:-1] + counts)
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    anchor = best[start]
    s, e = K.runs(row * n + anchor)
    first, last, row = start[s], start[e - 1], row[s]
    return row, h[anchor[s]], first - off[row], last - off[row], spans.hashes(first, last + size)


def _windows_of(off: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows [a, b) and the bytes [x, y) of them that are hashed at once. A long text comes in parts, which share the bytes that
    windows over a cut need; that also cuts a stretch, which changes nothing for its windows."""
    for a, b in K.pieces(off):
        x, end = int(off[a]), int(off[b])
        if b == a + 1:
            while end - x > 2 * K.PIECE:
                yield a, b, x, x + K.PIECE + size - 1
                x += K.PIECE
        yield a, b, x, end


def _anchor_rows(size: int, part: int, names: list[str]):
    """Over rows (keys, twice, text) the stretches of each: h, c, keys, twice, first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            for a, b, x, y in _windows_of(off, size):
                row, h, first, last, c = anchors(data[x:y], np.clip(off[a : b + 1], x, y) - x, size, part)
                skipped = x - int(off[a])  # of a long text
                cols = {"h": pa.array(h.view(np.int64)), "c": pa.array(c.view(np.int64)), "first": pa.array((first + skipped).astype(np.int32)), "last": pa.array((last + skipped).astype(np.int32))}
                taken = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(n).take(taken) for n in names], names=names)

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` symbols at least. Symbols are below 512, places below 2^21.

    A key holds the rank, the rank of what follows and the place, so that plain sorting of numbers orders the places."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(4):
        key = key << 9 | padded[i : n + i]
    place, known = np.arange(n), 4
    key = key << 21 | place
    rank = np.empty(n, np.int64)
    while True:
        key = np.sort(key)
        order = key & (1 << 21) - 1
        key >>= 21
        new = np.concatenate(([False], key[1:] != key[:-1]))
        if known >= depth or new.sum() == n - 1:
            return order
        rank[order] = np.cumsum(new)
        key = rank << 42 | place
        key[: n - known] |= rank[known:] + 1 << 21
        known *= 2


def repeated_prefixes(text: np.ndarray, size: int, twice: np.ndarray | None = None) -> np.ndarray:
    """Which places start ``size`` symbols that also start elsewhere. ``twice``: places that count as two.

    ``parted[i]``: the suffixes i - 1 and i in order have a common prefix shorter than the level. An interval of suffixes with a
    common prefix w is extended backward to c + w by the occurrences of c before it. Two neighbours among those
    are parted at the next level if some boundary of w's level or an earlier one lies between them; neighbours side by side ask
    only about the boundary between them, so most levels touch no more than the boundaries found last.
    """
    n = len(text)
    if n > 1 << 21:
        raise ValueError("block too large")
    order = suffix_order(text, size)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)  # where the suffix that is longer by one symbol stands
    previous = np.full(n, -1, np.int64)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    at = np.arange(n)
    side_by_side = previous == at - 1
    side_by_side[0] = False
    apart = np.flatnonzero(~side_by_side & (previous >= 0))
    parted = np.zeros(n, bool)
    found = np.unique(to[previous < 0])
    parted[found] = True
    for _ in range(size - 1):
        reached = to[found[side_by_side[found]]]
        if len(apart):
            if len(found) * 8 < n:
                hit = np.searchsorted(found, apart, "right") > np.searchsorted(found, previous[apart], "right")
            else:
                count = np.cumsum(parted)
                hit = count[apart] > count[previous[apart]]
            reached = np.concatenate((reached, to[apart[hit]]))
            apart = apart[~hit]
        reached = reached[~parted[reached]]
        if not len(reached):
            break
        found = np.sort(reached)
        parted[found] = True
    alone = parted & np.concatenate((parted[1:], [True]))
    out = np.empty(n, bool)
    out[order] = ~alone
    return out if twice is None else out | twice


def _spans(flags: np.ndarray, size: int) -> np.ndarray:
    """Byte ranges [a, b) that the flagged windows cover, one after another."""
    at = np.flatnonzero(flags)
    if not len(at):
        return np.zeros(0, np.int32)
    gap = np.flatnonzero(np.diff(at) > size) + 1
    return np.stack((at[np.concatenate(([0], gap))], at[np.concatenate((gap - 1, [len(at) - 1]))] + size), 1).ravel().astype(np.int32)


def _block_spans(segs: list[bytes], twice: list[bool], size: int) -> list[np.ndarray]:
    """Of each stretch the byte ranges that repeat in the block; one that several texts have counts as two."""
    lens = np.array([len(s) for s in segs])
    ends = np.cumsum(lens + 1)
    starts = ends - lens - 1
    text = np.zeros(int(ends[-1]), np.uint16)
    text[K.ranges(starts, ends - 1)] = np.frombuffer(b"".join(segs), np.uint8).astype(np.uint16) + 1
    again = repeated_prefixes(text, size, np.repeat(np.array(twice, bool), lens + 1))
    return [_spans(again[a : a + k - size + 1], size) for a, k in zip(starts.tolist(), lens.tolist())]


_FOUND = "h long, c long, spans array<int>"


def _found(h: list, c: list, spans: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["h", "c", "spans"])


def _walk_blocks(size: int):
    """Over rows (h, c, twice, seg) in the order of h: blocks end between anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list[int] = []
        c: list[int] = []
        twice: list[bool] = []
        segs: list[bytes] = []
        held = 0
        for batch in batches:
            for hh, cc, tt, seg in zip(*[batch.column(n).to_pylist() for n in ("h", "c", "twice", "seg")]):
                if held >= BLOCK // 2 and hh != h[-1]:
                    yield _found(h, c, _block_spans(segs, twice, size))
                    h, c, twice, segs, held = [], [], [], [], 0
                h.append(hh)
                c.append(cc)
                twice.append(tt)
                segs.append(seg)
                held += len(seg)
        if h:
            yield _found(h, c, _block_spans(segs, twice, size))

    return run


def _cut(size: int):
    """The stretches ``want`` (h, c, first, last, twice, many) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, twice, many, segs = [], [], [], [], []
            for text, want in zip(batch.column("text"), batch.column("want").to_pylist()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for w in want:
                    h.append(w["h"])
                    c.append(w["c"])
                    twice.append(w["twice"])
                    many.append(w["many"])
                    segs.append(data[w["first"] : w["last"] + size])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(twice, pa.bool_()), pa.array(many, pa.bool_()), pa.array(segs, pa.binary())], names=["h", "c", "twice", "many", "seg"])

    return run


def repeated_spans(units: DataFrame, keys: list[str], size: int = 200, level: int = 0) -> DataFrame:
    """``units`` (keys that tell rows apart, twice, text) to rows (keys, a, b): byte ranges that repeated windows cover. ``twice``: the
    row stands for several with this text."""
    p, part = n_partitions(units.sparkSession), max(1, int(PARTS[level] * size))
    kinds = {f.name: f.dataType.simpleString() for f in units.schema}
    schema = {"h": "long", "c": "long"} | {k: kinds[k] for k in keys} | {"twice": "boolean", "first": "int", "last": "int"}
    rows = units.where(F.octet_length("text") >= size).select(*keys, "twice", "text")
    rows = written(rows.mapInArrow(_anchor_rows(size, part, list(schema)), ", ".join(f"`{k}` {v}" for k, v in schema.items())))
    # The counts are a table of their own, so that the join reads two shuffles and a hot anchor can be split over tasks.
    recurring = written(rows.groupBy("h").agg((F.count("*") + F.count_if("twice")).alias("n")).where("n > 1").select("h"))
    again = written(rows.join(recurring, "h"))

    one = F.min(F.struct("first", "last", *keys)).alias("one")
    classes = written(again.groupBy("h", "c").agg(((F.count("*") > 1) | F.bool_or("twice")).alias("twice"), one))
    wide = written(classes.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > most_stretches(size)).select("h", F.lit(True).alias("many")))
    want = classes.join(wide, "h", "left").select(F.struct("h", "c", "one.first", "one.last", "twice", F.coalesce("many", F.lit(False)).alias("many")).alias("w"), *[F.col(f"one.{k}").alias(k) for k in keys])
    want = want.groupBy(*keys).agg(F.collect_list("w").alias("want"))
    texts = units.select(*keys, "text").join(want, keys).dropDuplicates(keys)
    segs = written(texts.select("text", "want").mapInArrow(_cut(size), "h long, c long, twice boolean, many boolean, seg binary").withColumn("id", F.monotonically_increasing_id()))

    found = segs.where("NOT many").select("h", "c", "twice", "seg").repartition(p, "h").sortWithinPartitions("h").mapInArrow(_walk_blocks(size), _FOUND)
    if level + 1 < len(PARTS) and not wide.isEmpty():
        hot = segs.where("many")
        deeper = repeated_spans(hot.select("id", "twice", F.col("seg").alias("text")), ["id"], size, level + 1)
        ranges = deeper.groupBy("id").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans"))
        found = found.unionByName(ranges.join(hot.select("id", "h", "c"), "id").select("h", "c", "spans"))
    out = again.join(found, ["h", "c"]).select(*keys, "first", F.posexplode("spans").alias("i", "at"), "spans").where("i % 2 = 0")
    return out.select(*keys, (F.col("first") + F.col("at")).alias("a"), (F.col("first") + F.get("spans", F.col("i") + 1)).alias("b"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (a, b) in rows as disjoint ranges in order; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for text, a, b in zip(batch.column("text"), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = merged(np.array([a, b]).T) if a else []
            parts, at = [], 0
            for x, y in spans:
                parts.append(data[at:x])
                at = y
            kept = b"".join([*parts, data[at:]])
            for c, v in zip(cols, (len(data), len(data) - len(kept), len(spans), kept)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _apply(batches):
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sha, pa.string())], names=[*batch.schema.names[:4], "kept_sha256"])


def _with_spans(docs: DataFrame, size: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id").alias("d"), F.xxhash64(text).alias("t"))
    spans = repeated_spans(rows.select("d", "t", F.lit(False).alias("twice"), "text"), ["d", "t"], size)
    lists = spans.groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("at"))
    return rows.join(lists, ["d", "t"], "left").select("doc_id", "text", F.col("at.a").alias("a"), F.col("at.b").alias("b"))


def without_repeats(docs: DataFrame, size: int = 200) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Bytes of the UTF-8 text go that lie in a string of ``size`` bytes which starts anywhere else too. Null text counts as empty;
    texts shorter than ``size`` stay. Of equal texts all repeated bytes go, also from the first. Repeated rows are texts of their own, but rows
    that repeat with their doc_id meet in one task. Texts of any length are hashed in parts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, size).mapInArrow(_apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, as :func:`without_repeats`, with the hash of what stays. Only doc_id and text are read, whatever other
    columns are called. Rows with null doc_ids are judged as all others; an empty table gives an empty table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, 200).mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
