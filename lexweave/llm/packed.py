"""Entries (hash, owner) packed by bucket, so that a shuffle moves a few large rows in place of one row for each hash.

An owner is whatever a hash belongs to: a document, a class of equal documents, a shard. Each row has one bucket's
entries of one Arrow batch, owner by owner: ``owner`` and ``n`` (the owner's own number, such as its size), how many
entries each has, and the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ranges, runs

SCHEMA = "bucket int, owner binary, n binary, counts binary, h binary, x binary"
_NAMES = ["bucket", "owner", "n", "counts", "h", "x"]
_TYPES = (np.int64, np.uint32, np.uint32, np.uint64)


def pack(bucket: np.ndarray, row: np.ndarray, owner: np.ndarray, n: np.ndarray, h: np.ndarray, x: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries with their bucket and their row in ``owner`` and ``n``; ``x``: a number of 8 bits of each entry."""
    order = np.argsort(bucket.astype(np.int64) * max(len(owner), 1) + row, kind="stable")
    bucket, row, h = bucket[order], row[order], h[order]
    x = None if x is None else x[order]
    key = bucket.astype(np.int64) * max(len(owner), 1) + row
    s, e = runs(key)
    counts, own = (e - s).astype(np.uint32), row[s] if len(s) else np.zeros(0, np.int64)
    bs, be = runs(bucket[s] if len(s) else np.zeros(0, np.int64))
    cols: list[list] = [[] for _ in _NAMES]
    for a, b in zip(bs, be):
        lo, hi = s[a], e[b - 1]
        parts = (int(bucket[lo]), owner[own[a:b]].astype(np.int64).tobytes(), n[own[a:b]].astype(np.uint32).tobytes(), counts[a:b].tobytes(), h[lo:hi].tobytes(), b"" if x is None else x[lo:hi].astype(np.uint8).tobytes())
        for c, v in zip(cols, parts):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=_NAMES)


def unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, n, hash and x of all entries of the batches."""
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for batch in batches:
        for c, name, kind in zip(cols, _NAMES[1:], (*_TYPES, np.uint8)):
            c += [np.frombuffer(v.as_buffer(), kind) for v in batch.column(name)]
    owner, n, counts, h, x = (np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, (*_TYPES, np.uint8)))
    return np.repeat(owner, counts), np.repeat(n, counts), h, x


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` buckets in a partition of its own."""
    return df.repartitionById(n, "bucket")


def shared_entries(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries whose hash two or more owners have (repeated entries of an owner: one), and how many have it."""
    order = np.argsort(h, kind="stable")
    s, e = runs(h[order])
    many = e - s > 1
    order = order[ranges(s[many], e[many])]
    order = order[np.lexsort((owner[order], h[order]))]
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    order = order[first]
    s, e = runs(h[order])
    df = np.repeat(e - s, e - s)
    return order[df > 1], df[df > 1]
