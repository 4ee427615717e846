"""Ranked lexical search by windowed bucket scoring.

Documents are numbered in the order in which they are read, and each run of ``WINDOW`` of them is a window with postings of its own: for each term
the places in the window and how often it stands there. These are written as a table, one row for a window. To score, a task takes one window after
the other: for each item the postings of its terms are added into an array with one slot for each document of the window, which stays in a core's
cache, and a bitset notes which slots were met; these are harvested into the item's heap of the best k. Tasks give their heaps, which are
ranked once more.

Nothing but these heaps and the counts of documents for each term is shuffled. Items come in blocks of about ``TERMS`` terms: what the driver and each
task hold of them is bounded, and more items mean more passes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .kernels import buffers, ranges, runs
from .tokens import BETWEEN, numbered

#: Documents of a window: its scores are 128 KB.
WINDOW = 1 << 14
#: Pairs of item and term in a block of items, about.
TERMS = 1 << 16
#: Numbers of words and places gathered before they are counted.
GATHERED = 1 << 21
K1, B_PERCENT, SCALE = 8, 90, 1_000_000_000

INDEX = "doc_ids array<bigint>, lengths array<bigint>, n_docs bigint, n_words bigint, terms array<int>, counts array<int>, places array<int>, tfs array<bigint>"


def _added(keys: list[np.ndarray], tfs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys brought together, in order."""
    key, tf = np.concatenate(keys), np.concatenate(tfs)
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    s, _ = runs(key)
    return key[s], np.add.reduceat(tf, s) if len(s) else tf


class Postings:
    """The postings of one window, gathered document by document. A key is the term's number and the place in the window."""

    def __init__(self):
        self.doc_ids, self.lengths = [], []
        self.keys, self.tfs, self.pending = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, doc_id: int | None, text: memoryview, number: dict[bytes, int]) -> None:
        at, length = len(self.doc_ids), 0
        for ids in numbered(text, number):
            length += len(ids)
            ids = ids[ids > 0].astype(np.int64)
            self.keys.append(ids * WINDOW + at)
            self.tfs.append(np.ones(len(ids), np.int64))
            self.pending += len(ids)
            if self.pending >= GATHERED:
                self.settle()
        self.doc_ids.append(doc_id)
        self.lengths.append(length)

    def settle(self) -> None:
        key, tf = _added(self.keys, self.tfs)
        self.keys, self.tfs, self.pending = [key], [tf], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        key, tf = self.keys[0], self.tfs[0]
        term, place = key // WINDOW, key % WINDOW
        s, e = runs(term)
        lists = ((self.doc_ids, pa.int64()), (self.lengths, pa.int64()), (term[s], pa.int32()), (e - s, pa.int32()), (place, pa.int32()), (tf, pa.int64()))
        doc_ids, lengths, terms, counts, places, tfs = (pa.array([pa.array(x, t)], pa.list_(t)) for x, t in lists)
        n_docs, n_words = pa.array([sum(1 for n in self.lengths if n)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())
        return pa.RecordBatch.from_arrays([doc_ids, lengths, n_docs, n_words, terms, counts, places, tfs], names=[c.split()[0] for c in INDEX.split(", ")])


def _indexed(number: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Postings()
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw = memoryview(data)
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                window.add(doc_id, raw[off[i] : off[i + 1]], number)
                if len(window.doc_ids) == WINDOW:
                    yield window.batch()
                    window = Postings()
        if window.doc_ids:
            yield window.batch()

    return run


def index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """The postings of the terms in ``number`` (by numbers from 1) in ``docs`` (doc_id, text), a row for each window. Every document is in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_indexed(number), INDEX)


@dataclass
class Item:
    item_id: int | None
    terms: np.ndarray  # numbers


def bucket_scores(doc_ids: np.ndarray, known: np.ndarray, norms: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, tfs: np.ndarray, weights: np.ndarray, items: list[Item], heaps: list[list], k: int) -> None:
    """Scores one window's documents for all items and puts what is among the best k into the items' heaps."""
    ends = np.cumsum(counts)
    part = np.repeat(weights[terms], counts) * ((SCALE * tfs) // (1000 * tfs + K1 * norms[places]))
    # The bitset of each term: words of 64 documents and the bits in them.
    row, word, bit = np.repeat(np.arange(len(terms)), counts), places >> 6, np.uint64(1) << (places & 63).astype(np.uint64)
    s, _ = runs(row * WINDOW + word)
    masks, words = (np.bitwise_or.reduceat(bit, s) if len(s) else bit), word[s]
    word_ends = np.searchsorted(row[s], np.arange(len(terms)), "right")
    scores, met = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)
    for item, heap in zip(items, heaps):
        at = np.searchsorted(terms, item.terms)
        for t in at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == item.terms)].tolist() if len(terms) else []:
            a, b = ends[t] - counts[t], ends[t]
            scores[places[a:b]] += part[a:b]
            a, b = word_ends[t - 1] if t else 0, word_ends[t]
            met[words[a:b]] |= masks[a:b]
        full = np.flatnonzero(met)
        found = ranges(full * 64, full * 64 + 64)[np.unpackbits(met[full].view(np.uint8), bitorder="little").astype(bool)]
        got = scores[found]
        scores[found] = 0
        met[full] = 0
        least = max(heap[0][0] if len(heap) == k else 1, np.partition(got, len(got) - k)[len(got) - k] if len(got) > k else 1)
        best = found[got >= least]
        got = got[got >= least]
        for i in np.lexsort((doc_ids[best], ~known[best], -got))[:k].tolist():
            place = int(best[i])
            entry = (int(got[i]), bool(known[place]), -int(doc_ids[place]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _scored(items: list[Item], weights: np.ndarray, n_docs: int, n_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {c: batch.column(c)[i].values for c in ("doc_ids", "lengths", "terms", "counts", "places", "tfs")}
                numbers = lambda c: lists[c].to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                known = lists["doc_ids"].is_valid().to_numpy(zero_copy_only=False)
                doc_ids = lists["doc_ids"].fill_null(0).to_numpy(zero_copy_only=False)
                # Of any size: a product of three counts can be above 64 bits.
                norms = (100 - B_PERCENT + B_PERCENT * n_docs * numbers("lengths").astype(object) // n_words).astype(np.int64)
                bucket_scores(doc_ids, known, norms, *map(numbers, ("terms", "counts", "places", "tfs")), weights, items, heaps, k)
        rows = [(item.item_id, -minus if known else None, score) for item, heap in zip(items, heaps) for score, known, minus in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])

    return run


def terms_of(items: DataFrame) -> DataFrame:
    """item_id and each of its distinct terms. Rows with one item_id are one item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, upper.lower())
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode_outer(F.split(text, BETWEEN)).alias("term")).where("term <> ''").distinct()


def weight(n_docs: int, df: str = "df"):
    return F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col(df) + 1.0)))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each item of ``items`` (item_id, text) the k rows of ``docs`` (doc_id, text) with the highest scores
    above 0, ties by ascending doc_id.

    Null texts have no terms; items without any find nothing. Rows that repeat, also with one doc_id, are ranked each; a null doc_id is ranked
    after all others that score the same. Rows with one item_id, also null, are one item with the terms of all. Other columns are not read.
    An empty table of either kind gives an empty table. A text is read in pieces; of an item, the distinct terms are held by each task.
    """
    terms = written(terms_of(items))
    blocks = max(-(-terms.count() // TERMS), 1)
    found = [_search(docs, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _search(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """:func:`search` for one block of items."""
    of_item: dict[int | None, list[str]] = {}
    for item_id, term in terms.collect():  # about TERMS rows
        of_item.setdefault(item_id, []).append(term)
    number = {t: i for i, t in enumerate(sorted({t for ts in of_item.values() for t in ts}), 1)}
    postings = written(index(docs, {t.encode(): i for t, i in number.items()}))
    n_docs, n_words = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    in_docs = postings.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weights = np.zeros(len(number) + 1, np.int64)
    for term, w in in_docs.select("terms", weight(n_docs)).collect():  # a row for each term of the block
        weights[term] = w
    asked = [Item(i, np.array(sorted(number[t] for t in ts), np.int64)) for i, ts in of_item.items()]
    best = postings.mapInArrow(_scored(asked, weights, n_docs, n_words, k), "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d),
t AS (SELECT r, unnest(w) AS term FROM d),
c AS (SELECT r, term, count(*)::BIGINT AS tf FROM t SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * len(w)::BIGINT * n_docs) // n_words AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
  FROM p JOIN m USING (r) WHERE score > 0)
WHERE rank <= 10
"""
