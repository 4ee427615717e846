"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more. Under any order of the
shingles, two linked documents share at least m shingles among the first (n - t + m) of each, t = ceil(0.75 n). That is used twice:

1. In the order of their hashes, with m = n / 8: classes of documents with equal sets, of whose prefix too few shingles occur
   anywhere else, have no partner. Most documents end here, before their whole set has been moved.
2. Over the whole sets of those left, in the order of document frequency. A document's prefix is lengthened from m = 1 as long
   as the estimated cost of its candidates falls; partners then have to share the lesser m of the two before their sets are
   compared.

Documents are compared as classes of equal sets. Classes whose prefixes meet in a shingle meet at that shingle's hub, the least
class that has it. The members of a hub are dealt into blocks, and each block is compared within itself and with the hub: that links
a group of near copies, however large. Only members that this leaves unconnected are compared across blocks, tile by tile, and
a tile gives no more links than connect what is linked in it. Shingles are compared by hashes of 64 bits; no list or group is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import packed
from .common import n_buckets, numbered, shielded, written
from .graph import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
SIMILAR = (75, 100)
#: The hash-order prefix asks for n / FIRST_SHARE shared shingles.
FIRST_SHARE = 8
#: A prefix is lengthened to this many shared shingles at most.
MOST_SHARED = 16
#: Cost of comparing two sets, in postings read.
COMPARE = 20
#: Documents of a block, about.
BLOCK = 128


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any partner at least: ceil(0.75 n)."""
    return -(-SIMILAR[0] * n // SIMILAR[1])


def shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes in order; of fewer than five words, one for the whole sequence."""
    data, off = K.buffers(batch.column("text"))
    found: list[np.ndarray] = []  # of the parts of a long text
    for part in K.parts(data, off, SHINGLE - 1):
        w = K.words(part.data, part.off, lower=True)
        h = w.hashes()
        g = K.grams(h, SHINGLE)
        for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if hi - lo >= SHINGLE:
                s = np.sort(g[lo : hi - SHINGLE + 1])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif part.word == 0 and not part.more:
                s = K.grams(h[lo:hi], hi - lo) if hi > lo else h[:0]
            else:
                s = h[:0]
            if part.more:
                found.append(s)
            elif part.word:
                yield np.unique(np.concatenate([*found, s]))
                found = []
            else:
                yield s


def class_of(s: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers."""
    total = int(K.mixed(s).sum()) + len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return total - (1 << 64) if total >> 63 else total


def _first_pass(n_buckets: int):
    """Rows for the documents' sizes and classes (in ``owner``, with the ids in ``h``) and for prefixes in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            sets = list(shingle_sets(batch))
            n = np.array([len(s) for s in sets], np.int64)
            own = np.array([class_of(s) for s in sets], np.int64)
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            head = packed.pack((own % n_buckets).astype(np.int64), np.arange(len(own)), own, n, ids.view(np.uint64), null + np.uint8(1))
            yield head
            size = n - _least_overlap(n) + np.maximum(-(-n // FIRST_SHARE), 1)
            size[n == 0] = 0
            h = np.concatenate([np.zeros(0, np.uint64), *[s[:k] for s, k in zip(sets, size.tolist())]])
            yield packed.pack((h % np.uint64(n_buckets)).astype(np.int64), np.repeat(np.arange(len(n)), size), own, n, h)

    return run


def _first_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as they came (shared = null), and for each class how many of this bucket's hashes another class has."""
    names = ["doc_id", "n", "class", "shared"]
    cols: list[list] = [[], [], []]
    for batch in batches:
        is_head = np.array([len(v.as_buffer()) > 0 for v in batch.column("x")], bool)
        if is_head.any():
            own, n, ids, x = packed.unpack([batch.filter(pa.array(is_head))])
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64), mask=x == 2), pa.array(n.astype(np.int64)), pa.array(own), pa.nulls(len(own), pa.int64())], names=names)
        if not is_head.all():
            for c, v in zip(cols, packed.unpack([batch.filter(pa.array(~is_head))])[:3]):
                c.append(v)
    if cols[0]:
        own, n, h = (np.concatenate(c) for c in cols)
        at, _ = packed.shared_entries(own, h)
        own, first, count = np.unique(own[at], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(n[at][first].astype(np.int64)), pa.array(own), pa.array(count.astype(np.int64))], names=names)


def _whole_sets(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            want = batch.column("class").to_numpy()
            sets = list(shingle_sets(batch))
            ok = np.array([class_of(s) == c for s, c in zip(sets, want)], bool)  # a doc_id may have several texts
            sets = [s if k else s[:0] for s, k in zip(sets, ok)]
            n = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate([np.zeros(0, np.uint64), *sets])
            yield packed.pack((h % np.uint64(n_buckets)).astype(np.int64), np.repeat(np.arange(len(n)), n), want, n, h)

    return run


def _frequencies(n_buckets: int):
    """The bucket's hashes that two or more documents have, dealt by document; x: steps of frequency (log 2, in eighths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, h, _ = packed.unpack(batches)
        at, df = packed.shared_entries(own, h)
        own, n, h = own[at], n[at], h[at]
        ids, first, row = np.unique(own, return_index=True, return_inverse=True)
        step = np.minimum(np.round(8 * np.log2(np.maximum(df, 1))), 255).astype(np.uint8)
        bucket = (K.mixed(own.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        yield packed.pack(bucket, row, ids, n[first] if len(ids) else n, h, step)

    return run


def prefix_length(df: np.ndarray, n: int) -> tuple[int, int]:
    """Of a document whose shared shingles have the frequencies ``df``, rarest first: the length of its prefix among them,
    and how many of them partners share. Lengthening costs postings and saves comparisons."""
    t = int(_least_overlap(np.int64(n)))
    most = min(t, MOST_SHARED)
    m = np.arange(1, most + 1)
    read = np.cumsum(df)[len(df) - t + m - 1]
    best = int(np.argmin(read * (1 + COMPARE / m))) + 1
    return len(df) - t + best, best


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, n, h, step = packed.unpack(batches)
    order = np.lexsort((h, step, own))
    own, n, h, step = own[order], n[order], h[order], step[order]
    s, e = K.runs(own)
    out: list[tuple] = []
    for a, b in zip(s.tolist(), e.tolist()):
        if b - a >= _least_overlap(np.int64(n[a])):
            size, m = prefix_length(2.0 ** (step[a:b] / 8), int(n[a]))
            out.append((int(own[a]), int(n[a]), m, h[a : a + size].view(np.int64), np.sort(h[a:b]).tobytes()))
    cols = list(zip(*out)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["id", "n", "m", "prefix", "shared"])


def _common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of a shares with each of b."""
    out = np.zeros(len(a) * len(b), np.int64)
    ha, hb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    oa, ob = np.argsort(ha, kind="stable"), np.argsort(hb, kind="stable")
    ha, ra, hb, rb = ha[oa], ra[oa], hb[ob], rb[ob]
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    hit = np.flatnonzero(hi > lo)
    ends = np.cumsum(hi[hit] - lo[hit])
    cuts = np.searchsorted(ends, np.arange(1, (ends[-1] if len(ends) else 0) // 2_000_000 + 1) * 2_000_000)
    for part in np.split(hit, np.unique(cuts)):  # bounded memory
        if len(part):
            k = hi[part] - lo[part]
            out += np.bincount(np.repeat(ra[part], k) * len(b) + rb[K.ranges(lo[part], hi[part])], minlength=len(out))
    return out.reshape(len(a), len(b))


def tile_links(left: pd.DataFrame, right: pd.DataFrame | None) -> list[tuple[int, int]]:
    """Links between two blocks (or within one) that connect all that is linked. Rows with one ``component`` are connected already."""
    same = right is None
    right = left if same else right
    as_hashes = lambda col: [np.array(x, np.int64).view(np.uint64) for x in col]
    count = _common_counts(as_hashes(left["prefix"]), as_hashes(right["prefix"]))
    n_l, n_r = left["n"].to_numpy(), right["n"].to_numpy()
    m_l, m_r = left["m"].to_numpy(), right["m"].to_numpy()
    small, large = np.minimum(n_l[:, None], n_r), np.maximum(n_l[:, None], n_r)
    may = (count >= np.minimum(m_l[:, None], m_r)) & (small >= _least_overlap(large))
    if same:
        may &= np.triu(np.ones_like(may), 1)
    i, j = np.nonzero(may)
    order = np.argsort(-count[i, j], kind="stable")
    ids_l, ids_r = left["id"].tolist(), right["id"].tolist()
    root: dict[int, int] = dict(zip(ids_l, left["component"].tolist())) | dict(zip(ids_r, right["component"].tolist()))

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] if up in root else up
            x = up
        return x

    sets_l = [np.frombuffer(x, np.uint64) for x in left["shared"]]
    sets_r = sets_l if same else [np.frombuffer(x, np.uint64) for x in right["shared"]]
    out = []
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        a, b = find(ids_l[p]), find(ids_r[q])
        if a == b:
            continue
        x, y = (sets_l[p], sets_r[q]) if len(sets_l[p]) <= len(sets_r[q]) else (sets_r[q], sets_l[p])
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        if SIMILAR[1] * common >= SIMILAR[0] * (int(n_l[p]) + int(n_r[q]) - common):
            root[a] = b
            out.append((ids_l[p], ids_r[q]))
    return out


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(tile_links(rows.drop_duplicates(["id"]), None), columns=["a", "b"], dtype="int64")


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    low, high = int(rows["b1"].iloc[0]), int(rows["b2"].iloc[0])
    own, other = rows[rows["block"] == low], rows[rows["block"] == high]
    found = tile_links(own, None if low == high else other) if len(own) and len(other) else []
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _across(members: DataFrame, hubs: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the members of ``hubs`` that are not in one component yet.

    Components of a block's size or more have blocks of their own, which don't meet; the others share blocks.
    """
    rows = members.join(hubs.select("hub"), "hub").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("hub", "component").agg(F.count("*").alias("c"))
    open_hubs = parts.groupBy("hub").agg(F.count("*").alias("k")).where("k > 1").select("hub")
    parts = written(parts.join(open_hubs, "hub").withColumn("large", F.when(F.col("c") >= BLOCK, F.col("component"))))
    groups = parts.groupBy("hub", "large").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("n"))
    before = Window.partitionBy("hub").orderBy("large").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"), "all": F.sum("n").over(Window.partitionBy("hub")).cast("int")})
    of_part = parts.alias("p").join(groups.alias("g"), (F.col("p.hub") == F.col("g.hub")) & F.col("p.large").eqNullSafe(F.col("g.large")))
    of_part = written(of_part.select("p.hub", "p.component", "p.large", "g.n", "g.base", "g.all"))
    dealt = rows.join(of_part, ["hub", "component"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda o: F.col("large").isNull() | (o < F.col("base")) | (o >= F.col("base") + F.col("n")))
    tiles = dealt.select("hub", "id", "component", "block", F.explode(others).alias("other"))
    tiles = tiles.select("hub", "id", "component", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    return tiles.join(sets, "id").groupBy("hub", "b1", "b2").applyInPandas(_tile, "a long, b long")


def _labels(sets: DataFrame) -> DataFrame:
    """``sets`` with their prefixes to rows (id, component) for all that are linked."""
    postings = sets.select("id", F.explode("prefix").alias("h"))
    hubs = written(postings.groupBy("h").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"))
    members = written(postings.join(hubs, "h").select("hub", "id").distinct())
    sizes = written(members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    n = F.coalesce("n_blocks", F.lit(1))
    blocks = members.join(sizes, "hub", "left").select("hub", "id", F.pmod(F.xxhash64("id"), n).cast("int").alias("block"))
    leaders = sizes.select("hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    near = blocks.unionByName(leaders).join(sets, "id").withColumn("component", F.col("id"))
    found = written(near.groupBy("hub", "block").applyInPandas(_block, "a long, b long"))
    label = components(found)
    if not sizes.isEmpty():
        label = written(label)
        more = written(_across(members, sizes, label, sets))
        if not more.isEmpty():
            label = components(label.toDF("a", "b").unionByName(more))
    return label


def joined(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Null text, or text without words, has the empty set and no links: such a row is its own component. Rows with equal sets share a
    component. Repeated rows each get a row, and unlike texts with one doc_id are compared each. A null doc_id with a set that
    others have gets their component, else null; it links with nothing else. A text's set is held by one task, whatever its length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = n_buckets(rows)
    first = packed.by_bucket(rows.mapInArrow(_first_pass(p), packed.SCHEMA), p)
    first = written(first.mapInArrow(_first_match, "doc_id long, n long, class long, shared long"))
    known = first.where(F.col("shared").isNull()).drop("shared")
    reps = written(known.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep")))
    # n - t + m of t's order: any partner of a set of n has ceil(t / FIRST_SHARE) or more to share.
    enough = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) / FIRST_SHARE))
    left = (
        first.where(F.col("shared").isNotNull())
        .groupBy("class")
        .agg(F.sum("shared").alias("shared"), F.max("n").alias("n"))
        .where(F.col("shared") >= enough)
        .join(reps, "class")
        .select(F.col("rep").alias("doc_id"), "class")
    )
    sets = packed.by_bucket(rows.join(left, "doc_id").mapInArrow(_whole_sets(p), packed.SCHEMA), p).mapInArrow(_frequencies(p), packed.SCHEMA)
    sets = written(packed.by_bucket(sets, p).mapInArrow(_prefixes, "id long, n long, m int, prefix array<long>, shared binary"))
    label = _labels(sets).withColumnRenamed("id", "class").join(reps, "class")
    least = label.groupBy("component").agg(F.min("rep").alias("least"))
    linked = label.join(least, "component").select("class", "least")
    # A table of its own, so that the last join reads two shuffles and a large class can be split over tasks.
    of_class = written(reps.join(linked, "class", "left").select("class", F.coalesce("least", "rep").alias("component_id")))
    return known.join(of_class, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its least doc_id, null last. All columns stay; rows without words stay.

    Rows are told apart by numbers of their own, so rows with null or repeated doc_ids are compared as all others are.
    """
    rows = numbered(shielded(docs, "doc_id", "text"))
    found = joined(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("_row")).select("_row")
    return rows.join(kept, "_row", "left_semi").drop("_row").toDF(*docs.columns)
