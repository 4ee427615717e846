"""Exact top-k search by inner product: columnar branch and bound.

Rows and queries are cut into blocks of bounded size and paired as a grid, so that a task holds one block of each. In a
cell the vectors lie dimension by dimension. Scores are accumulated a few dimensions at a time; after each step the
Cauchy-Schwarz bound on the mass that remains gives every candidate a range, candidates whose best case is below the
k-th best worst case are dropped, and the columns that stay are compacted. Sums are whole numbers, so results are exact.

One block of rows is searched first: each query's k-th best score there is a bound that it takes along into all other cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a block of rows and of a block of queries: what one task holds at most, whatever the input.
ROW_BLOCK, QUERY_BLOCK, STEP = 8_192, 4_096, 8


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component. Null for a null vector, or one with a null or non-finite component."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Dimension by dimension; shorter vectors are filled with zeros."""
    out = np.zeros((dims, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


NO_BOUND = -(1 << 62)


def search_block(row_ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id and the ids and scores of its k best rows, best first, ties to smaller ids. Rows below the query's bound are
    left out."""
    dims = rows.shape[0]
    steps = list(range(0, dims, STEP))
    mass = lambda m: np.array([np.sqrt((m[a:].astype(np.float64) ** 2).sum(axis=0)) for a in [*steps[1:], dims]])
    row_mass, query_mass = mass(rows), mass(queries)
    for j, qid in enumerate(query_ids):
        alive = np.flatnonzero(row_ids != qid)
        block, score = None, np.zeros(len(alive), np.int64)
        for s, a in enumerate(steps):
            part = rows[a : a + STEP] if len(alive) == rows.shape[1] else rows[a : a + STEP, alive] if block is None else block[a : a + STEP]
            score = score + queries[a : a + STEP, j] @ part
            bound = NO_BOUND if bounds is None else int(bounds[j])
            if len(alive) <= k and bound == NO_BOUND or not len(alive) or s == len(steps) - 1:
                continue
            slack = row_mass[s][alive] * query_mass[s][j] * (1 + 1e-9) + 1e-6
            floor = np.partition(score - slack, len(alive) - k)[len(alive) - k] if len(alive) > k else bound
            keep = score + slack >= max(floor, bound)
            if keep.sum() < 0.7 * len(alive):
                alive, score = alive[keep], score[keep]
                block = rows[:, alive] if block is None else block[:, keep]
        if len(alive) > k:
            least = np.partition(score, len(alive) - k)[len(alive) - k]
            keep = score >= least
            alive, score = alive[keep], score[keep]
        best = np.lexsort((row_ids[alive], -score))[:k]
        yield int(qid), row_ids[alive[best]], score[best]


def _cell(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            dims = max(rows["v"].map(len).max(), queries["v"].map(len).max())
            out = list(search_block(rows["vec_id"].to_numpy(), _matrix(rows["v"], dims), queries["vec_id"].to_numpy(), _matrix(queries["v"], dims), k, queries["bound"].to_numpy()))
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array([q for q, _, _ in out], np.int64), [len(i) for _, i, _ in out]),
                "vec_id": np.concatenate([np.zeros(0, np.int64), *[i for _, i, _ in out]]),
                "score": np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in out]]),
            }
        )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k rows of ``vectors`` (vec_id, embedding) with the highest inner product for each query row, but for itself.

    Vectors that are null, or hold null or non-finite components, take no part; nor do rows with a null vec_id. Vectors
    of unlike lengths meet in their common dimensions. A vec_id that occurs twice counts as two candidates with that id; as
    a query its rows are asked each, none finds the other, and what they find is pooled. With fewer than k other rows there are fewer results.
    Scores are 64 bits wide: components must be below some 10^9 over the root of their number.
    """
    clean = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), is_query.alias("q")).where(
        F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    )
    n, n_queries = clean.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    n_rows, n_qs = max(-(-n // ROW_BLOCK), min(-(-n // 512), 24)), max(-(-n_queries // QUERY_BLOCK), 1)
    spread = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(max(m, 1))).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(max(m, 1) - 1)))
    rows = clean.select(spread(n_rows).alias("r"), each(n_qs).alias("c"), "vec_id", "v")
    queries = clean.where("q").withColumn("bound", F.lit(NO_BOUND).cast("long"))

    def searched(rows: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
        names = [F.col(c).alias(c) for c in ("vec_id", "v", "bound")]  # columns of their own: the rows have the same ones
        placed = queries.select(each(blocks).alias("r"), spread(n_qs).alias("c"), *names)
        return rows.groupBy("r", "c").cogroup(placed.groupBy("r", "c")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")

    if n_rows > 1:
        first = searched(rows.where("r = 0"), queries, 1).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        first = written(first.select(F.col("query_id").alias("vec_id"), "least"))
        queries = queries.drop("bound").join(first, "vec_id", "left").withColumn("bound", F.coalesce("least", F.lit(NO_BOUND)))
    found = searched(rows, queries, n_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_digest(vectors: DataFrame) -> DataFrame:
    """Each query's best rows, as :func:`top_k`; other columns are not read, an empty table gives an empty table."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""
