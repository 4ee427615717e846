"""Places over whole tables: a row's rank among all rows, and lists of rows in pages, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.sources.tables import checkpointed

#: Items of a page.
PAGE = 256
_ROW = (1 << 33) - 1  # the part of an increasing id that counts the rows of a partition


def placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with their ``place``, from 1, in ``order``, which should end with what tells rows apart.

    Rows are dealt into ranges of the whole order and sorted there; how many each range has is added up on the driver (one number a partition),
    and a row's place is its number in the range and what stands before the range. Rows that are equal in the order may lie in
    one range in any order. So no key, however frequent, is one task's, and no window runs over all rows.
    """
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpointed(numbered.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(_ROW).alias("_nth")))
    before, n = [], 0
    for part, count in sorted(numbered.groupBy("_range").count().collect()):
        before.append((part, n))
        n += count
    starts = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    placed_ = numbered.join(F.broadcast(starts), "_range")  # a row for each partition
    return placed_.select(*[f"`{c}`" for c in rows.columns], (F.col("_before") + F.col("_nth") + 1).alias("place"))


def within(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``nth``, from 0: the place in their group, in ``order``. Null is a group."""
    all_places = placed(rows, [*group, *order])
    first = all_places.groupBy(*group).agg(F.min("place").alias("_first"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    return all_places.alias("a").join(first.alias("b"), same).select(*[f"a.{c}" for c in rows.columns], (F.col("place") - F.col("_first")).alias("nth"))


def pages(rows: DataFrame, group: list[str], nth: str, item: Column, size: int = PAGE) -> DataFrame:
    """Each group's items in lists of at most ``size``: ``page``, from 0, and ``items`` in the order of ``nth``, which counts from 0 in the group. A group
    without rows has no page; none, however large, is one row."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(nth).alias("n"), item.alias("x"))))
    return rows.groupBy(*group, F.floor(F.col(nth) / size).alias("page")).agg(listed.alias("l")).select(*group, "page", F.transform("l", lambda x: x["x"]).alias("items"))


def cut(rows: DataFrame, items: str, size: int = PAGE) -> DataFrame:
    """:func:`pages` of rows that hold all their ``items`` in order: each list is cut where it is, without a shuffle. Other columns stay; a row without items
    has no page."""
    n = lambda x: F.ceil(F.size(x) / size).cast("int")
    parts = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), n(x) - 1), lambda p: F.slice(x, p * size + 1, F.lit(size))))
    # In an array of one array, so that the items are worked out once for all pages.
    of_row = F.get(F.transform(F.array(items), parts), 0)
    rest = [c for c in rows.columns if c != items]
    out = rows.select(*rest, F.posexplode_outer(of_row).alias("page", items)).where(F.col(items).isNotNull())
    return out.select(*rest, F.col("page").cast("long").alias("page"), F.col(items).alias("items"))
