"""Reading a text: chapters, neighbours, parallel sources, ranges of verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chapters(entries: DataFrame, chapter: str) -> DataFrame:
    return entries.where(F.col(chapter).isNotNull()).select(chapter).distinct().orderBy(chapter)


def chapter_or_first(entries: DataFrame, by: list[str], chapter: str, wanted: int) -> DataFrame:
    """The wanted chapter where a container has it, else its first, else null."""
    has = F.max(F.when(F.col(chapter) == wanted, F.col(chapter)))
    return entries.groupBy(*by).agg(F.coalesce(has, F.min(chapter)).alias("chapter"))


def neighbours(entries: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Each container with the one before and after it, over the ends of books."""
    w = Window.partitionBy(*part).orderBy(*order)
    at = F.struct(*order)
    return entries.select(*part, *order).distinct().select(*part, *order, *[F.lag(c).over(w).alias(f"previous_{c}") for c in order], *[F.lead(c).over(w).alias(f"next_{c}") for c in order]).drop(at)


def parallel(entries: DataFrame, keys: list[str], source: str, sources: list[str], text: str) -> DataFrame:
    """Up to four sources side by side on the reference."""
    return entries.groupBy(*keys).pivot(source, sources[:4]).agg(F.min(text))


def panes(entries: DataFrame, refs: DataFrame, sources: list[str], source: str = "source", book: str = "book", chapter: str = "chapter") -> DataFrame:
    """For each reference (book, chapter) of ``refs`` what up to four sources show beside each other: the chapter, else the last one before it, else
    the book's first; of a source that lacks the book, its own first chapter.

    An as-of alignment by one window over references and chapters together: no range join, and what meets is a book of a source.
    """
    there = entries.where(F.col(source).isin(sources[:4]) & F.col(chapter).isNotNull()).select(F.col(source).alias("source"), F.col(book).alias("book"), F.col(chapter).alias("chapter")).distinct()
    asked = refs.select(F.col(book).alias("book"), F.col(chapter).alias("chapter")).distinct().withColumn("source", F.explode(F.array(*[F.lit(x) for x in sources[:4]])))
    both = there.withColumn("here", F.col("chapter")).unionByName(asked.withColumn("here", F.lit(None).cast(there.schema["chapter"].dataType)), allowMissingColumns=True)
    per = Window.partitionBy("source", "book")
    upto = per.orderBy("chapter", F.asc_nulls_last("here")).rowsBetween(Window.unboundedPreceding, 0)
    shown = both.withColumn("shown", F.coalesce(F.last("here", ignorenulls=True).over(upto), F.min("here").over(per))).where("here IS NULL").drop("here")
    own = there.groupBy("source").agg(F.min(F.struct("book", "chapter")).alias("own"))  # a row for each of four sources at most
    out = shown.join(F.broadcast(own), "source", "left")
    lacks = F.col("shown").isNull()
    return out.select("book", "chapter", "source", F.when(lacks, F.col("own.book")).otherwise(F.col("book")).alias("shown_book"), F.when(lacks, F.col("own.chapter")).otherwise(F.col("shown")).alias("shown_chapter"))


def islands(rows: DataFrame, by: list[str], verse: str) -> DataFrame:
    """Runs of consecutive numbers; a number that repeats starts a run of its own."""
    w = Window.partitionBy(*by).orderBy(verse, "_tie")
    start = F.coalesce(F.col(verse) - F.lag(verse).over(w) != 1, F.lit(True))
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_s", start.cast("int"))
    run = numbered.withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min(verse).alias("first"), F.max(verse).alias("last"))


def range_label(rows: DataFrame, by: list[str], verse: str) -> DataFrame:
    label = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    spans = F.sort_array(F.collect_list(F.struct("_run", label.alias("label"))))
    return islands(rows, by, verse).groupBy(*by).agg(F.array_join(F.transform(spans, lambda x: x["label"]), ", ").alias("label"))


def in_selection(verse: Column, anchor: Column, clicked: Column) -> Column:
    return verse.between(anchor, clicked)
