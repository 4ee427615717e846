"""Sources, their books and entries: lists, lookups, and hits in nested form. Joins carry no hints: dimensions are small here and large elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_books(entries: DataFrame, books: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Entries with their book's name, place and source, and with the source's title and type if ``sources`` is given."""
    of_book = books.select(F.col("id").alias("book_id"), F.col("name").alias("book"), F.col("sort_order").alias("book_order"), "source_id")
    out = entries.join(of_book, "book_id")
    if sources is not None:
        out = out.join(sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.col("type").alias("source_type")), "source_id")
    return out


def entries_of(entries: DataFrame, books: DataFrame, source_id: int, book: str, chapter: int | None) -> DataFrame:
    """The entries of a chapter in order; without a chapter those of the whole book."""
    here = (F.col("source_id") == source_id) & (F.col("name") == book)
    rows = entries.join(books.where(here).select(F.col("id").alias("book_id")), "book_id")
    return (rows if chapter is None else rows.where(F.col("chapter") == chapter)).orderBy("sort_order")


def ref_map(entries: DataFrame, books: DataFrame, source_id: int, *values: str) -> DataFrame:
    """One row per (book, chapter, verse) of a source; where several entries have a reference, the last one's ``values``."""
    rows = with_books(entries, books).where((F.col("source_id") == source_id) & F.col("chapter").isNotNull() & F.col("verse").isNotNull())
    last = F.max_by(F.struct(*values), "id").alias("e")
    return rows.groupBy("book", "chapter", "verse").agg(last).select("book", "chapter", "verse", "e.*")


def matched(refs: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(refs with the ids of stored entries, how many matched and how many did not)."""
    found = refs.join(stored.select(*keys, F.col("id").alias("entry_id")), keys, "left")
    counts = found.agg(F.count("entry_id").alias("n_matched"), F.count_if(F.col("entry_id").isNull()).alias("n_unmatched"))
    return found.where(F.col("entry_id").isNotNull()), counts


def has_rows(rows: DataFrame) -> DataFrame:
    """One row that says whether there are any; a scan ends at the first."""
    return rows.limit(1).agg((F.count("*") > 0).alias("there"))


def by_title(sources: DataFrame, title: str) -> DataFrame:
    """The source of a title; the first of several."""
    return sources.where(F.col("title") == title).orderBy("id").limit(1)


def primary_source(sources: DataFrame, shown: DataFrame) -> DataFrame:
    """The first shown bible in the order of the panes (id, pane), else the first bible, else the first source."""
    bible = F.col("type") == "bible"
    rank = F.struct(
        F.when(bible & F.col("pane").isNotNull(), 0).when(bible, 1).otherwise(2), F.when(bible, F.coalesce("pane", F.lit(1 << 30))), "id"
    )
    return sources.join(shown, "id", "left").agg(F.min_by("id", rank).alias("id")).where("id IS NOT NULL")


def nested_hits(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Hits under their source and under their book (else their label, else a dash): one row for each, with their ids in order and the source's
    total. Sources are told apart by id: two with one title stay apart."""
    place = F.coalesce("book", "position_ref", F.lit("—")).alias("place")
    groups = hits.groupBy("source_id", "source_title", place).agg(F.count("*").alias("n"), F.min("rn").alias("first"), F.sort_array(F.collect_list(F.struct("rn", "id"))).alias("hits"))
    ids = F.array_join(F.transform("hits", lambda h: h["id"].cast("string")), ",").alias("ids")
    return groups.select("source_id", "source_title", "place", "n", "first", ids).join(totals.select("source_id", "total"), "source_id", "left")


def previews(entries: DataFrame, group: list[str], order: list[str], text: str, n: int = 8, width: int = 160) -> DataFrame:
    """The first entries of each group, cut to ``width`` characters with an ellipsis."""
    shown = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(F.col(text))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return entries.withColumn("rn", rank).where(F.col("rn") <= n).withColumn(text, shown).drop("rn")


def structure(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each parsed source: how many entries it has, how many rows were blank, and what it is: verse-keyed if any row has a verse, blank ones too."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    keyed = F.bool_or(F.col("verse").isNotNull())
    return rows.groupBy(*group).agg(
        F.count_if(~blank).alias("n_entries"), F.count_if(blank).alias("n_skipped"), F.when(keyed, "verse-keyed").otherwise("freeform").alias("structure")
    )


def not_installed(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the manifest whose title is no source's, and whose requirement, if any, is one's."""
    open_rows = manifest.join(sources.select("title"), "title", "left_anti")
    there = sources.select(F.col("title").alias("requires")).distinct().withColumn("_met", F.lit(True))
    return open_rows.join(there, "requires", "left").where(F.col("requires").isNull() | F.col("_met")).drop("_met")


def once(meta: DataFrame, key: str, rows: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to add, meta after it): a job that runs once. If the flag ``key`` is set, nothing is added and meta stays."""
    flag = meta.where(F.col("key") == key).select("key")
    mark = meta.sparkSession.createDataFrame([(key,)], "key string").withColumn("value", F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss"))
    todo = mark.join(flag, "key", "left_anti")
    return rows.join(todo.select(F.lit(1).alias("_one")), F.lit(True), "left_semi"), meta.unionByName(todo)


def refreshed_tokens(tokens: DataFrame, changed: DataFrame, gone: DataFrame, split: Column) -> DataFrame:
    """The token table (entry_id, place, token) after entries changed (id, text) or went (id): theirs are left out, the changed ones' made anew."""
    stale = changed.select(F.col("id").alias("entry_id")).unionByName(gone.select(F.col("id").alias("entry_id"))).distinct()
    new = changed.select(F.col("id").alias("entry_id"), F.posexplode(split).alias("place", "token"))
    return tokens.join(stale, "entry_id", "left_anti").unionByName(new.withColumn("place", F.col("place").cast(tokens.schema["place"].dataType)))
