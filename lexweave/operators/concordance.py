"""Concordance over word tags (entry_id, word_index, surface_text, number) and a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.places import PAGE, cut, pages
from lexweave.operators.search import word_start
from lexweave.sources.tables import by_repeats


def counts(tags: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows per number and book; the book's place is the least of its rows."""
    return tags.groupBy("number", *by).agg(F.count("*").alias("n"), F.min(order).alias("place"))


def rolled_up(per_book: DataFrame, book: str) -> DataFrame:
    """Totals per number with its books in order. Books of a number are as many as there are sources of text."""
    books = F.sort_array(F.collect_list(F.struct("place", F.col(book).alias("book"), "n")))
    return per_book.groupBy("number").agg(F.sum("n").alias("total"), F.array_join(F.transform(books, lambda x: F.concat_ws(":", x["book"], x["n"].cast("string"))), ",").alias("books"))


def with_dictionary(groups: DataFrame, dictionary: DataFrame, number: str | None = None) -> DataFrame:
    """Lexicon rows beside the groups, null where there is none. The row of a number that was asked for and has no group is
    added with the total 0."""
    out = groups.join(dictionary, "number", "left")
    if number is not None:
        bare = dictionary.where(F.col("number") == number).join(groups.select("number"), "number", "left_anti")
        out = out.unionByName(bare.withColumn("total", F.lit(0).cast("long")), allowMissingColumns=True)
    return out


def slots(tags: DataFrame) -> DataFrame:
    return tags.agg(F.countDistinct("entry_id", "word_index").alias("n_slots"))


def drilled(tags: DataFrame, term: str, number: str, book: Column, n: int = 800) -> DataFrame:
    found = tags.where((F.col("number") == number) & book & word_start(term, F.col("surface_text")))
    return found.orderBy("entry_id", "word_index").limit(n)


def grouped_slots(tags: DataFrame) -> DataFrame:
    """One row per slot: its numbers in order and its first surface text."""
    row = F.struct("id", "surface_text", "number")
    rows = tags.groupBy("entry_id", "word_index").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return rows.select("entry_id", "word_index", F.col("r")[0]["surface_text"].alias("surface_text"), F.array_join(F.col("r.number"), " ").alias("numbers"))


def _slot_list(words: Column) -> Column:
    """The slots of an entry whose words are array<struct<word_index, surface_text, numbers: array<string>>>."""
    return F.transform(words, lambda w: F.struct(w["word_index"].cast("long").alias("word_index"), w["surface_text"].alias("surface_text"), F.array_join(w["numbers"], " ").alias("numbers")))


def _listed(entries: DataFrame) -> DataFrame:
    # Outer and a filter after it: below an inner one, Spark would work out the words once more to filter rows.
    return entries.select("entry_id", F.explode_outer(_slot_list(F.col("words"))).alias("w")).where("w IS NOT NULL").select("entry_id", "w.*")


def slots_of_entries(entries: DataFrame) -> DataFrame:
    """:func:`grouped_slots` of entries (entry_id, words: array<struct<word_index, surface_text, numbers>>) whose tags already stand under their words: an
    entry gives its slots where it is read. Of entries that share an id, null too, equal slots are one; only slots of such entries are shuffled."""
    once, more = by_repeats(entries, "entry_id")
    return _listed(once).unionByName(_listed(more).distinct())


def pages_of_entries(entries: DataFrame, size: int = PAGE) -> DataFrame:
    """entry_id, page, items: :func:`slots_of_entries` in pages, each item a word and its numbers (``word|H1 H2``). Places of words count from 0 without
    gaps in an entry of its own; where entries share an id, their unlike slots at one place stand beside each other, in the order of items."""
    once, more = by_repeats(entries, "entry_id")
    said = lambda w: F.concat(w["surface_text"], F.lit("|"), w["numbers"])
    own = cut(once.select("entry_id", F.transform(F.array_sort(_slot_list(F.col("words"))), said).alias("items")), "items", size)
    item = F.concat("surface_text", F.lit("|"), "numbers")
    return own.unionByName(pages(_listed(more).distinct(), ["entry_id"], "word_index", item, size))


def same_tag_slots(tags: DataFrame, clicked: DataFrame) -> DataFrame:
    """Slots of an entry that share a number with its clicked slot; the clicked slot alone if it has none."""
    numbers = tags.join(clicked, ["entry_id", "word_index"], "left_semi").select("entry_id", "number").distinct()
    shared = tags.join(numbers, ["entry_id", "number"], "left_semi").select("entry_id", "word_index")
    return shared.unionByName(clicked.select("entry_id", F.col("word_index").cast(tags.schema["word_index"].dataType).alias("word_index"))).distinct()


# Fixed value: how a definition names another entry.
REFERENCE = r"\b([HG]\d{1,5})\b"


def cross_references(dictionary: DataFrame, definition: str) -> DataFrame:
    found = F.regexp_extract_all(F.col(definition), F.lit(REFERENCE), F.lit(1))
    return dictionary.select("number", F.explode(F.array_distinct(found)).alias("refers_to"))


def card(number: Column, lemma: Column, translit: Column, pron: Column, n: Column) -> Column:
    """``H1 — lemma — translit (pron) (n)``, without what is missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    said = F.when(some(translit).isNotNull(), F.concat_ws(" ", translit, F.concat(F.lit("("), some(pron), F.lit(")"))))
    return F.concat(F.concat_ws(" — ", number, some(lemma), said), F.lit(" ("), F.format_number(n, 0), F.lit(")"))


def card_definition(full: Column, short: Column) -> Column:
    full, short = F.nullif(full, F.lit("")), F.nullif(short, F.lit(""))
    return F.coalesce(F.concat(full, F.lit(" — KJV: "), short), full, short)


def drilled_in(tags: DataFrame, entries: DataFrame, books: DataFrame, sources: DataFrame, term: str, number: str, book: str, n: int = 800) -> DataFrame:
    """The first ``n`` hits of a number in the books of a name, with the entry, book and source of each."""
    of_book = books.where(F.col("name") == book).select(F.col("id").alias("book_id"), F.col("name").alias("book"), "source_id")
    found = tags.where((F.col("number") == number) & word_start(term, F.col("surface_text")))
    rows = found.join(entries.select(F.col("id").alias("entry_id"), "book_id", "chapter", "verse", "sort_order"), "entry_id").join(of_book, "book_id")
    rows = rows.join(sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), "source_id")
    return rows.orderBy("source_id", "sort_order", "word_index").limit(n)


def without_tags_of(source_entries: DataFrame, tags: DataFrame, notes: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, notes, dictionary) after the tags of a source are cleared: its own go, and all of the dictionary."""
    ids = source_entries.select(F.col("id").alias("entry_id"))
    return tags.join(ids, "entry_id", "left_anti"), notes.join(ids, "entry_id", "left_anti"), dictionary.where(F.lit(False))


def notes_at_words(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """Notes (entry_id, word_index) with ``at``: the word they are shown at, or ``end`` of the entry where no such word is shown."""
    shown = tags.select("entry_id", "word_index").distinct().withColumn("_there", F.lit(True))
    out = notes.join(shown, ["entry_id", "word_index"], "left")
    return out.withColumn("at", F.when(F.col("_there"), F.col("word_index").cast("string")).otherwise("end")).drop("_there")
