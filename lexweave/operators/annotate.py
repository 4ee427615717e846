"""Notes, highlights and links as pure functions of tables: old table and change in, new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import html_to_markdown, strip_rtf, trimmed
from lexweave.operators.places import PAGE, pages, placed, within
from lexweave.operators.reader import range_label


def upserted(table: DataFrame, incoming: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """Rows of ``table`` take the ``replaced`` columns of incoming rows with their keys; other incoming rows are added."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in replaced], F.lit(True).alias("_there"))
    kept = table.join(new, keys, "left").withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in replaced})
    return kept.select(*table.columns).unionByName(incoming.join(table, keys, "left_anti"), allowMissingColumns=True)


def replaced(table: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """INSERT OR REPLACE: the last incoming row of a key wins."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    new = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*table.columns)
    return table.join(new, keys, "left_anti").unionByName(new)


def updated(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def without_highlighter(highlights: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cascade: highlights of the gone highlighters go, links lose their color."""
    ids = gone.select(F.col("id").alias("highlighter_id")).distinct()
    bare = links.join(ids.withColumn("_gone", F.lit(True)), "highlighter_id", "left")
    return highlights.join(ids, "highlighter_id", "left_anti"), bare.withColumn("highlighter_id", F.when(F.col("_gone").isNull(), F.col("highlighter_id"))).drop("_gone")


def without_source(source: DataFrame, books: DataFrame, entries: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """All that hangs off a source, by anti-joins down the chain."""
    gone_books = books.join(source.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    gone = entries.join(gone_books.select(F.col("id").alias("book_id")), "book_id", "left_semi").select(F.col("id").alias("entry_id"))
    return (
        books.join(gone_books.select("id"), "id", "left_anti"),
        entries.join(gone.select(F.col("entry_id").alias("id")), "id", "left_anti"),
        *[c.join(gone, "entry_id", "left_anti") for c in children],
    )


def changed(stored: DataFrame, new: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows whose text is another in ``new``."""
    return stored.join(new.select(*keys, F.col(text).alias("new_text")), keys).where(F.col(text) != F.col("new_text"))


def undirected(links: DataFrame, a: list[str], b: list[str], first: str) -> DataFrame:
    """One row for each pair of ends, whichever way round: the one that came first."""
    ends = F.array_sort(F.array(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(a)]), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(b)])))
    once = Window.partitionBy("_ends").orderBy(first)
    return links.withColumn("_ends", ends).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n", "_ends")


def end_points(links: DataFrame, a: list[str], b: list[str], keep: list[str]) -> DataFrame:
    """A row for each end of each link, in one scan."""
    end = lambda cols: F.struct(*[F.col(c).alias(n) for c, n in zip(cols, a)])
    return links.select(*keep, F.explode(F.array(end(a), end(b))).alias("e")).select(*keep, "e.*")


def first_color(ends: DataFrame, keys: list[str], color: str, order: str) -> DataFrame:
    return ends.groupBy(*keys).agg(F.min_by(F.when(F.col(color).isNotNull(), F.col(color)), F.when(F.col(color).isNotNull(), F.col(order))).alias(color))


def first_text(entries: DataFrame, refs: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Each reference with the text that the first source has for it, or the empty text."""
    one = entries.groupBy(*keys).agg(F.min_by(text, F.struct(*order)).alias("text"))
    return refs.join(one, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def _note_order() -> list[Column]:
    return [F.desc("pinned"), F.asc_nulls_last("anchor_verse"), F.desc("updated_at"), F.asc("id")]


def note_order(notes: DataFrame) -> DataFrame:
    return notes.orderBy(*_note_order())


def note_places(notes: DataFrame) -> DataFrame:
    """``notes`` with their ``place`` in :func:`note_order`."""
    return placed(notes, _note_order())


def export_blocks(notes: DataFrame, block: Column, order: list[Column | str]) -> DataFrame:
    """(place, block) of all notes in ``order``, each in one row, however many there are."""
    return placed(notes, order).select("place", block.alias("block"))


def nested_highlights(highlights: DataFrame, highlighters: DataFrame, item: Column, order: list[Column | str], size: int = PAGE) -> DataFrame:
    """Highlighters with what is marked with them: pages of items in ``order``. A highlighter that marks nothing is left out."""
    pen = ["pen_order", "highlighter_id", "label", "color"]
    return pages(within(with_colors(highlights, highlighters, "inner"), pen, order), pen, "nth", item, size)


def chapter_notes(notes: DataFrame, book: str, chapter: int) -> DataFrame:
    here = (F.col("anchor_chapter") == chapter) | F.col("anchor_chapter").isNull()
    return note_order(notes.where((F.col("anchor_book") == book) & here))


def next_sort_order(table: DataFrame) -> DataFrame:
    return table.agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("sort_order"))


def free_notes(notes: DataFrame) -> DataFrame:
    """Notes without any anchor, pinned and latest first."""
    return notes.where(F.col("anchor_book").isNull() & F.col("entry_id").isNull()).orderBy(F.desc("pinned"), F.desc("updated_at"), "id")


def noted_verses(notes: DataFrame) -> DataFrame:
    """Each verse that has a note of its own."""
    return notes.where(F.col("anchor_book").isNotNull() & F.col("anchor_verse").isNotNull()).select("anchor_book", "anchor_chapter", "anchor_verse").distinct()


def anchored(notes: DataFrame, choice: str = "choice") -> DataFrame:
    """Notes whose anchor goes as far as was chosen: verse, chapter or book; any other choice leaves it free. Title and content are trimmed, a blank
    title is none, a note without content falls out."""
    far = F.col(choice)
    verse, chapter, book = far == "verse", far.isin("verse", "chapter"), far.isin("verse", "chapter", "book")
    return notes.withColumns(
        {
            "title": F.nullif(trimmed(F.col("title")), F.lit("")), "content": trimmed(F.col("content")), "anchor_book": F.when(book, F.col("anchor_book")),
            "anchor_chapter": F.when(chapter, F.col("anchor_chapter")), "anchor_verse": F.when(verse, F.col("anchor_verse")),
        }
    ).where("content <> ''")


def unused_color(highlighters: DataFrame, palette: list[str]) -> DataFrame:
    """The first color of the palette that no highlighter has, else the first of all."""
    colors = highlighters.sparkSession.createDataFrame(list(enumerate(palette)), "place int, color string")
    left = colors.join(highlighters.select("color").distinct(), "color", "left_anti")
    return left.agg(F.coalesce(F.min_by("color", "place"), F.lit(palette[0])).alias("color"))


def appended(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Notes with the ``block`` of their id below their content."""
    out = notes.join(blocks.select("id", "block"), "id", "left")
    body = F.concat_ws("\n\n", F.nullif(trimmed(F.col("content")), F.lit("")), "block")
    return out.withColumn("content", F.when(F.col("block").isNull(), F.col("content")).otherwise(body)).select(*notes.columns)


def toggled(links: DataFrame, chosen: DataFrame, color: str = "highlighter_id") -> DataFrame:
    """Links (id, color) with the color chosen for them (id, chosen); to choose the one that a link has clears it."""
    out = links.join(chosen.select("id", "chosen"), "id", "left")
    new = F.when(F.col(color).eqNullSafe(F.col("chosen")), F.lit(None)).otherwise(F.col("chosen"))
    return out.withColumn(color, F.when(F.col("chosen").isNull(), F.col(color)).otherwise(new)).select(*links.columns)


def selected(rows: DataFrame, verse: str, anchor: Column, clicked: Column) -> DataFrame:
    """Rows from the anchor to the click, whichever comes first."""
    return rows.where(F.col(verse).between(F.least(anchor, clicked), F.greatest(anchor, clicked)))


def erased(highlights: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    return highlights.join(refs.select(*keys).distinct(), keys, "left_anti")


def new_links(stored: DataFrame, incoming: DataFrame, a: list[str], b: list[str], first: str) -> DataFrame:
    """Incoming links that are not stored yet, either way round; the first of each pair."""
    pair = F.array_sort(F.array(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(a)]), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(b)])))
    return undirected(incoming, a, b, first).withColumn("_pair", pair).join(stored.select(pair.alias("_pair")).distinct(), "_pair", "left_anti").drop("_pair")


def with_colors(rows: DataFrame, highlighters: DataFrame, how: str) -> DataFrame:
    """Highlights (``inner``) or links (``left``: they may have none) with label, color and place of their highlighter."""
    pens = highlighters.select(F.col("id").alias("highlighter_id"), "label", "color", F.col("sort_order").alias("pen_order"))
    return rows.join(pens, "highlighter_id", how)


def texts_of_both_ends(links: DataFrame, entries: DataFrame, a: list[str], b: list[str], text: str, order: list[str]) -> DataFrame:
    """Links with text_a and text_b, the texts that the first source has for their ends, or the empty text."""
    keys = [f"_k{i}" for i in range(len(a))]
    one = entries.groupBy(*[F.col(c).alias(k) for c, k in zip(a, keys)]).agg(F.min_by(text, F.struct(*order)).alias("_text"))
    for cols, name in ((a, "text_a"), (b, "text_b")):
        there = [F.col(c) == F.col(k) for c, k in zip(cols, keys)]
        links = links.join(one, there, "left").withColumn(name, F.coalesce("_text", F.lit(""))).drop("_text", *keys)
    return links


def verses_markdown(verses: DataFrame, by: list[str]) -> DataFrame:
    """Verses (by, book, chapter, verse, source_title, text) as one quotation per group: reference and source, then the verses in order, with their
    numbers if there are more than one."""
    label = range_label(verses, [*by, "book", "chapter"], "verse")
    rows = F.sort_array(F.collect_list(F.struct("verse", "text"))).alias("rows")
    grouped = verses.groupBy(*by, "book", "chapter").agg(rows, F.min_by("source_title", "verse").alias("source"))
    number = lambda v: F.when(F.size("rows") > 1, F.concat(F.lit("**"), v["verse"].cast("string"), F.lit("** "))).otherwise("")
    body = F.array_join(F.transform("rows", lambda v: F.concat(F.lit("> "), number(v), trimmed(v["text"]))), "\n")
    head = F.concat(F.lit("> **"), "book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), "label", F.lit("**"), F.coalesce(F.concat(F.lit(" — "), F.nullif("source", F.lit(""))), F.lit("")))
    return grouped.join(label, [*by, "book", "chapter"]).select(*by, F.concat(head, F.lit("\n>\n"), body).alias("markdown"))


# Fixed value: what stands between two linked verses.
LINKED = "\n\n🔗 *linked with*\n\n"


def link_markdown(ends: DataFrame, by: list[str], side: str = "side") -> DataFrame:
    """Two verses (side 0 and 1) as quotations with ``linked with`` between them."""
    shown = verses_markdown(ends, [*by, side]).groupBy(*by)
    pick = lambda n: F.max(F.when(F.col(side) == n, F.col("markdown")))
    return shown.agg(F.concat(pick(0), F.lit(LINKED), pick(1)).alias("markdown"))


def imported_notes(files: DataFrame) -> DataFrame:
    """Notes of files (path, title, kind, text): RTF and HTML become Markdown, blank ones fall out, all are free."""
    body = F.when(F.col("kind") == "rtf", strip_rtf(F.col("text"))).when(F.col("kind") == "html", html_to_markdown("text")).otherwise(F.col("text"))
    return files.select("path", F.nullif("title", F.lit("")).alias("title"), trimmed(body).alias("content")).where("content <> ''")


def rewritten(stored: DataFrame, changed: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``stored`` with the ``new_text`` of changed rows (keys, new_text), as :func:`changed` finds them."""
    out = stored.join(changed.select(*keys, "new_text"), keys, "left")
    return out.withColumn(text, F.coalesce("new_text", text)).select(*stored.columns)
