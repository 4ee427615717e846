"""Queries over notes, highlights and links: events, customers and orders stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators import annotate, places, reader, search
from lexweave.plans.base import query, table, values
from lexweave.plans.library import LIBRARY, of_library

NOTES = """notes AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 AND event_id % 2 = 0 THEN event_id END AS entry_id, CASE WHEN event_id % 11 > 0 THEN event_type END AS anchor_book,
  CASE WHEN event_id % 11 > 0 AND event_id % 5 > 0 THEN user_id % 20 END AS anchor_chapter, CASE WHEN event_id % 11 > 0 AND event_id % 5 > 0 AND event_id % 4 > 0 THEN event_id % 9 END AS anchor_verse,
  CASE WHEN event_id % 3 = 0 THEN event_type || ' note' END AS title, ' # ' || event_type || ' _of_ ' || user_id % 50 || chr(10) || props AS content, event_type = 'click' AS pinned, ts AS updated_at FROM events)"""


def of_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    there, chapter = k % 11 > 0, (k % 11 > 0) & (k % 5 > 0)
    return table(spark, sf_dir, "events").select(
        k.alias("id"), F.when((k % 11 == 0) & (k % 2 == 0), k).alias("entry_id"), F.when(there, kind).alias("anchor_book"), F.when(chapter, u % 20).alias("anchor_chapter"),
        F.when(chapter & (k % 4 > 0), k % 9).alias("anchor_verse"), F.when(k % 3 == 0, F.concat(kind, F.lit(" note"))).alias("title"),
        F.concat(F.lit(" # "), kind, F.lit(" _of_ "), (u % 50).cast("string"), F.lit("\n"), F.col("props")).alias("content"), (kind == "click").alias("pinned"), F.col("ts").alias("updated_at"),
    )


PENS = "pens AS (SELECT r_regionkey::BIGINT AS id, r_name AS label, '#' || r_regionkey AS color, (r_regionkey * 3 % 5)::INT AS sort_order FROM region)"


def of_pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(k.cast("long").alias("id"), F.col("r_name").alias("label"), F.concat(F.lit("#"), k.cast("string")).alias("color"), (k * 3 % 5).cast("int").alias("sort_order"))


MARKS = "marks AS (SELECT o_orderkey AS id, (o_custkey % 6)::BIGINT AS highlighter_id, n_name AS book, (o_orderkey % 10)::INT AS chapter, (o_orderkey % 7)::INT AS verse FROM orders JOIN nation ON n_nationkey = o_custkey % 25)"


def of_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.join(n, n.n_nationkey == c % 25).select(k.alias("id"), (c % 6).alias("highlighter_id"), F.col("n_name").alias("book"), (k % 10).cast("int").alias("chapter"), (k % 7).cast("int").alias("verse"))


BOUND = """links AS (SELECT o_orderkey AS id, a.n_name AS book_a, (o_custkey % 10)::INT AS chapter_a, (o_orderkey % 7)::INT AS verse_a, b.n_name AS book_b, (o_orderkey % 10)::INT AS chapter_b, (o_custkey % 7)::INT AS verse_b,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 END AS highlighter_id FROM orders JOIN nation a ON a.n_nationkey = o_custkey % 5 JOIN nation b ON b.n_nationkey = o_orderkey % 5)"""
_A, _B = ["book_a", "chapter_a", "verse_a"], ["book_b", "chapter_b", "verse_b"]


def of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "nation")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("book_a")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("book_b"))
    return o.join(a, F.col("ka") == c % 5).join(b, F.col("kb") == k % 5).select(
        k.alias("id"), "book_a", (c % 10).cast("int").alias("chapter_a"), (k % 7).cast("int").alias("verse_a"), "book_b", (k % 10).cast("int").alias("chapter_b"), (c % 7).cast("int").alias("verse_b"),
        F.when(k % 3 > 0, k % 6).alias("highlighter_id"),
    )


_FIRST = """one AS (SELECT b.name AS book, e.chapter, e.verse, arg_min(e.text, (s.id, e.id)) AS text FROM entries e JOIN books b ON b.id = e.book_id JOIN sources s ON s.id = b.source_id
  WHERE s.type = 'bible' AND e.chapter IS NOT NULL AND e.verse IS NOT NULL GROUP BY ALL)"""


def _bibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of bibles with their references."""
    from lexweave.operators.library import with_books

    sources, books, entries = of_library(spark, sf_dir)
    return with_books(entries, books, sources).where("source_type = 'bible' AND chapter IS NOT NULL AND verse IS NOT NULL")


@query(f"WITH {NOTES} SELECT id, pinned FROM notes WHERE anchor_book IS NULL AND entry_id IS NULL")
def free_notes(spark, sf_dir):
    return annotate.free_notes(of_notes(spark, sf_dir)).select("id", "pinned")


@query(f"WITH {NOTES} SELECT id, anchor_verse FROM notes WHERE anchor_book = 'click' AND (anchor_chapter = 3 OR anchor_chapter IS NULL)")
def chapter_notes(spark, sf_dir):
    return annotate.chapter_notes(of_notes(spark, sf_dir), "click", 3).select("id", "anchor_verse")


@query(f"WITH {NOTES} SELECT DISTINCT anchor_book, anchor_chapter, anchor_verse FROM notes WHERE anchor_book IS NOT NULL AND anchor_verse IS NOT NULL")
def noted_verses(spark, sf_dir):
    return annotate.noted_verses(of_notes(spark, sf_dir))


@query(
    "SELECT event_id AS id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN event_type END AS anchor_book, CASE WHEN event_id % 5 IN (0, 1) THEN user_id END AS anchor_chapter, CASE WHEN event_id % 5 = 0 THEN event_id % 9 END AS anchor_verse, "
    "CASE WHEN event_id % 3 = 0 THEN event_type END AS title, props AS content FROM events WHERE event_id % 7 > 0"
)
def note_anchor_choice(spark, sf_dir):
    k = F.col("event_id")
    choice = F.when(k % 5 == 0, "verse").when(k % 5 == 1, "chapter").when(k % 5 == 2, "book").otherwise("free")
    notes = table(spark, sf_dir, "events").select(
        k.alias("id"), choice.alias("choice"), F.col("event_type").alias("anchor_book"), F.col("user_id").alias("anchor_chapter"), (k % 9).alias("anchor_verse"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "event_type")).otherwise("  ").alias("title"), F.when(k % 7 == 0, " \n").otherwise(F.concat("props", F.lit(" "))).alias("content"),
    )
    return annotate.anchored(notes).drop("choice")


# The colors that highlighters are offered.
PALETTE = ["#f2c200", "#4caf50", "#4a90d9", "#e0669e", "#ef8b3b", "#9b6cd8", "#e5533c", "#20b2aa"]


@query(f"WITH {PENS} SELECT '#9' AS color UNION ALL SELECT '{PALETTE[0]}' UNION ALL SELECT '#0'")
def unused_color(spark, sf_dir):
    pens = of_pens(spark, sf_dir)
    return annotate.unused_color(pens, ["#0", "#3", "#9", "#8"]).unionByName(annotate.unused_color(pens, PALETTE)).unionByName(annotate.unused_color(pens, ["#0", "#1"]))


_NOTE_HITS = f"""{NOTES}, f AS (SELECT *, ' ' || regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g') || ' ' AS t, ' ' || regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g') || ' ' AS c FROM notes),
n AS (SELECT * FROM f WHERE (t LIKE '% note %' OR c LIKE '% note %') AND (t LIKE '% of %' OR c LIKE '% of %') ORDER BY updated_at DESC, id LIMIT 100)"""


@query(f"WITH {_NOTE_HITS} SELECT 'note' AS kind, id, NULL::BIGINT AS source_id, 'My Notes' AS source_title, anchor_book AS book, anchor_chapter AS chapter, anchor_verse AS verse FROM n")
def note_search(spark, sf_dir):
    return search.notes(of_notes(spark, sf_dir), "NOTE of").select("kind", "id", "source_id", "source_title", "book", "chapter", "verse")


@query(
    f"WITH {_NOTE_HITS}, {LIBRARY}, e AS (SELECT 'entry' AS kind, e.id, s.id AS source_id, s.title AS source_title, row_number() OVER (PARTITION BY s.id ORDER BY b.sort_order, e.sort_order) AS rn FROM entries e JOIN books b ON b.id = e.book_id "
    "JOIN sources s ON s.id = b.source_id WHERE e.text LIKE '% note %' AND e.text LIKE '% of %') SELECT 'note' AS kind, id, NULL::BIGINT AS source_id, 'My Notes' AS source_title, 0 AS part FROM n UNION ALL SELECT kind, id, source_id, source_title, 1 FROM e WHERE rn <= 200"
)
def search_everything(spark, sf_dir):
    from lexweave.operators.library import with_books

    sources, books, entries = of_library(spark, sf_dir)
    hits, _ = search.everything(of_notes(spark, sf_dir), with_books(entries, books, sources), "NOTE of")
    return hits.select("kind", "id", "source_id", "source_title", "part")


@query(
    f"WITH {LIBRARY}, {PENS}, {MARKS}, {_FIRST} SELECT m.id, p.label, p.color, coalesce(one.text, '') AS text, (row_number() OVER (ORDER BY p.sort_order, p.id, m.book, m.chapter, m.verse, m.id))::BIGINT AS place "
    "FROM marks m JOIN pens p ON p.id = m.highlighter_id LEFT JOIN one ON one.book = m.book AND one.chapter = m.chapter AND one.verse = m.verse"
)
def highlights_listed(spark, sf_dir):
    rows = annotate.with_colors(of_marks(spark, sf_dir), of_pens(spark, sf_dir), "inner")
    rows = annotate.first_text(_bibles(spark, sf_dir), rows, ["book", "chapter", "verse"], "text", ["source_id", "id"])
    return places.placed(rows, ["pen_order", "highlighter_id", "book", "chapter", "verse", "id"]).select("id", "label", "color", "text", "place")


@query(
    f"WITH {PENS}, {MARKS}, r AS (SELECT p.id AS highlighter_id, p.label, p.color, m.book || ' ' || m.chapter || ':' || m.verse AS spot, row_number() OVER (PARTITION BY p.id ORDER BY m.book, m.chapter, m.verse, m.id) - 1 AS nth FROM marks m JOIN pens p ON p.id = m.highlighter_id) "
    "SELECT highlighter_id, label, color, (nth // 256)::BIGINT AS page, string_agg(spot, '; ' ORDER BY nth) AS verses FROM r GROUP BY highlighter_id, label, color, nth // 256"
)
def highlights_nested(spark, sf_dir):
    """Highlights under their highlighters; the one that marks nothing and the marks of one that is gone are left out."""
    item = text.place_of(F.col("book"), F.col("chapter"), F.col("verse"))
    rows = annotate.nested_highlights(of_marks(spark, sf_dir), of_pens(spark, sf_dir), item, ["book", "chapter", "verse", "id"])
    return rows.select("highlighter_id", "label", "color", "page", F.array_join("items", "; ").alias("verses"))


@query(
    f"WITH {LIBRARY}, {PENS}, {BOUND}, {_FIRST} SELECT l.id, p.color, coalesce(a.text, '') AS text_a, coalesce(b.text, '') AS text_b FROM links l LEFT JOIN pens p ON p.id = l.highlighter_id "
    "LEFT JOIN one a ON a.book = l.book_a AND a.chapter = l.chapter_a AND a.verse = l.verse_a LEFT JOIN one b ON b.book = l.book_b AND b.chapter = l.chapter_b AND b.verse = l.verse_b"
)
def first_source_text_both_ends(spark, sf_dir):
    links = annotate.with_colors(of_links(spark, sf_dir), of_pens(spark, sf_dir), "left")
    entries = _bibles(spark, sf_dir).select(F.col("book").alias("book_a"), F.col("chapter").alias("chapter_a"), F.col("verse").alias("verse_a"), "text", "source_id", F.col("id").alias("entry_id"))
    return annotate.texts_of_both_ends(links, entries, _A, _B, "text", ["source_id", "entry_id"]).select("id", "color", "text_a", "text_b")


@query(
    f"WITH {BOUND}, pair AS (SELECT *, least((book_a, chapter_a, verse_a), (book_b, chapter_b, verse_b)) AS lo, greatest((book_a, chapter_a, verse_a), (book_b, chapter_b, verse_b)) AS hi FROM links) "
    "SELECT min(id) AS id FROM pair p WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM pair q WHERE q.id % 2 = 0 AND q.lo = p.lo AND q.hi = p.hi) GROUP BY lo, hi"
)
def links_inserted(spark, sf_dir):
    links = of_links(spark, sf_dir)
    return annotate.new_links(links.where("id % 2 = 0"), links.where("id % 2 = 1"), _A, _B, "id").select("id")


@query(f"WITH {NOTES} SELECT id, CASE WHEN id % 4 = 0 THEN NOT pinned ELSE pinned END AS pinned FROM notes WHERE id % 10 <> 7")
def notes_updated_and_deleted(spark, sf_dir):
    left = annotate.deleted(of_notes(spark, sf_dir), F.col("id") % 10 == 7)
    return annotate.updated(left, F.col("id") % 4 == 0, pinned=~F.col("pinned")).select("id", "pinned")


@query(f"WITH {NOTES} SELECT id, CASE WHEN id % 6 = 0 THEN trim(content) || chr(10) || chr(10) || '> more ' || id ELSE content END AS content FROM notes")
def note_appended(spark, sf_dir):
    notes = of_notes(spark, sf_dir)
    blocks = notes.where("id % 6 = 0").select("id", F.concat(F.lit("> more "), F.col("id").cast("string")).alias("block"))
    return annotate.appended(notes, blocks).select("id", "content")


@query(f"WITH {BOUND} SELECT id, CASE WHEN id % 2 = 1 THEN highlighter_id WHEN highlighter_id = 2 THEN NULL ELSE 2 END AS highlighter_id FROM links")
def link_color_toggled(spark, sf_dir):
    links = of_links(spark, sf_dir)
    return annotate.toggled(links, links.where("id % 2 = 0").select("id", F.lit(2).cast("long").alias("chosen"))).select("id", "highlighter_id")


_SELECTION = "sel AS (SELECT DISTINCT book, chapter, verse FROM marks WHERE book = (SELECT min(book) FROM marks) AND verse BETWEEN 2 AND 5)"


@query(f"WITH {MARKS}, {_SELECTION}, k AS (SELECT book, chapter, verse, min(id) AS id, arg_min(highlighter_id, id) AS highlighter_id FROM marks GROUP BY ALL) SELECT book, chapter, verse, id, CASE WHEN (book, chapter, verse) IN (SELECT (book, chapter, verse) FROM sel) THEN 9 ELSE highlighter_id END AS highlighter_id FROM k")
def highlighter_applied(spark, sf_dir):
    marks = of_marks(spark, sf_dir)
    kept = marks.groupBy("book", "chapter", "verse").agg(F.min("id").alias("id"), F.min_by("highlighter_id", "id").alias("highlighter_id"))
    refs = _selection(marks).withColumns({"id": F.lit(0).cast("long"), "highlighter_id": F.lit(9).cast("long")})
    return annotate.upserted(kept, refs, ["book", "chapter", "verse"], ["highlighter_id"])


@query(f"WITH {MARKS}, {_SELECTION} SELECT id FROM marks WHERE (book, chapter, verse) NOT IN (SELECT (book, chapter, verse) FROM sel)")
def highlighter_erased(spark, sf_dir):
    marks = of_marks(spark, sf_dir)
    return annotate.erased(marks, _selection(marks), ["book", "chapter", "verse"]).select("id")


def _selection(marks: DataFrame) -> DataFrame:
    """The verses from 5 back to 2 of the first book."""
    first = marks.agg(F.min("book").alias("book"))  # one row
    return annotate.selected(marks.join(first, "book", "left_semi"), "verse", F.lit(5), F.lit(2)).select("book", "chapter", "verse").distinct()


@query(f"WITH {PENS} SELECT coalesce(max(sort_order), -1) + 1 AS sort_order FROM pens UNION ALL SELECT 0")
def next_sort_order(spark, sf_dir):
    pens = of_pens(spark, sf_dir)
    return annotate.next_sort_order(pens).unionByName(annotate.next_sort_order(pens.where("false")))


@query(
    f"WITH {NOTES} SELECT id, CASE WHEN anchor_book IS NULL THEN 'Freeform' WHEN anchor_verse IS NOT NULL THEN anchor_book || ' ' || anchor_chapter || ':' || anchor_verse WHEN anchor_chapter IS NOT NULL THEN anchor_book || ' ' || anchor_chapter || ' (chapter)' "
    "ELSE anchor_book || ' (book)' END AS label, coalesce(title, split_part(replace(replace(trim(content), '# ', ''), '_', ''), chr(10), 1)) AS preview, coalesce(title, CASE WHEN anchor_book IS NULL THEN split_part(replace(replace(trim(content), '# ', ''), '_', ''), chr(10), 1) "
    "WHEN anchor_verse IS NOT NULL THEN anchor_book || ' ' || anchor_chapter || ':' || anchor_verse WHEN anchor_chapter IS NOT NULL THEN anchor_book || ' ' || anchor_chapter ELSE anchor_book END) AS menu FROM notes"
)
def note_labels(spark, sf_dir):
    at = [F.col(c) for c in ("anchor_book", "anchor_chapter", "anchor_verse")]
    title, content = F.col("title"), F.col("content")
    return of_notes(spark, sf_dir).select("id", text.anchor_label(*at).alias("label"), text.preview(title, content).alias("preview"), text.menu_label(title, content, *at).alias("menu"))


_VERSES = "v AS (SELECT conv_id, 'Book' AS book, 3 AS chapter, turn AS verse, CASE WHEN conv_id % 2 = 0 THEN 'KJV' END AS source_title, text FROM conversations WHERE text IS NOT NULL)"


@query(
    f"WITH {_VERSES}, r AS (SELECT conv_id, verse, verse - row_number() OVER (PARTITION BY conv_id ORDER BY verse) AS g FROM v), i AS (SELECT conv_id, min(verse) AS a, max(verse) AS b FROM r GROUP BY conv_id, g), "
    "l AS (SELECT conv_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS label FROM i GROUP BY conv_id) "
    "SELECT v.conv_id, '> **Book 3:' || any_value(label) || '**' || CASE WHEN v.conv_id % 2 = 0 THEN ' — KJV' ELSE '' END || chr(10) || '>' || chr(10) || string_agg('> ' || CASE WHEN c > 1 THEN '**' || verse || '** ' ELSE '' END || trim(text), chr(10) ORDER BY verse) AS markdown "
    "FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c FROM v) v JOIN l USING (conv_id) GROUP BY v.conv_id"
)
def verses_markdown(spark, sf_dir):
    return annotate.verses_markdown(_verses(spark, sf_dir), ["conv_id"])


def _verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        "conv_id", F.lit("Book").alias("book"), F.lit(3).alias("chapter"), F.col("turn").alias("verse"), F.when(F.col("conv_id") % 2 == 0, "KJV").alias("source_title"), "text"
    )


@query(
    f"WITH {_VERSES}, m AS (SELECT conv_id, verse, '> **Book 3:' || verse || '**' || CASE WHEN conv_id % 2 = 0 THEN ' — KJV' ELSE '' END || chr(10) || '>' || chr(10) || '> ' || trim(text) AS md FROM v) "
    "SELECT a.conv_id, a.md || chr(10) || chr(10) || '🔗 *linked with*' || chr(10) || chr(10) || b.md AS markdown FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.verse = 0 AND b.verse = 1"
)
def link_markdown(spark, sf_dir):
    ends = _verses(spark, sf_dir).where("verse IN (0, 1)").withColumn("side", F.col("verse").cast("int"))
    return annotate.link_markdown(ends, ["conv_id"]).where("markdown IS NOT NULL")


@query("SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND conv_id % 4 OR turn BETWEEN conv_id % 4 AND 1")
def range_selected(spark, sf_dir):
    return annotate.selected(table(spark, sf_dir, "conversations"), "turn", F.col("conv_id") % 4, F.lit(1)).select("conv_id", "turn")


@query(
    "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 > 0 THEN 'n' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN source || chr(10) || ' x' WHEN 1 THEN '# ' || source || chr(10) || chr(10) || '**b** y' ELSE source END AS content FROM documents WHERE doc_id % 5 > 0"
)
def notes_imported(spark, sf_dir):
    k, name = F.col("doc_id"), F.col("source")
    body = F.when(k % 3 == 0, F.concat(F.lit("{\\rtf1 "), name, F.lit("\\par x}"))).when(k % 3 == 1, F.concat(F.lit("<html><head><title>t</title></head><body><h1>"), name, F.lit("</h1><p><b> b </b> y</p></body>"))).otherwise(F.concat(name, F.lit("\n")))
    kind = F.when(k % 3 == 0, "rtf").when(k % 3 == 1, "html").otherwise("text")
    files = table(spark, sf_dir, "documents").select(k.cast("string").alias("path"), F.when(k % 4 > 0, F.concat(F.lit("n"), k.cast("string"))).otherwise("").alias("title"), kind.alias("kind"), F.when(k % 5 > 0, body).otherwise(" ").alias("text"))
    return annotate.imported_notes(files)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0")
def ids_in_set(spark, sf_dir):
    """Membership in a set of any size is a semi-join, and an empty set lets nothing through."""
    o = table(spark, sf_dir, "orders")
    wanted = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"))
    rows = o.select(F.col("o_custkey").alias("id")).distinct()
    return rows.join(wanted, "id", "left_semi").unionByName(rows.join(values(spark, "id long"), "id", "left_semi"))


@query("SELECT conv_id, turn, turn > least(3, conv_id % 9) AND turn <= greatest(3, conv_id % 9) AS within FROM conversations")
def selection_flags(spark, sf_dir):
    low, high = F.least(F.lit(3), F.col("conv_id") % 9), F.greatest(F.lit(3), F.col("conv_id") % 9)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reader.in_selection(F.col("turn"), low + 1, high).alias("within"))
