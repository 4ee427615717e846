"""Queries over sources, books and entries: region, nation and customer stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import names, text
from lexweave.operators import annotate, concordance, library, places, search
from lexweave.plans.base import query, table, values
from lexweave.sources import manifest

LIBRARY = """sources AS (SELECT r_regionkey::BIGINT AS id, r_name AS title, CASE WHEN r_regionkey % 2 = 1 THEN 'bible' ELSE 'reference' END AS type FROM region),
books AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS source_id, n_name AS name, n_nationkey AS sort_order FROM nation),
entries AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS book_id, CASE WHEN c_custkey % 17 > 0 THEN (c_custkey % 10)::INT END AS chapter,
  CASE WHEN c_custkey % 13 > 0 THEN (c_custkey % 7)::INT END AS verse, c_name || ' ' || lower(c_mktsegment) AS text, c_custkey AS sort_order FROM customer)"""


def of_library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, books, entries)"""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    sources = r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 1, "bible").otherwise("reference").alias("type"))
    books = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("source_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("sort_order"))
    k = F.col("c_custkey")
    entries = c.select(
        k.alias("id"), F.col("c_nationkey").cast("long").alias("book_id"), F.when(k % 17 > 0, (k % 10).cast("int")).alias("chapter"), F.when(k % 13 > 0, (k % 7).cast("int")).alias("verse"),
        F.concat("c_name", F.lit(" "), F.lower("c_mktsegment")).alias("text"), k.alias("sort_order"),
    )
    return sources, books, entries


@query(f"WITH {LIBRARY} SELECT id, title, type FROM sources ORDER BY id")
def list_sources(spark, sf_dir):
    return of_library(spark, sf_dir)[0].orderBy("id")


@query(f"WITH {LIBRARY} SELECT e.id, e.verse, e.text FROM entries e JOIN books b ON b.id = e.book_id WHERE b.source_id = 1 AND b.name = (SELECT min(name) FROM books WHERE source_id = 1) AND e.chapter = 3")
def entries_of_chapter(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    first = books.where("source_id = 1").agg(F.min("name")).first()[0]
    return library.entries_of(entries, books, 1, first, 3).select("id", "verse", "text")


@query(f"WITH {LIBRARY} SELECT e.id, e.chapter, e.verse, e.text FROM entries e JOIN books b ON b.id = e.book_id WHERE b.source_id = 1 AND b.name = (SELECT min(name) FROM books WHERE source_id = 1)")
def entries_of_container(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    first = books.where("source_id = 1").agg(F.min("name")).first()[0]
    return library.entries_of(entries, books, 1, first, None).select("id", "chapter", "verse", "text")


_REFS = "SELECT b.name AS book, e.chapter, e.verse, max(e.id) AS id FROM entries e JOIN books b ON b.id = e.book_id WHERE b.source_id = 1 AND e.chapter IS NOT NULL AND e.verse IS NOT NULL GROUP BY ALL"


@query(f"WITH {LIBRARY} {_REFS}")
def entry_ref_map(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    return library.ref_map(entries, books, 1, "id")


@query(f"WITH {LIBRARY}, m AS ({_REFS}) SELECT m.*, entries.text FROM m JOIN entries USING (id)")
def entry_texts(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    return library.ref_map(entries, books, 1, "id", "text")


_NEW_REFS = "refs AS (SELECT n_name AS book, (o_orderkey % 11)::INT AS chapter, (o_custkey % 7)::INT AS verse, o_orderkey AS word FROM orders JOIN nation ON n_nationkey = o_custkey % 25)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    rows = o.join(n, n.n_nationkey == o.o_custkey % 25)
    return rows.select(F.col("n_name").alias("book"), (F.col("o_orderkey") % 11).cast("int").alias("chapter"), (F.col("o_custkey") % 7).cast("int").alias("verse"), F.col("o_orderkey").alias("word"))


@query(f"WITH {LIBRARY}, m AS ({_REFS}), {_NEW_REFS} SELECT word, m.id AS entry_id FROM refs JOIN m USING (book, chapter, verse)")
def refs_matched(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    return library.matched(_refs(spark, sf_dir), library.ref_map(entries, books, 1, "id"), ["book", "chapter", "verse"])[0].select("word", "entry_id")


@query(f"WITH {LIBRARY}, m AS ({_REFS}), {_NEW_REFS} SELECT count(m.id) AS n_matched, count(*) - count(m.id) AS n_unmatched FROM refs LEFT JOIN m USING (book, chapter, verse)")
def refs_missed(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    return library.matched(_refs(spark, sf_dir), library.ref_map(entries, books, 1, "id"), ["book", "chapter", "verse"])[1]


@query("SELECT (SELECT count(*) FROM events) > 0 AS there, (SELECT count(*) FROM events WHERE event_type = 'none') > 0 AS none")
def has_any(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return library.has_rows(e).crossJoin(library.has_rows(e.where("event_type = 'none'")).withColumnRenamed("there", "none"))  # one row each


@query(f"WITH {LIBRARY} SELECT count(*) AS n FROM sources")
def source_count(spark, sf_dir):
    return of_library(spark, sf_dir)[0].agg(F.count("*").alias("n"))


@query(f"WITH {LIBRARY} SELECT id, title FROM sources WHERE title = 'ASIA' ORDER BY id LIMIT 1")
def source_by_title(spark, sf_dir):
    return library.by_title(of_library(spark, sf_dir)[0], "ASIA").select("id", "title")


@query(f"WITH {LIBRARY} SELECT coalesce((SELECT id FROM sources WHERE type = 'bible' AND id = 3), (SELECT min(id) FROM sources WHERE type = 'bible'), (SELECT min(id) FROM sources)) AS id")
def primary_source(spark, sf_dir):
    return library.primary_source(of_library(spark, sf_dir)[0], values(spark, "id long, pane int", (2, 0), (3, 1), (1, 2)))


_HITS = f"""{LIBRARY},
h AS (SELECT s.id AS source_id, s.title AS source_title, s.type AS source_type, CASE WHEN e.id % 19 > 0 THEN b.name END AS book, e.chapter, e.verse, CASE WHEN e.id % 3 = 0 THEN '¶ ' || e.id % 4 END AS position_ref, e.id,
  (row_number() OVER (PARTITION BY s.id ORDER BY b.sort_order, e.sort_order))::BIGINT AS rn FROM entries e JOIN books b ON b.id = e.book_id JOIN sources s ON s.id = b.source_id WHERE ' ' || regexp_replace(e.text, '[^a-z0-9]+', ' ', 'g') || ' ' LIKE '% building %')"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources, books, entries = of_library(spark, sf_dir)
    rows = library.with_books(entries.withColumn("position_ref", F.when(F.col("id") % 3 == 0, F.concat(F.lit("¶ "), (F.col("id") % 4).cast("string")))), books, sources)
    rows = rows.withColumn("book", F.when(F.col("id") % 19 > 0, F.col("book")))
    hits, totals = search.search(rows, "building", "text", ["source_id"], ["book_order", "sort_order"])
    return hits, totals


@query(
    f"WITH {_HITS} SELECT source_id, source_title, coalesce(book, position_ref, '—') AS place, count(*) AS n, min(rn) AS first, string_agg(id::VARCHAR, ',' ORDER BY rn) AS ids, (SELECT count(*) FROM h g WHERE g.source_id = h.source_id) AS total "
    "FROM h WHERE rn <= 200 GROUP BY ALL"
)
def hits_by_source_and_book(spark, sf_dir):
    return library.nested_hits(*_hits(spark, sf_dir))


@query(
    f"WITH {_HITS} SELECT id, CASE WHEN book IS NOT NULL AND chapter IS NOT NULL AND verse IS NOT NULL THEN book || ' ' || chapter || ':' || verse WHEN book IS NOT NULL AND chapter IS NOT NULL THEN book || ' ' || chapter "
    "ELSE coalesce(position_ref, book, '') END AS ref FROM h WHERE rn <= 200"
)
def hit_references(spark, sf_dir):
    ref = text.hit_ref(F.col("book"), F.col("chapter"), F.col("verse"), F.col("position_ref")).alias("ref")
    return _hits(spark, sf_dir)[0].select("id", ref)


@query(f"WITH {LIBRARY} SELECT id, book_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '…' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY sort_order) AS rn FROM entries) WHERE rn <= 8")
def import_preview(spark, sf_dir):
    return library.previews(of_library(spark, sf_dir)[2], ["book_id"], ["sort_order"], "text", 8, 20).select("id", "book_id", "text")


_PARSED = "p AS (SELECT o_custkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE o_orderpriority END AS text, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 1 END AS verse FROM orders)"


@query(f"WITH {_PARSED} SELECT path, count(*) FILTER (trim(text) <> '') AS n_entries, count(*) FILTER (trim(text) = '') AS n_skipped, CASE WHEN bool_or(verse IS NOT NULL) THEN 'verse-keyed' ELSE 'freeform' END AS structure FROM p GROUP BY path")
def parsed_structure(spark, sf_dir):
    fourth = F.col("o_orderkey") % 4 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.when(fourth, "  ").otherwise(F.col("o_orderpriority")).alias("text"), F.when((F.col("o_custkey") % 3 == 0) & fourth, 1).alias("verse"))
    return library.structure(rows, ["path"])


@query(
    f"WITH {LIBRARY}, m AS (SELECT n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'ASIA' WHEN n_nationkey % 3 = 1 THEN 'ATLANTIS' END AS requires FROM nation UNION ALL SELECT 'EUROPE', NULL) "
    "SELECT title, requires FROM m WHERE title NOT IN (SELECT title FROM sources) AND (requires IS NULL OR requires IN (SELECT title FROM sources))"
)
def not_installed(spark, sf_dir):
    third = F.col("n_nationkey") % 3
    manifest = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.when(third == 0, "ASIA").when(third == 1, "ATLANTIS").alias("requires"))
    return library.not_installed(manifest.unionByName(values(spark, "title string, requires string", ("EUROPE", None))), of_library(spark, sf_dir)[0]).select("title", "requires")


_TEXTS = ", ".join(f"({i}, '{t[0]}', '{t[1]}', NULL)" for i, t in enumerate(manifest.TEXTS)) + ", " + ", ".join(f"(100, '{i}', '{t}', '{r}')" for i, t, r in manifest.ADDONS)


@query(
    f"WITH m AS (SELECT * FROM (VALUES {_TEXTS}) m(i, id, title, requires)), s AS (SELECT DISTINCT m.title FROM orders JOIN m ON m.i = o_custkey % 9) "
    "SELECT id, title FROM m WHERE title NOT IN (SELECT title FROM s) AND (requires IS NULL OR requires IN (SELECT title FROM s))"
)
def catalogue_open(spark, sf_dir):
    """What of the catalogue is not among the sources: orders name nine of its texts."""
    rows = manifest.manifest(spark)
    named = F.element_at(F.array(*[F.lit(t[1]) for t in manifest.TEXTS]), (F.col("o_custkey") % 9 + 1).cast("int"))
    sources = table(spark, sf_dir, "orders").select(named.alias("title")).distinct()
    return library.not_installed(rows, sources).select("id", "title")


@query("SELECT n_name AS label FROM nation")
def seeded_once(spark, sf_dir):
    """Rows that a flag lets in the first time, and none the second."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"))
    first, meta = library.once(values(spark, "key string, value string", ("other", "x")), "seeded", rows)
    return first.unionByName(library.once(meta, "seeded", rows)[0])


_TOKEN = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


@query(
    f"WITH {LIBRARY}, now AS (SELECT id, CASE WHEN id % 5 = 1 THEN text || ' again' ELSE text END AS text FROM entries WHERE id % 5 <> 2) "
    f"SELECT id AS entry_id, unnest({_TOKEN}) AS token, (generate_subscripts({_TOKEN}, 1) - 1)::BIGINT AS place FROM now"
)
def token_table_refreshed(spark, sf_dir):
    entries = of_library(spark, sf_dir)[2].select("id", "text")
    split = text.tokens(F.col("text"))
    old = entries.select(F.col("id").alias("entry_id"), F.posexplode(split).alias("place", "token")).withColumn("place", F.col("place").cast("long"))
    changed = entries.where("id % 5 = 1").withColumn("text", F.concat("text", F.lit(" again")))
    return library.refreshed_tokens(old, changed, entries.where("id % 5 = 2"), split)


_ENTRY_TAGS = "tags AS (SELECT l_orderkey % (SELECT count(*) FROM customer) + 1 AS entry_id, l_linenumber AS word_index, CASE WHEN l_partkey % 2 = 0 THEN 'rail way' ELSE 'railing' END AS surface_text, 'H' || l_suppkey % 5 AS number FROM lineitem)"


def _entry_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % n + 1).alias("entry_id"), F.col("l_linenumber").alias("word_index"), F.when(F.col("l_partkey") % 2 == 0, "rail way").otherwise("railing").alias("surface_text"),
        F.concat(F.lit("H"), (F.col("l_suppkey") % 5).cast("string")).alias("number"),
    )


@query(
    f"WITH {LIBRARY}, {_ENTRY_TAGS} SELECT count(*) AS n, count(DISTINCT entry_id) AS entries, min(source_title) AS source_title FROM (SELECT t.entry_id, s.title AS source_title FROM tags t JOIN entries e ON e.id = t.entry_id "
    "JOIN books b ON b.id = e.book_id JOIN sources s ON s.id = b.source_id WHERE t.number = 'H3' AND t.surface_text LIKE 'rail%' AND b.name = (SELECT min(name) FROM books) ORDER BY s.id, e.sort_order, t.word_index LIMIT 800)"
)
def concordance_drilldown_joined(spark, sf_dir):
    sources, books, entries = of_library(spark, sf_dir)
    first = books.agg(F.min("name")).first()[0]
    rows = concordance.drilled_in(_entry_tags(spark, sf_dir), entries, books, sources, "rail", "H3", first)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("entry_id").alias("entries"), F.min("source_title").alias("source_title"))


@query(f"WITH {_ENTRY_TAGS}, g AS (SELECT number, count(*) AS total FROM tags GROUP BY number) SELECT number, total, (row_number() OVER (ORDER BY total DESC, number))::BIGINT AS place FROM g")
def concordance_ranked(spark, sf_dir):
    groups = _entry_tags(spark, sf_dir).groupBy("number").agg(F.count("*").alias("total"))
    return places.placed(groups, [F.desc("total"), "number"]).select("number", "total", "place")


@query(
    f"WITH {LIBRARY}, {_ENTRY_TAGS} SELECT entry_id, count(*) AS n FROM tags WHERE entry_id NOT IN (SELECT e.id FROM entries e JOIN books b ON b.id = e.book_id WHERE b.source_id = 2) GROUP BY entry_id"
)
def tags_cleared(spark, sf_dir):
    _, books, entries = of_library(spark, sf_dir)
    gone = library.with_books(entries, books).where("source_id = 2")
    tags = _entry_tags(spark, sf_dir)
    left, _, dictionary = concordance.without_tags_of(gone, tags, tags.limit(0), tags.select("number"))
    return left.unionByName(dictionary.join(left.limit(0), "number").select(left.columns)).groupBy("entry_id").agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderkey AS id, 'H' || o_orderkey || CASE WHEN o_custkey % 2 = 0 THEN ' — ' || o_orderstatus ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN ' — ' || o_orderpriority ELSE ' — ' || o_orderpriority || ' (x)' END || ' (' || format('{:,}', o_custkey) || ')' AS card, "
    "CASE WHEN o_custkey % 5 = 0 THEN CASE WHEN o_custkey % 7 > 0 THEN o_orderstatus END WHEN o_custkey % 7 = 0 THEN o_orderpriority ELSE o_orderpriority || ' — KJV: ' || o_orderstatus END AS definition FROM orders"
)
def lexicon_cards(spark, sf_dir):
    c, p, st = F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    number = F.concat(F.lit("H"), F.col("o_orderkey").cast("string"))
    card = concordance.card(number, F.when(c % 2 == 0, st), F.when(c % 3 > 0, p), F.when(c % 3 == 2, "x"), c)
    definition = concordance.card_definition(F.when(c % 5 > 0, p), F.when(c % 7 > 0, st))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), card.alias("card"), definition.alias("definition"))


@query(f"SELECT n_nationkey AS id, CASE WHEN n_nationkey BETWEEN 1 AND 66 THEN {names.CANON}[n_nationkey] END AS book FROM nation")
def book_of_number(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), names.book_of_number(F.col("n_nationkey")).alias("book"))


@query("SELECT o_orderkey AS id, 'H' || o_custkey || ' G0 H7' AS numbers FROM orders")
def lemma_numbers(spark, sf_dir):
    lemma = F.concat(F.lit("strong:H00"), F.col("o_custkey").cast("string"), F.lit(" lemma.TR:x STRONG:g000 strong:h07 strong:X1"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(text.lemma_numbers(lemma), " ").alias("numbers"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(source || ' <b>&</b> <mark>x</mark>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>') AS html FROM documents")
def snippet_html(spark, sf_dir):
    raw = F.concat("source", F.lit(" <b>&</b> <mark>x</mark>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.escaped_but_marks(raw).alias("html"))


@query(
    f"WITH {LIBRARY}, now AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(text) ELSE text END AS text FROM entries) SELECT id, text FROM now"
)
def texts_updated(spark, sf_dir):
    entries = of_library(spark, sf_dir)[2].select("id", "text")
    found = annotate.changed(entries, entries.where("id % 3 = 0").withColumn("text", F.upper("text")), ["id"])
    return annotate.rewritten(entries, found, ["id"])
