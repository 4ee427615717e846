"""Queries over files: texts in each format are put together from the tables, a file for each customer, conversation or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.plans.base import query, table
from lexweave.sources import tables, texts

_NAMES = "CASE o_orderkey % 5 WHEN 0 THEN 'gen' WHEN 1 THEN 'II Kings' WHEN 2 THEN 'Psalm' WHEN 3 THEN 'Nope' ELSE '1 cor' END"
_BOOKS = "CASE o_orderkey % 5 WHEN 0 THEN 'Genesis' WHEN 1 THEN '2 Kings' WHEN 2 THEN 'Psalms' WHEN 3 THEN 'Nope' ELSE '1 Corinthians' END"
_PLACE = "CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 19 WHEN 3 THEN 1000 ELSE 46 END"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "gen").when(k % 5 == 1, "II Kings").when(k % 5 == 2, "Psalm").when(k % 5 == 3, "Nope").otherwise("1 cor")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("path"), k.alias("i"), name.alias("name"), (k % 7).cast("string").alias("ch"), (F.col("o_custkey") % 6).cast("string").alias("v"),
        F.col("o_orderpriority").alias("said"), (F.col("o_custkey") % 2 == 0).alias("even"),
    )
    return tables.dealt(rows, "path", orders.count())  # Parquet's own counts


def _file(rows: DataFrame, line: Column, head: str = "", between: str = "\n", tail: str = "") -> DataFrame:
    """A file for each path with its lines in order. A path stands for a file, which is a unit anyway."""
    body = F.sort_array(F.collect_list(F.struct("i", line.alias("line"))))
    joined = F.array_join(F.transform(body, lambda x: x["line"]), between)
    return rows.groupBy("path").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("text")).withColumn("title", F.upper("path"))


def _parsed_sql(chapter: str, verse: str, said: str, where: str, extra: str = "") -> str:
    """What verses of the orders become: known books first, each book's rows in order."""
    return (
        f"SELECT 'f' || o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY {_PLACE}, o_orderkey))::BIGINT AS n, {_BOOKS} AS book, {chapter} AS chapter, {verse} AS verse, NULL::VARCHAR AS position_ref, {said} AS text "
        f"FROM orders {extra} WHERE {where}"
    )


@query(
    "WITH k AS (SELECT *, o_custkey % 2 = 0 AS even, o_custkey % 2 = 0 OR o_orderkey % 4 > 0 AS shaped FROM orders), f AS (SELECT o_custkey, avg(shaped::INT) > 0.6 AS keyed FROM k GROUP BY o_custkey), "
    "orders AS (SELECT k.* FROM k JOIN f USING (o_custkey) WHERE keyed AND shaped) " + _parsed_sql("(o_orderkey % 7)::INT", "(o_custkey % 6)::INT", "o_orderpriority", "true")
    + " UNION ALL SELECT 'f' || o_custkey, 1, 'F' || o_custkey, NULL, NULL, '¶ 1', string_agg(CASE WHEN shaped THEN CASE o_orderkey % 5 WHEN 0 THEN 'gen' WHEN 1 THEN 'II Kings' WHEN 2 THEN 'Psalm' WHEN 3 THEN 'Nope' ELSE '1 cor' END || ' ' || o_orderkey % 7 || ':' || o_custkey % 6 || ' ' || o_orderpriority ELSE 'no verse ' || o_orderpriority END, ' ' ORDER BY o_orderkey) "
    "FROM (SELECT k.* FROM k JOIN f USING (o_custkey) WHERE NOT keyed) GROUP BY o_custkey"
)
def parse_plain_text(spark, sf_dir):
    """Verses where enough lines have one, else paragraphs."""
    keyed = F.concat("name", F.lit(" "), "ch", F.lit(":"), "v", F.lit(" "), "said")
    line = F.when(F.col("even") | (F.col("i") % 4 > 0), keyed).otherwise(F.concat(F.lit("no verse "), "said"))
    return texts.plain_text(_file(_orders(spark, sf_dir), line), "path")


@query(
    "WITH k AS (SELECT o_custkey, count(*) FILTER (o_custkey % 2 = 1 AND o_orderkey % 4 = 0) AS skipped, count(*) AS n FROM orders GROUP BY o_custkey) SELECT 'f' || o_custkey AS path, skipped, skipped || ' line(s) didn''t match the verse pattern and were skipped.' AS warning FROM k WHERE skipped > 0 AND n - skipped > 0.6 * n"
)
def import_warnings(spark, sf_dir):
    keyed = F.concat("name", F.lit(" "), "ch", F.lit(":"), "v", F.lit(" "), "said")
    line = F.when(F.col("even") | (F.col("i") % 4 > 0), keyed).otherwise(F.concat(F.lit("no verse "), "said"))
    return texts.warnings(_file(_orders(spark, sf_dir), line), "path")


@query(
    "WITH k AS (SELECT o_custkey, count(*) FILTER (o_custkey % 2 = 1 AND o_orderkey % 4 = 0) AS skipped, count(*) AS n FROM orders GROUP BY o_custkey), f AS (SELECT *, n - skipped > 0.6 * n AS keyed FROM k) "
    "SELECT sum(CASE WHEN keyed THEN n - skipped ELSE 1 END)::BIGINT AS entries, count(*) AS files, sum(CASE WHEN keyed THEN skipped ELSE 0 END)::BIGINT AS skipped, count(*) FILTER (keyed AND skipped > 0) AS warned FROM f"
)
def load_report(spark, sf_dir):
    """What a load counts in the pass that writes the entries."""
    keyed = F.concat("name", F.lit(" "), "ch", F.lit(":"), "v", F.lit(" "), "said")
    line = F.when(F.col("even") | (F.col("i") % 4 > 0), keyed).otherwise(F.concat(F.lit("no verse "), "said"))
    entries = texts.plain_text(_file(_orders(spark, sf_dir), line), "path", report=True)
    counts = tables.save_counted(entries, tables.scratch(spark), entries=F.count("*"), files=F.count_if(F.col("n") == 1), skipped=F.sum("skipped"), warned=F.count_if(F.col("skipped") > 0))
    return spark.createDataFrame([tuple(counts[c] for c in ("entries", "files", "skipped", "warned"))], "entries long, files long, skipped long, warned long")


@query(
    "SELECT 'f' || o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS n, 'F' || o_custkey AS book, NULL::INT AS chapter, NULL::INT AS verse, "
    "'Chapter ' || o_orderkey || CASE WHEN o_custkey % 6 > 0 THEN ' — ' || o_orderpriority ELSE '' END AS position_ref, 'one' || chr(10) || chr(10) || 'two' AS text FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1) "
    "UNION ALL SELECT 'f' || o_custkey, unnest([1, 2])::BIGINT, 'F' || o_custkey, NULL, NULL, unnest(['¶ 1', '¶ 2']), unnest(['CHAPTER ' || any_value(o_orderkey) || CASE WHEN o_custkey % 6 > 0 THEN ': ' || any_value(o_orderpriority) ELSE '.' END || ' one', 'two']) FROM orders GROUP BY o_custkey HAVING count(*) = 1"
)
def parse_marked_sections(spark, sf_dir):
    mark = F.concat(F.lit("  CHAPTER "), F.col("i").cast("string"), F.when(F.col("v") != "0", F.concat(F.lit(": "), "said", F.lit("  "))).otherwise("."))
    docs = _file(_orders(spark, sf_dir), F.concat(mark, F.lit("\n  one \n\n\n\ntwo\n")))
    return texts.plain_text(docs, "path")


@query(_parsed_sql("nullif((o_orderkey % 7)::INT, 0)", "nullif((o_custkey % 6)::INT, 0)", "'a \"q\", ' || o_orderpriority", "o_orderkey % 11 > 0"))
def parse_csv_named(spark, sf_dir):
    said = F.when(F.col("i") % 11 == 0, " ").otherwise(F.concat(F.lit('"a ""q"", '), "said", F.lit('"')))
    return texts.csv_rows(_file(_orders(spark, sf_dir), F.concat_ws(",", "name", "ch", "v", said), " Book ,CH,V,Text\n"), "path")


@query(
    "SELECT 'f' || o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(o_orderkey % 5, 0), 1000), o_orderkey))::BIGINT AS n, ['Genesis', 'Exodus', 'Leviticus', 'Numbers', '0'][CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE o_orderkey % 5 END] AS book, "
    "nullif((o_orderkey % 7)::INT, 0) AS chapter, nullif((o_custkey % 6)::INT, 0) AS verse, NULL::VARCHAR AS position_ref, 'x,' || o_orderpriority AS text FROM orders"
)
def parse_csv_placed(spark, sf_dir):
    line = F.concat_ws(",", (F.col("i") % 5).cast("string"), "ch", "v", F.lit("x"), "said")
    return texts.csv_rows(_file(_orders(spark, sf_dir), line), "path")


@query(
    "SELECT 'f' || o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS n, 'F' || o_custkey AS book, NULL::INT AS chapter, NULL::INT AS verse, 'Row ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position_ref, o_orderpriority || ' — b' || o_orderkey AS text FROM orders"
)
def parse_csv_rows(spark, sf_dir):
    return texts.csv_rows(_file(_orders(spark, sf_dir), F.concat("said", F.lit("\t\"b"), F.col("i").cast("string"), F.lit('"'))), "path", delimiter="\t")


@query(_parsed_sql("nullif((o_orderkey % 7)::INT, 0)", "nullif((o_custkey % 6)::INT, 0)", "o_orderpriority", "true"))
def parse_json_flat(spark, sf_dir):
    row = F.to_json(F.struct(F.col("name").alias("Book_Name"), F.col("ch").cast("int").alias("CH"), F.col("v").alias("verse"), F.concat(F.lit(" "), "said").alias("Content"), F.lit("x").alias("data")))
    return texts.json_flat(_file(_orders(spark, sf_dir), row, '{"books": [', ",", "]}"), "path")


_CHAPTERS = "c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)"


@query(
    f"WITH {_CHAPTERS}, v AS (SELECT *, unnest([1, 2]) AS verse FROM c) SELECT 'f' || o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY pos, verse))::BIGINT AS n, CASE o_orderkey % 3 WHEN 0 THEN 'Genesis' WHEN 1 THEN 'ab' ELSE 'Book ' || pos END AS book, 1 AS chapter, verse, NULL::VARCHAR AS position_ref, "
    "CASE verse WHEN 1 THEN 'x' || o_orderkey ELSE 'y' END AS text FROM v"
)
def parse_json_nested(spark, sf_dir):
    chapters = F.array(F.array(F.concat(F.lit("x"), F.col("i").cast("string")), F.lit("y")))
    third = F.col("i") % 3
    row = F.to_json(F.struct(F.when(third == 0, "gen").alias("name"), F.when(third == 1, "ab").alias("abbrev"), chapters.alias("chapters")))
    return texts.json_nested(_file(_orders(spark, sf_dir), row, "[", ",", "]"), "path")


@query(
    f"WITH {_CHAPTERS} SELECT 'f' || o_custkey AS path, pos::BIGINT AS n, 'Genesis' AS book, (o_orderkey % 9)::INT AS chapter, 4 AS verse, NULL::VARCHAR AS position_ref, 'x' || o_orderkey AS text FROM c"
)
def parse_json_numbered(spark, sf_dir):
    row = F.concat(F.lit('{"name": "gen", "chapters": [{"chapter": '), (F.col("i") % 9).cast("string"), F.lit(', "verses": [{"verse": 4, "text": " x'), F.col("i").cast("string"), F.lit('"}, {"verse": 5, "text": " "}]}]}'))
    return texts.json_numbered(_file(_orders(spark, sf_dir), row, '{"books": [', ",", "]}"), "path")


@query(
    _parsed_sql("nullif((o_orderkey % 7)::INT, 0)", "nullif((o_custkey % 6)::INT, 0)", "'a & ' || o_orderpriority", "o_custkey % 4 > 0")
    + " UNION ALL SELECT 'f' || o_custkey, 1, 'F' || o_custkey, NULL, NULL, '¶ 1', string_agg('a ' || o_orderpriority, ' ' ORDER BY o_orderkey) || ' <' FROM orders WHERE o_custkey % 4 = 0 GROUP BY o_custkey"
)
def parse_xml(spark, sf_dir):
    """Every fourth file does not parse: it is read without its tags."""
    book = F.when(F.col("name") == "gen", 'osisID="Gen').when(F.col("name") == "II Kings", 'osisID="2Kgs').when(F.col("name") == "Psalm", 'osisID="Ps').when(F.col("name") == "1 cor", 'osisID="1Cor')
    osis = F.concat(F.lit("<verse "), book, F.lit("."), "ch", F.lit("."), "v", F.lit('"> a <b>&amp;</b> '), "said", F.lit("</verse>"))
    around = F.concat(F.lit('<book name="Nope"><c number="'), "ch", F.lit('"><v number="'), "v", F.lit('">a &amp; '), "said", F.lit("</v></c></book>"))
    broken = F.col("path").substr(2, 9).cast("int") % 4 == 0
    docs = _file(_orders(spark, sf_dir), F.when(broken, F.concat(F.lit("<p>a "), "said", F.lit("</p>"))).when(F.col("name") == "Nope", around).otherwise(osis), "<t>", "", "</t>")
    return texts.xml_entries(docs.withColumn("text", F.when(F.col("path").substr(2, 9).cast("int") % 4 == 0, F.concat("text", F.lit(" <"))).otherwise(F.col("text"))))


@query(
    "WITH k AS (SELECT o_custkey, min(o_orderkey) AS i FROM orders GROUP BY o_custkey) SELECT 'f' || o_custkey AS path, CASE WHEN o_custkey % 3 = 0 THEN 'sqlite' WHEN o_custkey % 3 = 1 THEN 'json' ELSE 'markdown' END AS kind, 1::BIGINT AS n, 'F' || o_custkey AS book, NULL::INT AS chapter, NULL::INT AS verse, "
    "CASE WHEN o_custkey % 3 = 2 THEN 'T' END AS position_ref, CASE o_custkey % 3 WHEN 0 THEN '(empty file)' WHEN 1 THEN '{\"a\": ' || i ELSE 'x' || i END AS text FROM k"
)
def parse_dispatched(spark, sf_dir):
    """Files of several kinds through one parser; those that no parser makes anything of are entries as they are."""
    rows = _orders(spark, sf_dir).groupBy("path").agg(F.min("i").alias("i")).withColumn("third", F.col("path").substr(2, 9).cast("int") % 3)
    body = F.when(F.col("third") == 1, F.concat(F.lit('{"a": '), F.col("i").cast("string"))).when(F.col("third") == 2, F.concat(F.lit("# T #\nx"), F.col("i").cast("string")))
    kind = F.when(F.col("third") == 0, "sqlite").when(F.col("third") == 1, "json").otherwise("markdown")
    found = rows.select("path", F.upper("path").alias("title"), kind.alias("kind"), F.lit(b"no database").alias("content"), body.alias("text"))
    return texts.parsed(found).join(found.select("path", "kind"), "path")


_KINDS = ("text", "json", "csv", "xml", "markdown", "tsv")
_SIXTH = "o_custkey % 6"


@query(
    _parsed_sql(f"CASE WHEN {_SIXTH} = 0 THEN (o_orderkey % 7)::INT ELSE nullif((o_orderkey % 7)::INT, 0) END", f"CASE WHEN {_SIXTH} = 0 THEN (o_custkey % 6)::INT ELSE nullif((o_custkey % 6)::INT, 0) END", "o_orderpriority", f"{_SIXTH} < 4")
    + f" UNION ALL SELECT 'f' || o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'F' || o_custkey, NULL, NULL, CASE WHEN {_SIXTH} = 4 THEN 'H' || o_orderkey ELSE 'Row ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END, CASE WHEN {_SIXTH} = 4 THEN o_orderpriority ELSE 'r' || o_orderkey || ' — ' || o_orderpriority END FROM orders WHERE {_SIXTH} > 3"
)
def parse_every_kind(spark, sf_dir):
    """Files of six kinds through one parser, a kind for each sixth of the customers."""
    name, ch, v, said = F.col("name"), F.col("ch"), F.col("v"), F.col("said")
    code = F.when(name == "gen", "Gen").when(name == "II Kings", "2Kgs").when(name == "Psalm", "Ps").when(name == "1 cor", "1Cor").otherwise("Nope")
    line = {
        "text": F.concat(name, F.lit(" "), ch, F.lit(":"), v, F.lit(" "), said), "json": F.to_json(F.struct(name.alias("book"), ch.alias("chapter"), v.alias("verse"), said.alias("text"))),
        "csv": F.concat_ws(",", name, ch, v, said), "xml": F.concat(F.lit('<verse osisID="'), code, F.lit("."), ch, F.lit("."), v, F.lit('">'), said, F.lit("</verse>")),
        "markdown": F.concat(F.lit("# H"), F.col("i").cast("string"), F.lit("\n\n"), said), "tsv": F.concat(F.lit("r"), F.col("i").cast("string"), F.lit("\t"), said),
    }
    around = {"text": ("", "\n", ""), "json": ("[", ",", "]"), "csv": ("book,chapter,verse,text\n", "\n", ""), "xml": ("<osis>", "", "</osis>"), "markdown": ("", "\n", ""), "tsv": ("", "\n", "")}
    rows, sixth = _orders(spark, sf_dir), F.col("path").substr(2, 9).cast("int") % 6
    pick = lambda of: F.element_at(F.array(*[of(k) for k in _KINDS]), sixth + 1)
    body = F.transform(F.sort_array(F.collect_list(F.struct("i", pick(line.get).alias("line")))), lambda x: x["line"])
    files = rows.groupBy("path").agg(body.alias("lines")).select("path", F.upper("path").alias("title"), pick(F.lit).alias("kind"), F.lit(None).cast("binary").alias("content"), "lines")
    text_ = F.concat(pick(lambda k: F.lit(around[k][0])), F.array_join("lines", "\u0001"), pick(lambda k: F.lit(around[k][2])))
    return texts.parsed(files.withColumn("text", F.replace(text_, F.lit("\u0001"), pick(lambda k: F.lit(around[k][1])))).drop("lines"))


@query(
    f"WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 4 IN (0, 2)) SELECT 'f' || o_custkey AS path, CASE o_custkey % 4 WHEN 0 THEN '{texts.NO_JSON}' ELSE '{texts.FAILED}' END AS warning FROM k"
)
def import_unparsed(spark, sf_dir):
    """Files that are no JSON, JSON of no known shape, markup that breaks off, and good ones: what an import says of each."""
    fourth = F.col("path").substr(2, 9).cast("int") % 4
    body = F.when(fourth == 0, "{x").when(fourth == 1, F.concat(F.lit('{"a": '), F.col("n").cast("string"), F.lit("}"))).when(fourth == 2, "<t>").otherwise('[{"book": "gen", "chapter": 1, "verse": 2, "text": "t"}]')
    rows = _orders(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"))
    found = rows.select("path", F.upper("path").alias("title"), F.when(fourth == 2, "xml").otherwise("json").alias("kind"), F.lit(None).cast("binary").alias("content"), body.alias("text"))
    return texts.unparsed(found, texts.parsed(found))


@query(
    "SELECT 'f' || o_custkey AS name, sum(c)::BIGINT AS n, count(*) AS books, min(least_order)::BIGINT AS first FROM (SELECT o_custkey, " + _BOOKS + " AS book, count(*) AS c, 0 AS least_order FROM orders GROUP BY ALL) GROUP BY o_custkey"
)
def stored_sources(spark, sf_dir):
    """Parsed entries as the tables of books and entries, counted again."""
    docs = _file(_orders(spark, sf_dir), F.concat("name", F.lit(" "), "ch", F.lit(":"), "v", F.lit(" "), "said"))
    books, entries = tables.stored(texts.keyed_lines(docs, "path"), "path")
    rows = entries.join(books.select(F.col("id").alias("book_id"), "source"), "book_id")
    return rows.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("books"), F.min("sort_order").cast("long").alias("first"))


@query(
    r"SELECT doc_id, regexp_extract('/a/b.c/' || source || '.Tar.GZ', '([^/]+)$', 1) AS name, 'gz' AS extension FROM documents"
)
def file_names(spark, sf_dir):
    path = F.concat(F.lit("/a/b.c/"), "source", F.lit(".Tar.GZ"))
    return table(spark, sf_dir, "documents").select("doc_id", text.base_name(path).alias("name"), text.extension(path).alias("extension"))


@query("SELECT event_id, 'caf' || chr(233) || event_type AS text FROM events")
def bytes_decoded(spark, sf_dir):
    """UTF-8 with and without its mark, and Windows-1252."""
    utf8 = F.encode(F.concat(F.lit("café"), "event_type"), "UTF-8")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, utf8).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.concat(F.unhex(F.lit("636166E9")), F.encode("event_type", "UTF-8")))
    return table(spark, sf_dir, "events").select("event_id", text.decoded(raw).alias("text"))


@query("SELECT o_orderkey AS id, upper(CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE 'H' END) || o_orderkey AS number, 'le' AS lemma, CASE WHEN o_custkey % 2 = 0 THEN 'xl' ELSE 'tr' END AS transliteration, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS full_def FROM orders")
def parse_lexicon(spark, sf_dir):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    number = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("h")).otherwise(F.lit("")), k)
    entry = F.to_json(F.struct(F.lit("le").alias("lemma"), F.when(c % 2 == 0, "xl").alias("xlit"), F.lit("tr").alias("translit"), F.when(c % 3 > 0, F.concat(F.lit(" "), "o_orderpriority")).alias("strongs_def")))
    files = table(spark, sf_dir, "orders").select(k.alias("path"), F.concat(F.lit("var lexicon = {\""), number, F.lit("\": "), entry, F.lit("};\nmodule.exports = lexicon;")).alias("text"))
    return texts.lexicon(files, "H").select(F.col("path").cast("long").alias("id"), "number", "lemma", "transliteration", "full_def")
