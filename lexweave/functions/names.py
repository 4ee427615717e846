"""Names of books: the canon, and how a name as written becomes one of it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import collapsed

# The 66 books in order, and their short names in OSIS files.
CANON = (
    "Genesis|Exodus|Leviticus|Numbers|Deuteronomy|Joshua|Judges|Ruth|1 Samuel|2 Samuel|1 Kings|2 Kings|1 Chronicles|2 Chronicles|Ezra|"
    "Nehemiah|Esther|Job|Psalms|Proverbs|Ecclesiastes|Song of Solomon|Isaiah|Jeremiah|Lamentations|Ezekiel|Daniel|Hosea|Joel|Amos|Obadiah|"
    "Jonah|Micah|Nahum|Habakkuk|Zephaniah|Haggai|Zechariah|Malachi|Matthew|Mark|Luke|John|Acts|Romans|1 Corinthians|2 Corinthians|Galatians|"
    "Ephesians|Philippians|Colossians|1 Thessalonians|2 Thessalonians|1 Timothy|2 Timothy|Titus|Philemon|Hebrews|James|1 Peter|2 Peter|"
    "1 John|2 John|3 John|Jude|Revelation"
).split("|")
OSIS = (
    "Gen Exod Lev Num Deut Josh Judg Ruth 1Sam 2Sam 1Kgs 2Kgs 1Chr 2Chr Ezra Neh Esth Job Ps Prov Eccl Song Isa Jer Lam Ezek Dan Hos Joel Amos "
    "Obad Jonah Mic Nah Hab Zeph Hag Zech Mal Matt Mark Luke John Acts Rom 1Cor 2Cor Gal Eph Phil Col 1Thess 2Thess 1Tim 2Tim Titus Phlm Heb Jas "
    "1Pet 2Pet 1John 2John 3John Jude Rev"
).split()
# Other names in use.
ALIASES = {
    "song of songs": "Song of Solomon",
    "canticles": "Song of Solomon",
    "psalm": "Psalms",
    "revelations": "Revelation",
    "revelation of john": "Revelation",
    "revelation of st. john": "Revelation",
    "acts of the apostles": "Acts",
}
#: Ordinals at the start of a name and the digit for each.
ORDINALS = {"i": "1", "ii": "2", "iii": "3", "1st": "1", "2nd": "2", "3rd": "3"}


def plain_name(raw: Column) -> Column:
    name = collapsed(F.lower(raw))
    for old, new in ORDINALS.items():
        name = F.regexp_replace(name, rf"^{old} ", f"{new} ")
    return name


@functools.cache
def _meant() -> dict[str, int]:
    """The number of the book that each plain name means: an alias, the exact name, or the start of one book alone."""
    low = [b.lower() for b in CANON]
    starts = {b[:n] for b in low for n in range(1, len(b) + 1)}
    one = {s: [i for i, b in enumerate(low, 1) if b.startswith(s)] for s in starts}
    out = {s: low.index(s) + 1 if s in low else of[0] for s, of in one.items() if s in low or len(of) == 1}
    return out | {alias: CANON.index(b) + 1 for alias, b in ALIASES.items()}


def meanings(spark: SparkSession) -> DataFrame:
    """Plain names with the number and the name of the book that they mean: some hundred rows, whatever the input."""
    return spark.createDataFrame([(s, n, CANON[n - 1]) for s, n in _meant().items()], "_plain string, _number int, _known string")


def canonical_names(rows: DataFrame, raw: str) -> DataFrame:
    """Distinct values of ``raw`` with ``book``, the book of the canon that is meant, else null."""
    plain = rows.select(raw).distinct().withColumn("_plain", plain_name(F.col(raw)))
    return plain.join(F.broadcast(meanings(rows.sparkSession)), "_plain", "left").select(raw, F.col("_known").alias("book"))  # a bounded table


def book_of_number(n: Column) -> Column:
    return F.when(n.between(1, len(CANON)), F.element_at(F.array(*[F.lit(b) for b in CANON]), F.when(n.between(1, len(CANON)), n).otherwise(1)))


def canonicalized(rows: DataFrame) -> DataFrame:
    """``rows`` (book, ...) with known names of books in place of those as written, and ``canon_place``: the book's number, 1000 for
    names that stay as they are. One look-up in a broadcast table of bounded size: rows are neither read twice nor shuffled."""
    found = rows.withColumn("_plain", plain_name(F.col("book"))).join(F.broadcast(meanings(rows.sparkSession)), "_plain", "left")
    return found.select(*[c for c in rows.columns if c != "book"], F.coalesce("_known", "book").alias("book"), F.coalesce("_number", F.lit(1000)).alias("canon_place"))
