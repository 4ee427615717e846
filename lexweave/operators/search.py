"""Full-text search: every term of a query must occur, a term with punctuation as a phrase."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import ascii_lower, folded_text, snippet, tokens
from lexweave.sources.tables import n_parts

#: Places of a query's tokens that one task puts together, about.
PLACES = 250_000


def query_phrases(query: str) -> list[list[str]]:
    """The tokens of each term between white space; terms without any are left out. Folded as texts are."""
    return [p for term in folded_text(query).split() if (p := re.findall(r"[^\W_]+", term))]


def _holds(part: str):
    return lambda field: F.contains(field, F.lit(part))


def matches(query: str, *fields: Column) -> Column:
    """Whether each phrase is in any of the fields. A query without a token matches nothing."""
    padded = [F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(f, F.lit(""))), " "), F.lit(" ")) for f in fields]
    wanted = [f" {' '.join(p)} " for p in query_phrases(query)]
    if not wanted:
        return F.lit(False)

    def all_in(fields_: Column) -> Column:
        out = F.lit(True)
        for w in wanted:
            out = out & F.exists(fields_, _holds(w))
        return out

    # One array of one array, so that the texts are split once however many terms there are.
    return F.exists(F.array(F.array(*padded)), all_in)


def contains(query: str, field: Column) -> Column:
    """The query as one substring; ASCII letters in either case, ``%`` and ``_`` as wildcards."""
    return ascii_lower(field).like("%" + re.sub(r"[A-Z]", lambda m: m[0].lower(), query).replace("\\", "\\\\") + "%")


def word_start(term: str, field: Column) -> Column:
    """The term at the field's start or after a space."""
    plain = re.sub(r"[A-Z]", lambda m: m[0].lower(), term).replace("\\", "\\\\")
    return ascii_lower(field).like(f"{plain}%") | ascii_lower(field).like(f"% {plain}%")


def capped(hits: DataFrame, group: list[str], order: list[str], cap: int = 200) -> DataFrame:
    """The first rows of each group. Spark keeps no more than ``cap`` rows of a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return hits.withColumn("rn", rank.cast("long")).where(F.col("rn") <= cap)


def search(entries: DataFrame, query: str, text: str, group: list[str], order: list[str], mode: str = "tokens", cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(hits, totals): capped hits with snippets, and how many there are in all per group."""
    found = entries.where(matches(query, F.col(text)) if mode == "tokens" else contains(query, F.col(text)))
    shown = snippet(F.col(text), query_phrases(query)) if mode == "tokens" else F.col(text)
    hits = capped(found, group, order, cap).withColumn("snippet", shown)
    return hits, found.groupBy(*group).agg(F.count("*").alias("total"))


def by_tokens(tokens: DataFrame, query: str) -> DataFrame:
    """entry_id of the entries with every phrase of the query, out of a token table (entry_id, place, token). Only the query's tokens are read; a
    phrase is found where its tokens' places less their numbers in it agree. Places are dealt by entry into as many partitions as there are of them."""
    phrases = query_phrases(query)
    if not phrases:
        return tokens.select("entry_id").limit(0)
    wanted = sorted({t for p in phrases for t in p})
    parts = [F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(len(p)).alias("size"), F.lit(t).alias("t")) for k, p in enumerate(phrases) for i, t in enumerate(p)]
    held = tokens.where(F.col("token").isin(wanted))
    rows = held.select("entry_id", "place", F.explode(F.filter(F.array(*parts), lambda x: x["t"] == F.col("token"))).alias("x"))
    rows = rows.select("entry_id", "x.k", "x.size", (F.col("place") - F.col("x.i")).alias("start"), "x.i")
    n = n_parts(tokens.sparkSession, held.count(), PLACES)
    rows = rows.repartition(n, "entry_id") if n else rows
    whole = rows.groupBy("entry_id", "k", "size", "start").agg(F.countDistinct("i").alias("n")).where("n = size")
    return whole.groupBy("entry_id").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(phrases)).select("entry_id")


def recent(rows: DataFrame, newest: str, key: str, n: int = 100) -> DataFrame:
    return rows.orderBy(F.desc(newest), key).limit(n)


# Fixed value: the title under which hits in notes are listed.
NOTES = "My Notes"


def notes(rows: DataFrame, query: str, mode: str = "tokens", n: int = 100) -> DataFrame:
    """The latest notes with every term in title or content, each term in either; the snippet is the content's, without marks if only the title matches."""
    title, content = F.col("title"), F.col("content")
    found = rows.where(matches(query, title, content) if mode == "tokens" else F.coalesce(contains(query, content), F.lit(False)) | F.coalesce(contains(query, title), F.lit(False)))
    return recent(found, "updated_at", "id", n).select(
        F.lit("note").alias("kind"), "id", F.lit(None).cast("long").alias("source_id"), F.lit(NOTES).alias("source_title"), F.col("anchor_book").alias("book"), F.col("anchor_chapter").cast("int").alias("chapter"),
        F.col("anchor_verse").cast("int").alias("verse"), F.lit(None).cast("string").alias("position_ref"), (snippet(content, query_phrases(query)) if mode == "tokens" else content).alias("snippet"), "updated_at",
    )


def everything(note_rows: DataFrame, entries: DataFrame, query: str, mode: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(hits, totals): notes first, latest first (part 0), then entries by source and place (part 1)."""
    hits, totals = search(entries, query, "text", ["source_id"], ["book_order", "sort_order"], mode)
    columns = ["id", "source_id", "source_title", "book", "chapter", "verse", "snippet"]
    of_entries = hits.select(F.lit("entry").alias("kind"), *columns, F.col("rn"), F.lit(1).alias("part"))
    of_notes = notes(note_rows, query, mode).select("kind", *columns, F.lit(None).cast("long").alias("rn"), F.lit(0).alias("part"))
    return of_notes.unionByName(of_entries), totals


def history(searches: DataFrame, term: str, at: str, key: str, n: int = 20) -> DataFrame:
    """The latest distinct terms, whatever their case, in their latest spelling."""
    when = F.struct(at, key)
    rows = searches.where(F.trim(term) != "").groupBy(F.lower(F.trim(term)).alias("low"))
    return rows.agg(F.max_by(term, when).alias("term"), F.max(when).alias("w")).orderBy(F.desc("w")).limit(n).select("term", F.col("w")[at].alias("at"))
