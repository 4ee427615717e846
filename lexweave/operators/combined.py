"""Many queries over many entries at once: hits, totals and concordance counts out of one scan.

An entry gives the keys under which a query could find it: its tokens, the first characters of its tagged words, and their numbers. A query is looked for
under one key of each kind: its longest token, the start of its term, or its number. What meets under a key is then matched in full. Tokens meet queries where
texts are read; equal words of a source are counted first, and only unlike ones are looked for. All that is found goes through one aggregation. Queries that look for the same are looked for once. Hits are gathered by pages, fixed ranges of places, so that what a source holds of a query is never one row and
a source's first hits are found by counting pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import ascii_lower, number_query, tokens, trimmed
from lexweave.sources.tables import staged

#: Places of a page; characters of a word by which a term is looked for.
PAGE, PREFIX = 1 << 10, 3


def _padded(tokens_: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))


def asked(queries: DataFrame) -> DataFrame:
    """A row for each of the keys under which a query (query_id, query) looks for entries, with its phrases, term and number, and with ``ask``: what it
    looks for under the key, the same for queries that look for the same. Queries without a token have no key for texts, blank ones none at all."""
    query = trimmed(F.coalesce("query", F.lit("")))
    rows = queries.select("query_id", query.alias("q"), tokens(query).alias("all"), number_query(query).alias("number"))
    phrases = F.filter(F.transform(F.split("q", r"(?U)\s+"), lambda t: _padded(tokens(t))), lambda p: trimmed(p) != "")
    longest = F.array_max(F.transform("all", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    start = F.regexp_extract(ascii_lower(F.col("q")), rf"^[^ %_\\]{{0,{PREFIX}}}", 0)
    keys = F.array(
        F.when(F.size("all") > 0, F.concat(F.lit("t"), longest)),
        F.when(F.col("q") != "", F.when(F.col("number").isNotNull(), F.concat(F.lit("n"), "number")).otherwise(F.concat(F.lit("p"), start))),
    )
    term = ascii_lower(F.col("q"))
    pattern = F.when(F.col("q").rlike(r"[%_]"), F.replace(term, F.lit("\\"), F.lit("\\\\")))
    rows = rows.select("query_id", F.array_sort(phrases).alias("phrases"), F.when(F.col("number").isNull(), term).alias("term"), pattern.alias("pattern"), "number", F.explode(F.array_compact(keys)).alias("key"))
    in_text = F.col("key").startswith("t")
    ask = F.when(in_text, F.concat(F.lit("t"), F.array_join("phrases", ""))).otherwise(F.concat(F.lit("w"), F.coalesce("number", "term")))
    only = lambda c, there: F.when(there, F.col(c)).alias(c)
    return rows.select("query_id", ask.alias("ask"), "key", only("phrases", in_text), only("term", ~in_text), only("pattern", ~in_text), only("number", ~in_text))


def _starts(low: Column) -> Column:
    """The keys of a word's starts, at its own and after each space."""
    of = lambda x: F.array(*[F.concat(F.lit("p"), F.substring(x, 1, n)) for n in range(PREFIX + 1)])
    return F.when(F.contains(low, F.lit(" ")), F.flatten(F.transform(F.split(low, " "), of))).otherwise(of(low))


def combined(entries: DataFrame, queries: DataFrame, cap: int = 200) -> DataFrame:
    """query_id, part, source, item, n for ``queries`` (query_id, query) over ``entries`` (id, source, place, text, words: array of struct<word_index,
    surface_text, numbers>).

    Part ``hit``: the first ``cap`` entries of each source with every phrase of the query, by place; item is the id, n the rank. ``total``: how
    many there are. ``number``: the numbers of words with the query's term at a word's start, or its own number, and how often in each source.
    ``slots``: how many words these are in all. In terms ASCII letters match in either case and ``%`` and ``_`` are wildcards. Null texts and
    words hold nothing; places are whole numbers, ties are ranked by id.
    """
    words_type = entries.schema["words"].dataType
    words = F.coalesce("words", F.array().cast(words_type))
    e = entries.select("id", "source", F.col("place").cast("long").alias("place"), words.alias("words"), tokens(F.coalesce("text", F.lit(""))).alias("found"), F.monotonically_increasing_id().alias("row"))
    e = e.withColumn("unlike", F.array_distinct("found"))
    # Tokens, then words, by their places alone, and without a lambda up to the first aggregation: so all this is one generated loop, in which lists are referred to. A
    # text or list beside each token would be copied for each, the square of a text. Outer, as below an inner one Spark would work out the lists once more.
    each = e.select("*", F.posexplode_outer(F.concat("unlike", "words.surface_text")).alias("nth", "x")).where("nth IS NOT NULL")
    n_unlike = F.size("unlike")
    is_word = F.col("nth") >= n_unlike
    each = each.select("id", "source", "place", "row", "found", F.when(~is_word, F.col("x")).alias("token"), ascii_lower(F.when(is_word, F.col("x"))).alias("low"), F.when(is_word, F.get("words", F.col("nth") - n_unlike)["numbers"]).alias("numbers"))
    wanted = asked(queries)
    asks = wanted.drop("query_id").distinct()
    in_text = F.col("key").startswith("t")
    # A row for each phrase. A table of its own, so that Spark knows how small it is and sends it to the texts.
    phrases = F.array_distinct("phrases")
    in_texts = staged(asks.where(in_text).select(F.substring("key", 2, 1 << 30).alias("key"), "ask", F.size(phrases).cast("long").alias("size"), F.explode(phrases).alias("phrase")))
    # What no query can be under has a key of its own all the same, so that rows that only pass a join are not one task's.
    unmet = lambda c: F.concat(F.lit("\u0001"), c.cast("string"))
    met = each.withColumn("key", F.coalesce("token", unmet(F.col("low")))).join(in_texts, "key", "left")
    is_hit = F.col("ask").isNotNull()
    held = F.when(is_hit, F.contains(_padded(F.col("found")), F.col("phrase"))).otherwise(F.col("token").isNull())
    found = met.where(held).groupBy("ask", "size", "source", *[F.when(is_hit, F.col(c)).alias(c) for c in ("id", "place", "row")], "low", "numbers").agg(F.count("*").alias("n"))
    at = F.when(is_hit, F.struct("place", "id")).alias("at")
    found = found.where(~is_hit | (F.col("n") == F.col("size"))).select("ask", "source", at, "low", "numbers", F.when(is_hit, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))

    of_word = F.array_distinct(F.concat(_starts(F.col("low")), F.transform("numbers", lambda x: F.concat(F.lit("n"), x))))
    found = found.select("*", F.explode_outer(F.when(~is_hit, of_word)).alias("of_word")).withColumn("key", F.coalesce("of_word", unmet(F.col("at.id")), unmet(F.col("low")))).drop("of_word")
    in_words = asks.where(~in_text).select("key", F.col("ask").alias("word_ask"), "term", "pattern", "number")
    met = found.join(in_words, "key", "left").where(is_hit | F.col("word_ask").isNotNull())
    # A pattern that is not the same for all rows is compiled for each: only terms with wildcards are matched as patterns.
    wild = F.like("low", F.concat("pattern", F.lit("%"))) | F.like("low", F.concat(F.lit("% "), "pattern", F.lit("%")))
    plain = F.startswith("low", "term") | F.contains("low", F.concat(F.lit(" "), "term"))
    tagged = F.col("number").isNotNull() | F.when(F.col("pattern").isNotNull(), wild).otherwise(plain)  # a number's key is the number
    none = F.lit(None).cast("string")
    fact = lambda part, source, item: F.struct(F.lit(part).alias("part"), source.alias("source"), item.alias("item"))
    numbers = F.filter("numbers", lambda x: F.coalesce(x == F.col("number"), F.lit(True)))
    facts = F.when(is_hit, F.array(fact("hit", F.col("source"), none))).when(tagged, F.concat(F.array(fact("slots", none, none)), F.transform(numbers, lambda x: fact("number", F.col("source"), x))))
    rows = met.select(F.coalesce("ask", "word_ask").alias("ask"), "at", "n", F.explode_outer(facts).alias("f")).select("ask", "at", "n", "f.*").where("part IS NOT NULL")

    is_hit = F.col("part") == "hit"
    page = F.when(is_hit, F.floor(F.col("at.place") / PAGE))
    # First all is counted by plain keys; lists, which Spark gathers by sorting, are then made of what that leaves.
    counted = rows.groupBy("ask", "part", "source", "item", page.alias("page"), F.when(is_hit, F.col("at")).alias("at")).agg(F.sum("n").alias("n"))
    pages = counted.groupBy("ask", "part", "source", "item", "page").agg(F.sum("n").alias("n"), F.collect_list("at").alias("at"))
    group = Window.partitionBy("ask", "part", "source", "item")
    former = F.coalesce(F.sum("n").over(group.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lambda part, item, n: F.struct(F.lit(part).alias("part") if isinstance(part, str) else part.alias("part"), item.alias("item"), n.cast("long").alias("n"))
    hits = F.transform(F.slice(F.array_sort("at"), F.lit(1), F.greatest(F.lit(cap) - F.col("former"), F.lit(0)).cast("int")), lambda x, i: out("hit", x["id"].cast("string"), F.col("former") + i + 1))
    total = F.when(F.col("former") == 0, F.array(out("total", none, F.col("total")))).otherwise(F.slice(F.array(out("total", none, F.lit(0))), 1, 0))
    answer = F.when(is_hit, F.concat(hits, total)).otherwise(F.array(out(F.col("part"), F.col("item"), F.col("n"))))
    placed = pages.withColumns({"former": former, "total": F.sum("n").over(group)})
    answers = placed.select("ask", "source", F.explode(answer).alias("a"))
    return answers.join(wanted.select("ask", "query_id"), "ask").select("query_id", "a.part", "source", "a.item", "a.n")
