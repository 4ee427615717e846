"""Source divergence audit: how the words of a source depart from its language as a whole, and sources from each other.

Plain relational: matches are exploded and counted by language, source and term; the terms kept of a language are crossed with its sources, so that
a term that a source lacks counts zero there; the dense counts are joined with themselves on language and term, summed and ranked. The cross
of terms and sources is dealt by cells of (language, hash of the term), so that a language with most of the text isn't one task's.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that a kept term is in, at least; what shares are counted in; ranks of the part ``term``.
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Into how many cells a language's terms, or its sources, are dealt where they are crossed.
CELLS = 32


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + n_terms)), exact whatever the counts."""
    return 1 + _div(F.lit(Decimal(SCALE)) * (n + 1).cast("decimal(20,0)"), (total + n_terms).cast("decimal(20,0)"))


def departure(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term). The terms of a text are put in order, so that the first of equal ones
    counts the document, and no row for each term and document is shuffled. The text is split between terms, which takes time in proportion to
    its length; extracting each match takes the square of it. (An outer explode, as Spark would split once more to filter rows below an inner one.)"""
    terms = F.sort_array(F.split(lowered(F.col("text")), BETWEEN))
    each = docs.select("lang", "source", terms.alias("terms")).select("lang", "source", "terms", F.posexplode_outer("terms").alias("i", "term"))
    first = F.coalesce(F.get("terms", F.col("i") - 1) != F.col("term"), F.lit(True))
    return each.where("term <> ''").groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(first).alias("docs"))


def _cells() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))


def _cell(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(CELLS)).cast("int")


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language, by how far its shares of the kept terms are from this source's. Part ``term``: the kept
    terms that the source has more of than its language, the first ``TOP``. Null text, lang and source count as empty strings, so null and
    empty sources are one. Rows that repeat count each as a document. A source without terms, and a language that keeps none, have pairs (of
    value 0 in the latter). Ties are ranked by the item's UTF-8 bytes. Other columns are not read; an empty table gives an empty table. A
    text's terms are one array in its task. The result holds all pairs of a language's sources, and all kept terms are compared for each: that is what
    the audit is, and what bounds it in the number of sources.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = written(term_counts(docs))
    found = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    vocabulary = written(found.select(F.monotonically_increasing_id().alias("term_id"), "lang", "term", "n"))
    kept = written(counts.join(vocabulary.select("term_id", "lang", "term"), ["lang", "term"]).select("lang", "source", "term_id", "n"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("lang_total"))
    groups = (
        docs.select("lang", "source").distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(F.monotonically_increasing_id().alias("group_id"), "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms", "lang_total")])
    )
    groups = written(groups)
    parts = _pairs(groups, vocabulary, kept).unionByName(_terms(groups, vocabulary, kept))
    return parts.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def _pairs(groups: DataFrame, vocabulary: DataFrame, kept: DataFrame) -> DataFrame:
    of_group = groups.select("group_id", "lang", "source", "total", "n_terms")
    zeros = (
        vocabulary.select("term_id", "lang", _cell("term").alias("cell"))
        .join(of_group.select("*", _cells().alias("cell")), ["lang", "cell"])
        .select("term_id", "group_id", "total", "n_terms", F.lit(0).cast("long").alias("n"))
    )
    counted = kept.join(of_group, ["lang", "source"]).select("term_id", "group_id", "total", "n_terms", "n")
    # One shuffle, by term: the counts are filled up and joined with themselves where they then lie.
    dense = zeros.union(counted).repartition("term_id").groupBy("term_id", "group_id", "total", "n_terms").agg(F.sum("n").alias("n"))
    one = dense.select("term_id", "group_id", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"))
    other = one.select("term_id", F.col("group_id").alias("other_id"), F.col("p").alias("q"))
    # Each two sources meet once a term, and both sums are taken there.
    p, q = F.col("p"), F.col("q")
    both = one.join(other, "term_id").where("group_id < other_id").groupBy("group_id", "other_id").agg(F.sum(departure(p, q)).alias("there"), F.sum(departure(q, p)).alias("back"))
    way = lambda a, b, value: F.struct(F.col(a).alias("group_id"), F.col(b).alias("other_id"), F.col(value).alias("value"))
    far = both.select(F.explode(F.array(way("group_id", "other_id", "there"), way("other_id", "group_id", "back"))).alias("x")).select("x.*")
    item = groups.select(F.col("group_id").alias("other_id"), F.col("source").alias("item"))
    named = far.join(groups.select("group_id", "lang", "source"), "group_id").join(item, "other_id").select("lang", "source", "item", "value")
    bare = groups.where("n_terms = 0").select("lang", "source")
    alike = (
        bare.withColumn("cell", _cell("source"))
        .join(bare.select("lang", F.col("source").alias("item"), _cells().alias("cell")), ["lang", "cell"])
        .where("source <> item")
        .select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    )
    return _ranked(named.union(alike)).withColumn("part", F.lit("pair"))


def _terms(groups: DataFrame, vocabulary: DataFrame, kept: DataFrame) -> DataFrame:
    langs = groups.groupBy("lang").agg(F.max("lang_total").alias("lang_total"), F.max("n_terms").alias("lang_terms"))
    q = vocabulary.join(langs, "lang").select("term_id", F.col("term").alias("item"), share(F.col("n"), F.col("lang_total"), F.col("lang_terms")).alias("q"))
    p = kept.join(groups, ["lang", "source"]).select("lang", "source", "term_id", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"))
    more = p.join(q, "term_id").where("p > q").select("lang", "source", "item", departure(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more).where(F.col("rank") <= TOP).withColumn("part", F.lit("term"))


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM k),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, v.term, v.q, coalesce(c.n, 0)::HUGEINT AS n
      FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
