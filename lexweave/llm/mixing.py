"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words. Every document of a source is expected ``target / source_size`` times; the expected
copies are summed along the source, one offset is added, and a document is taken once for every integer that its part
of the running sum crosses. Documents are ordered by size within the source, so that the words taken stay within about
one document of the target; of ``OFFSETS`` random offsets the one is added that comes nearest.

Rows of one size stand in the order of a hash of their doc_id. The running sum of equal steps is a rank. Ranks are counted without bringing a
source together: rows are grouped by (source, size), and a size that very many rows of a source have is dealt into chunks, each a range of
hashes, which leaves the order as it is. There are at most ``MOST_CUT`` such sizes with as many chunks each, whatever the input, so that they
are broadcast and no task sorts more than a chunk or a source's sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, written

#: Rows of a source with one size that are one chunk.
CHUNK = 400
#: Sizes that are dealt into chunks, and chunks of a size, at most.
MOST_CUT = 10_000
WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST = 150, 2
#: Random offsets that are tried for a source.
OFFSETS = 16


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of the sources (``source``, ``source_size``): ``SHARE_PERCENT`` % of all sizes by weight, at most ``MOST`` times
    a source's size, what is above dealt again by weight. One row per source; empty in, empty out.

    The level of the last deal has a closed form: with sources ordered by cap / weight, the first source that the level
    of those before it doesn't fill sets the level of all after it.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") - 1) % len(weights) + 1)
    zero = F.lit(0.0)
    return (
        sources.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", MOST * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(every).cast("double") * (SHARE_PERCENT / 100))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", (F.col("all_size") - F.coalesce(F.sum("cap").over(by_ratio), zero)) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), zero)))
        .withColumn("at_level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "nth", "level"))).over(every)["level"])
        .select(*sources.columns, F.least("cap", F.coalesce(F.col("at_level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def offset_of(name: Column, seed: str = "") -> Column:
    """In [0, 1), from a source's name and the seed alone, so that reruns agree."""
    name = F.concat(F.lit(seed), name)
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "", key: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, source_size, target, copies, taken.

    Null text has size 0, a null source is a source of its own, rows of size 0 take nothing. Repeated rows are sampled
    each. No document is taken more than twice. An empty table gives an empty table. ``key``: a column that tells rows apart; it
    comes along and orders rows of one doc_id. Rows of one source, size and doc_id (null too) are counted by one task. Very long texts are only
    counted; other columns are not read, whatever their names.
    """
    keys = [key] if key else []
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    base = written(docs.select("doc_id", *keys, "source", src.alias("src"), n_words_of(F.col("text")).alias("size")))
    sizes = written(base.groupBy("src", "source", "size").agg(F.count("*").alias("c")))
    per_source = targets(sizes.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")), weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = written(per_source.withColumns({"rate": rate, "u": offset_of(F.col("src"), seed)}))

    limit = max(CHUNK, (sizes.agg(F.sum("c")).first()[0] or 0) // MOST_CUT)
    cut = sizes.where(F.col("c") > limit).select("src", "size", F.ceil(F.col("c") / limit).cast("long").alias("n_chunks"))
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    chunk = F.shiftright(F.col("drawn") * F.coalesce("n_chunks", F.lit(1)), 32)
    placed = base.withColumn("drawn", drawn).join(F.broadcast(cut), ["src", "size"], "left").withColumn("chunk", chunk)  # at most MOST_CUT rows

    def former(by: list[str]) -> Column:
        return F.coalesce(F.sum("c").over(Window.partitionBy("src").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    upto = lambda k, u: F.floor(k * F.col("rate") + u)
    tried = sizes.withColumn("before", former(["size"])).join(per_source.drop("source"), "src")
    tried = tried.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).withColumn("u", F.col("u") + F.col("j") / OFFSETS)
    words = F.sum(F.col("size") * (upto(F.col("before") + F.col("c"), F.col("u")) - upto(F.col("before"), F.col("u"))))
    tried = tried.groupBy("src", "j", "u", "target").agg(words.alias("words"))
    offsets = tried.groupBy("src").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "j", "u"))["u"].alias("u"))
    of_source = per_source.select("src", "source_size", "target", "rate").join(offsets, "src")
    counts = placed.groupBy("src", "size", "chunk").agg(F.count("*").alias("c"))
    at = written(counts.withColumn("before", former(["size", "chunk"])).drop("c").join(of_source, "src"))

    within = Window.partitionBy("src", "size", "chunk").orderBy("drawn", "doc_id", *keys)
    k = F.col("nth") + F.col("before")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(at, ["src", "size", "chunk"])
        .withColumn("copies", (upto(k, F.col("u")) - upto(k - 1, F.col("u"))).cast("long"))
        .select("doc_id", *keys, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixing_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, as :func:`mixed`; nulls, ties and repeated rows as there."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s),
v AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2 * source_size::DOUBLE AS cap FROM w),
x AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS all_size, sum(weight) OVER () AS all_weight FROM v),
l AS (SELECT *, (all_size - coalesce(sum(cap) OVER f, 0)) / (all_weight - coalesce(sum(weight) OVER f, 0)) AS level
      FROM x WINDOW f AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT level AS at_level FROM l WHERE level < ratio ORDER BY ratio, nth LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT at_level FROM a) * weight, cap)) AS target FROM l),
z AS (SELECT source, size, count(*) AS c, coalesce(sum(count(*)) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM b GROUP BY source, size),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5(coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u0 FROM t),
y AS (SELECT *, u0 + j / 16.0::DOUBLE AS u FROM q, range(16) r(j)),
e AS (SELECT y.source, j, u, any_value(target) AS target, sum(size * (floor((before + c) * rate + u) - floor(before * rate + u))) AS words
      FROM y JOIN z ON y.source IS NOT DISTINCT FROM z.source GROUP BY y.source, j, u),
o AS (SELECT source, arg_min(u, (abs(words - target), j)) AS u FROM e GROUP BY source),
r AS (SELECT b.*, q.source_size, q.target, q.rate, o.u,
             row_number() OVER (PARTITION BY b.source ORDER BY b.size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT, doc_id) AS n
      FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source JOIN o ON b.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target, ((floor(n * rate + u) - floor((n - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM r
"""
