"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in Spark expression over the row's own text, so the operator has no shuffle and no user
function; it scales with the number of input splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was on be by are this from or at an not have which but "
    "le la les de des du et est un une que qui dans pour par sur au avec pas plus ne ce il elle "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los las y en del se por con para una su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a null bound is open. An empty denominator passes."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The threshold table. Measures are columns of :func:`measured`.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.005, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more."""
    grams = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        again = lambda rows: F.filter(
            rows,
            lambda x, i: F.coalesce(F.get(rows, i - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(rows, i + 1)["g"] == x["g"], F.lit(False)),
        )
        starts = _let(placed, lambda rows: F.sort_array(F.transform(again(rows), lambda x: x["i"])))
        return _let(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures that rules may name. Null text counts as empty: every measure is 0.

    The measures come out of one generated row: a filter on them stays above it. Through a projection Catalyst would push
    the filter down and put the splitting of the text in every place that names a measure, once for each word.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    words, lines = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("words", "lines"))  # names that docs hasn't
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(F.col(words)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
    }
    row = F.struct(*[v.cast("long").alias(k) for k, v in measures.items()])
    return docs.select("*", words_of(F.col(text)).alias(words), split.alias(lines)).select(
        *[c for c in docs.columns if c.lower() not in measures], F.inline(F.array(row))
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row breaks, as an array."""

    def broken(r: Rule) -> Column:
        below = F.lit(1.0) if r.denominator is None else F.col(r.denominator).cast("double")
        value = F.when(below > 0, F.col(r.numerator) / F.when(below > 0, below))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name))

    return F.filter(F.array(*[broken(r) for r in rules]), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, ``base_failed``, ``broken_rules`` and ``kept`` to every row.

    Null or empty text: all measures 0, ``base_failed`` true. Rows are judged one by one, so ties and repeated rows
    each get their own verdict, and so do texts of any length; columns of ``docs`` with the names of the results, in whatever case, are
    replaced. An empty table gives an empty table.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        measured(docs, text)
        .withColumns({"base_failed": base_failed, "broken_rules": compiled(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, of its doc_id and text alone: null text counts as empty and fails the base rules."""
    return quality_rules(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


#: The same rows in DuckDB's SQL.
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines
  FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_stop_list()})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words AND n_symbols <= 0.25 * n_words
         AND n_stop_words / n_words >= 0.005
         AND (n_lines = 0 OR n_dup_lines <= 0.5 * n_lines) AS kept
FROM m
"""
