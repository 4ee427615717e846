"""Preference formatting of pairs of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as the prompt. The turns
after it are rendered as the two completions; of these, only what the assistant says counts for the loss, which the
masks say as spans [start, end) of code points of the completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded

LEARNED_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def _masks(turns: Column, roles: Column) -> Column:
    """Spans of the learned turns: from after the role's line to the end of the turn."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        start, end = a["at"] + F.length(t["role"]) + 5, a["at"] + F.length(rendered(t))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(
            end.alias("at"), F.concat(a["spans"], F.when(t["role"] == LEARNED_ROLE, span).otherwise(none)).alias("spans")
        )

    return F.aggregate(turns, empty, add, lambda a: a["spans"])


def conversations_of(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order: by turn (null first), ties by role and text. Null role or text: empty.

    A conversation is the unit that is rendered, so its turns meet in one row; nothing else is brought together.
    """
    empty = F.lit("")
    return (
        turns.where(F.col("conv_id").isNotNull())
        .select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )


RESULTS = ("n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", "chosen_masks", "rejected_masks")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of struct<turn, role, text>) with prompt, completions and masks added.

    A null side counts as a conversation without turns. Two equal conversations give a prompt and two empty completions. Repeated
    pairs each get a row. Other columns stay, but those with the names of the results, in whatever case, are replaced. Masks are
    put together turn by turn, which takes time by the square of a conversation's turns.
    """
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    rows = shielded(pairs, "pair_id", "chosen", "rejected")
    side = lambda c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind))
    said = lambda t: F.struct(t["role"], t["text"])
    alike = F.transform(
        F.arrays_zip(F.col("chosen").alias("a"), F.col("rejected").alias("b")),
        lambda p: F.coalesce(said(p["a"]) == said(p["b"]), F.lit(False)) & p["a"].isNotNull() & p["b"].isNotNull(),
    )
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    text = lambda turns: F.array_join(F.transform(turns, rendered), "")
    differs = F.array_position(F.concat(alike, F.array(F.lit(False))), F.lit(False))
    back = {n: c for n, c in zip(rows.columns, pairs.columns) if c.lower() not in RESULTS}
    return (
        rows.withColumns({"chosen": side("chosen"), "rejected": side("rejected")})
        .withColumn("n_prompt_turns", (differs - 1).cast("int"))
        .withColumns({"prompt_turns": F.slice("chosen", F.lit(1), F.col("n_prompt_turns")), "chosen": rest(F.col("chosen")), "rejected": rest(F.col("rejected"))})
        .withColumns(
            {
                "prompt": text(F.col("prompt_turns")),
                "chosen_completion": text(F.col("chosen")),
                "rejected_completion": text(F.col("rejected")),
                "chosen_masks": _masks(F.col("chosen"), F.lit(LEARNED_ROLE)),
                "rejected_masks": _masks(F.col("rejected"), F.lit(LEARNED_ROLE)),
            }
        )
        .select(*[F.col(n).alias(c) for n, c in back.items() if n not in ("chosen", "rejected")], *RESULTS)
    )


def cut_answers(turns: DataFrame) -> DataFrame:
    """Each conversation as chosen, and as rejected the same with its last answer broken off halfway. Without an answer the two are
    equal. One shuffle, of each turn to its conversation."""
    convs = conversations_of(turns)
    n = F.size("turns")
    last = n - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit(LEARNED_ROLE))
    half = lambda x: F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int"))
    broken = F.transform(
        "turns", lambda t, i: F.when(i == last, F.struct(t["turn"], t["role"], half(t["text"]).alias("text"))).otherwise(t)
    )
    return convs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), broken.alias("rejected"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Conversations 2n and 2n + 1 as chosen and rejected of pair n. One without its neighbour is paired with nothing."""
    convs = conversations_of(turns).withColumn("pair_id", F.floor(F.col("conv_id") / 2))
    even = F.pmod("conv_id", F.lit(2)) == 0
    pick = lambda is_it: F.max_by(F.when(is_it, F.col("turns")), F.when(is_it, F.col("conv_id")))
    return convs.groupBy("pair_id").agg(pick(even).alias("chosen"), pick(~even).alias("rejected"))


def preference_digest(turns: DataFrame) -> DataFrame:
    """Per conversation: its prompt, and its last answer whole and broken off. Rows with a null conv_id fall out; null roles and texts
    count as empty; equal turns are ordered by role and text, repeated ones stay. Texts are not escaped: one that holds a role's line looks like a turn."""
    return preference_pairs(cut_answers(turns)).select(
        "pair_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion",
        F.to_json("chosen_masks").alias("chosen_masks"), F.to_json("rejected_masks").alias("rejected_masks"),
    )


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH o AS (
  SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max(n) FILTER (role = 'assistant') AS last FROM o GROUP BY pair_id),
t AS (SELECT pair_id, 0 AS side, n, role, text FROM o UNION ALL
      SELECT pair_id, 1 AS side, n, role, CASE WHEN n = last THEN substr(text, 1, length(text) // 2) ELSE text END FROM o JOIN l USING (pair_id)),
m AS (SELECT a.pair_id, a.n FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.n = b.n AND a.side = 0 AND b.side = 1 AND a.role = b.role AND a.text = b.text),
c AS (SELECT l.pair_id, (SELECT count(*) FROM (SELECT n, row_number() OVER (ORDER BY n) AS k FROM m WHERE m.pair_id = l.pair_id) WHERE n = k) AS k FROM l),
r AS (SELECT t.*, k, '<|' || role || '|>' || chr(10) || text || chr(10) AS r FROM t JOIN c USING (pair_id)),
s AS (SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY pair_id, side ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM r WHERE n > k),
e AS (SELECT pair_id, side, string_agg(r, '' ORDER BY n) AS body,
             string_agg(CASE WHEN role = 'assistant' THEN concat('{"start":', off + length(role) + 5, ',"end":', off + length(r), '}') END, ',' ORDER BY n) AS spans
      FROM s GROUP BY ALL)
SELECT c.pair_id, c.k::INTEGER AS n_prompt_turns,
       coalesce((SELECT string_agg(r, '' ORDER BY n) FROM r WHERE r.pair_id = c.pair_id AND side = 0 AND n <= r.k), '') AS prompt,
       coalesce(a.body, '') AS chosen_completion, coalesce(b.body, '') AS rejected_completion,
       '[' || coalesce(a.spans, '') || ']' AS chosen_masks, '[' || coalesce(b.spans, '') || ']' AS rejected_masks
FROM c LEFT JOIN e a ON a.pair_id = c.pair_id AND a.side = 0 LEFT JOIN e b ON b.pair_id = c.pair_id AND b.side = 1
"""
