"""Op 8. Preference formatting: the longest common turn prefix of a chosen and a rejected conversation
is rendered once as prompt; the rest of each becomes a completion with the spans that are trained on.

A turn renders as <|role|> newline text newline <|end|> newline. A completion's mask is the list of
character spans [start, end) of its assistant turns' text and end mark, counted in the completion;
everything else, the prompt included, is masked out.

Defined results: turns are ordered by (turn, role, text), ties and repeated rows stay; null role or
text counts as empty; rows without a conversation id are no conversation; a conversation without a
partner gives a row whose other side is null; an empty table gives no rows; extra columns are ignored.
A conversation is one document: its turns meet in one row, whose size is that of the longest conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TRAINED = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n<|end|>\n"))


def spans(turns: Column) -> Column:
    """Spans of trained characters as an array of structs (start, end)."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        after = acc["at"] + F.length(rendered(t))
        body = acc["at"] + F.length(t["role"]) + 5
        span = F.array(F.struct(body.alias("start"), (after - 1).alias("end")))
        return F.struct(after.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def pairs(turns: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row a pair, from one shuffle by pair."""
    t = turns.where(F.col("conv_id").isNotNull() & pair.isNotNull()).select(
        pair.alias("pair_id"), is_chosen.alias("chosen"), "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    side = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("t"))))
    g = t.groupBy("pair_id").agg(
        F.max(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"), F.max(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id"),
        side(F.col("chosen")).alias("c"), side(~F.col("chosen")).alias("r"),
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    g = g.withColumn("same", same).withColumn("prefix_turns", F.when(F.array_position("same", False) > 0, F.array_position("same", False) - 1).otherwise(F.size("same")).cast("int"))
    rest = lambda name: F.slice(F.col(name), F.col("prefix_turns") + 1, F.greatest(F.size(name) - F.col("prefix_turns"), F.lit(0)))
    text = lambda a: F.array_join(F.transform(a, rendered), "")
    return g.select(
        "pair_id", "chosen_id", "rejected_id", "prefix_turns", text(F.slice("c", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        F.when(F.col("chosen_id").isNotNull(), text(rest("c"))).alias("chosen"), F.when(F.col("rejected_id").isNotNull(), text(rest("r"))).alias("rejected"),
        F.when(F.col("chosen_id").isNotNull(), spans(rest("c"))).alias("chosen_spans"), F.when(F.col("rejected_id").isNotNull(), spans(rest("r"))).alias("rejected_spans"),
    )


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations pair up: the even id is chosen, the odd one rejected. Spans as text 'start-end,...'."""
    p = pairs(table(spark, sf_dir, "conversations"), F.expr("(conv_id - pmod(conv_id, 2)) div 2"), F.pmod("conv_id", F.lit(2)) == 0)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return p.withColumns({"chosen_spans": said(F.col("chosen_spans")), "rejected_spans": said(F.col("rejected_spans"))})


ORACLE = """
WITH t AS (SELECT (CAST(conv_id AS BIGINT) - (conv_id % 2 + 2) % 2) // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
 pre AS (SELECT pair_id, min(i) - 1 AS k FROM (
   SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i, coalesce(c.role = r.role AND c.text = r.text, false) AS same
   FROM (SELECT * FROM t WHERE is_chosen) c FULL JOIN (SELECT * FROM t WHERE NOT is_chosen) r ON c.pair_id = r.pair_id AND c.i = r.i) WHERE NOT same GROUP BY pair_id),
 size AS (SELECT pair_id, max(i) AS n FROM t GROUP BY pair_id),
 pk AS (SELECT s.pair_id, coalesce(pre.k, s.n) AS k FROM size s LEFT JOIN pre USING (pair_id)),
 u AS (SELECT t.*, pk.k, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS turn_text FROM t JOIN pk USING (pair_id)),
 v AS (SELECT *, CASE WHEN i > k THEN coalesce(sum(CASE WHEN i > k THEN length(turn_text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS pos FROM u)
SELECT pair_id, max(CASE WHEN is_chosen THEN conv_id END) AS chosen_id, max(CASE WHEN NOT is_chosen THEN conv_id END) AS rejected_id,
 CAST(max(k) AS INTEGER) AS prefix_turns, coalesce(string_agg(turn_text, '' ORDER BY i) FILTER (WHERE is_chosen AND i <= k), '') AS prompt,
 CASE WHEN bool_or(is_chosen) THEN coalesce(string_agg(turn_text, '' ORDER BY i) FILTER (WHERE is_chosen AND i > k), '') END AS chosen,
 CASE WHEN bool_or(NOT is_chosen) THEN coalesce(string_agg(turn_text, '' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > k), '') END AS rejected,
 CASE WHEN bool_or(is_chosen) THEN coalesce(string_agg(CAST(CAST(pos AS BIGINT) + length(role) + 5 AS VARCHAR) || '-' || CAST(CAST(pos AS BIGINT) + length(turn_text) - 1 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE is_chosen AND i > k AND role = 'assistant'), '') END AS chosen_spans,
 CASE WHEN bool_or(NOT is_chosen) THEN coalesce(string_agg(CAST(CAST(pos AS BIGINT) + length(role) + 5 AS VARCHAR) || '-' || CAST(CAST(pos AS BIGINT) + length(turn_text) - 1 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > k AND role = 'assistant'), '') END AS rejected_spans
FROM v GROUP BY pair_id
"""
